"""Fill-in-the-middle, line removal and collocations against brute force, on the smallest tables and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import FOLDER, ROWS, same, slow_near

from docketlake.llm import collocations, fill_middle, line_dedup, similar, simhash
from docketlake.llm.common import table
from docketlake.llm.queries import ORACLE, QUERIES
from oracle import compare, duck

LINES = [
    (1, "A line that three documents share\nown line of the first document"), (2, "  a LINE that three documents share\t\n\n"), (3, "x\n a line that three documents share \nx"),
    (3, "another row of document three\na line that three documents share"), (4, "short line\n"), (5, "short line"), (6, "short line"), (7, None), (8, ""), (9, "\n\n"),
    (None, "a line that three documents share\nkept without an id"), (10, "only two documents hold this line"), (11, "only two documents hold this line\nonly two documents hold this line"),
    (12, "zwölf Zeichen und mehr für ÄÖÜ\nend"), (13, "zwölf Zeichen und MEHR für ÄÖÜ"), (14, "zwölf zeichen und mehr für ÄÖÜ\nzwölf zeichen und mehr für ÄÖÜ"), (15, "zwölf Zeichen und mehr für äÖÜ"),
    (16, " a line that three documents share"), (17, "\n".join(f"line number {i % 700} of a long document" for i in range(20_000))), (18, "\n".join(f"line number {i} of a long document" for i in range(900))),
    (19, "\n".join(f"line number {i} of a long document" for i in range(0, 900, 2))), (1, "A line that three documents share\nown line of the first document"),
]


def clashing(spark, rows):
    names = ["kept", "n", "places", "_id", "batch", "h1", "lang_", "phrase", "output", "form", "last"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_line_dedup", "op13_collocations"])
def test_equals_sql(spark, con, name):
    diff, n = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    assert diff is None and n > 0, diff


# --- 11 Fill in the middle

def slow_middle(i, text):
    t = text or ""
    n = len(t)
    if i is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, t, t
    digest = hashlib.sha256(f"1:{i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if h[2] % 100 >= 90:
        return i, n, "plain", None, None, t, t
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t


def test_fill_in_middle(spark):
    odd = ["<", "<P", "P>", "<S", "é日🙂<", "a<P>b", "x<S>", "<M>", "<<SS>>", "🙂" * 70_000, "ab" * 200_000, "\x00<M", "S>P>M>"]
    rows = ROWS + [(100 + i, odd[i % len(odd)] + (" tail" * (i // len(odd)) if odd[i % len(odd)][-1] != ">" else "")) for i in range(len(odd) * 9)]
    found = fill_middle.restore(fill_middle.fill_in_middle(clashing(spark, rows)))
    same(found, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"], [slow_middle(*r) for r in rows])
    assert {r["form"] for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(clashing(spark, rows).filter("false"))).count() == 0


def test_rotation_and_cuts(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 3)
    rng = random.Random(1)
    plan = fill_middle.Plan()
    for _ in range(400):
        text = "".join(rng.choice("aé日🙂<PSM>") for _ in range(rng.randrange(1, 40)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        a, b = sorted(rng.choices(range(len(text) + 1), k=2))
        raw = text.encode()
        cuts = fill_middle.scan_cuts(raw, [a, b], len(text))
        assert cuts == [len(text[:a].encode()), len(text[:b].encode())]
        for form in ("psm", "spm"):
            out = fill_middle.arrange(raw, *cuts, form, plan)
            expected = f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
            assert out.decode() == expected
            assert fill_middle.rearrange(bytes(out), form, plan).decode() == text


def test_sentinels_that_can_be_mistaken_are_refused():
    for marks in (("<P>", "<P", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Plan(*marks)


# --- 12 Lines

def bare(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)


def slow_lines(rows):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare(s))
    holders = collections.defaultdict(set)
    for i, lines in split:
        for s in lines:
            if i is not None:
                holders[key(s)].add(i)
    for i, lines in split:
        gone = [len(key(s)) >= 20 and len(holders[key(s)]) >= 3 and i != max(holders[key(s)]) for s in lines]
        yield i, len(lines), sum(gone), "\n".join(s for s, g in zip(lines, gone, strict=True) if not g)


@pytest.mark.parametrize("batches,fanout", [(4, 2), (1, 2), (9, 3)])
def test_line_dedup(spark, batches, fanout):
    found = line_dedup.drop_repeated_lines(clashing(spark, LINES), batches=batches, fanout=fanout)
    same(found, ["doc_id", "n_lines", "n_dropped", "kept"], list(slow_lines(LINES)))


def test_line_dedup_on_a_table_and_on_nothing(spark):
    docs = table(spark, FOLDER, "documents")
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(line_dedup.drop_repeated_lines(docs), ["doc_id", "n_lines", "n_dropped", "kept"], list(slow_lines(given)))
    assert line_dedup.drop_repeated_lines(docs.filter("false")).count() == 0
    nobody = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert line_dedup.drop_repeated_lines(nobody).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_runs_settle_and_compact(spark):
    """A settled key leaves with the anti-join, so a later batch adds no entry for it; runs move up the levels."""
    runs = line_dedup.LineRuns(spark, least_docs=2, fanout=2)
    line = "doc_id long, text_key long, place int, h1 long, h2 long"
    runs.add(spark.createDataFrame([(9, 0, 0, 1, 1), (8, 0, 0, 1, 1), (8, 0, 1, 2, 2)], line))
    assert [len(x) for x in runs.levels] == [1]
    runs.add(spark.createDataFrame([(7, 0, 0, 1, 1), (7, 0, 1, 2, 2), (7, 0, 2, 3, 3)], line))
    assert [len(x) for x in runs.levels] == [0, 1]
    assert sorted(tuple(r) for r in runs.merged(runs.all()).collect()) == [(1, 1, 2, 9), (2, 2, 2, 8), (3, 3, 1, 7)]
    names = list(runs.written)
    assert sorted(tuple(r) for r in runs.repeated().collect()) == [(1, 1, 9), (2, 2, 8)]
    assert names and not any(spark.catalog.tableExists(n) for n in names)


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.drop_repeated_lines(table(spark, FOLDER, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))


# --- 13 Collocations

def slow_phrases(rows, top, least):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        found = []
        for p, a in candidates.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, p.decode(), -a, l, r, totals[lang], -s


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def prose(seed, rows, words=40):
    rng = random.Random(seed)
    vocabulary = [w + str(i) for i, w in enumerate(["Aa", "b", "Çc", "日", "d'e"] * (words // 5))]
    fixed = ["new york stock exchange", "AA0 b1 Çc2", "of the of the of", "x y"]
    for i in range(rows):
        text = "".join((rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary[:1 + int(rng.expovariate(0.15)) % len(vocabulary)]))
                       + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x85", "-"]) for _ in range(rng.randrange(60)))
        yield rng.choice(["en", "de", None, "x y"]), text


@pytest.mark.parametrize("top,least,first,growth", [(2000, 3, 2, 8), (10, 2, 1, 2), (25, 4, 2, 3), (3, 2, 1, 4)])
def test_collocations(spark, monkeypatch, top, least, first, growth):
    rows = list(prose(top, 250)) + [("en", None), ("en", ""), ("fr", " . ,\n"), ("nl", "one word")] + [("en", "twice the same text here")] * 5
    df = spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "lang string, text string, phrase string, f int, score double").repartition(5)
    found = collocations.collocations(df, top, least, first, growth)
    assert found.columns == COLUMNS
    same(found, COLUMNS, list(slow_phrases(rows, top, least)))


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "too few words to count")], "lang string, text string")).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(t for _, t in prose(7, 60)) + " " + "x" * 500 + " end of text"
    expected = {n: collections.Counter() for n in (1, 2, 3, 4)}
    for n in expected:
        phrases, counts = collocations.count_phrases(np.frombuffer(text.encode(), np.uint8), n, 0, None, "en")
        expected[n] = dict(zip(phrases.to_pylist(), counts.tolist(), strict=True))
    for size in (5, 64, 1000):
        monkeypatch.setattr(collocations, "SLICE_BYTES", size)
        for n, whole in expected.items():
            got = collections.Counter()
            for part, known in collocations.parts(text.encode(), 4):
                phrases, counts = collocations.count_phrases(part, n, known, None, "en")
                got.update(dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)))
            assert got == whole
        batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": ["a b c d e f", text, "c d e"]})
        total = sum(int(collocations.count_phrases(t, 1, known, None, lang)[1].sum()) for lang, t, known in collocations.slices(iter([batch]), 4))
        assert total == sum(expected[1].values()) + 9


def test_scores_beyond_64_bits(spark):
    big = 10**16
    row = spark.createDataFrame([(big, big + 7, 3 * big - 1)], "a long, b long, c long").select(
        collocations._ratio(F.col("a"), F.col("b") + F.col("c")).alias("s"), collocations._ratio(F.col("c"), F.col("c") + F.col("c")).alias("t")).first()
    assert (row["s"], row["t"]) == (2_000_000 * big // (4 * big + 6), 1_000_000)


# --- The near stage on crowds just below the threshold

def crowd(n, words=400, changed=5, seed=1):
    """Copies of one text with some words replaced at random: five of 400 give a Jaccard similarity of about 0.776."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    for i in range(n):
        other = list(base)
        for k in rng.choice(words, changed, replace=False):
            other[k] = f"new{rng.integers(1 << 40)}"
        yield i, " ".join(other)


@pytest.mark.parametrize("words,changed", [(400, 4), (90, 2)])
def test_crowds_around_the_threshold_equal_brute_force(spark, monkeypatch, words, changed):
    rows = list(crowd(70, words, changed, seed=words + changed)) + [(1000 + i, t + " tail") for i, t in crowd(20, words, changed, seed=words + changed)]
    wanted = {i for _, i in slow_near(rows)}
    monkeypatch.setattr(similar, "BLOCK_SETS", 16)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.deduplicate(made).collect()} == wanted


def test_slices_gather_over_small_batches():
    """Batches are smaller than slices; what waits is bounded over all languages."""
    batches = [pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": ["a b", "c"]}) for _ in range(50)]
    found = list(collocations.slices(iter(batches), 4))
    assert sorted((lang, len(text)) for lang, text, _ in found) == [("de", 99), ("en", 199)]


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    """Bit planes link near copies without the prefix join, and shingles confirm each link."""
    base = [f"w{k}" for k in range(600)]
    rows = [(i, " ".join(base[:300 + i] + [f"new{i}"] * (i > 0) + base[301 + i:])) for i in range(6)] + [(10, "something else altogether here")]
    monkeypatch.setattr(similar, "_pairs", lambda members, keys, stars: spark.createDataFrame([], "a long, b long"))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicate(made).collect()}
    assert {0, 10} <= kept and len(kept) < 5  # some differ in more bits than the radius
    monkeypatch.setattr(simhash, "close_links", lambda fps: fps.alias("x").crossJoin(fps.alias("y")).selectExpr("x.fp as a", "y.fp as b").filter("a < b"))
    assert {r["doc_id"] for r in simhash.deduplicate(made).collect()} == {0, 10}
