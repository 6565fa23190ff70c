"""Each training-data operator against a brute-force version, on the smallest tables and on awkward rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import DATA
from pyspark.sql import functions as F

from docketlake.llm import exact_dedup, packing, passage_dedup, pii, quality_model, quality_rules, sentencepiece_fst, simhash, substring_dedup, toxicity
from docketlake.llm.common import TwoGenerations, table
from docketlake.llm.queries import tokenizer_path

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and-{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
#: Nulls, empty and blank texts, repeated rows, ties, one id with two texts, long texts, other blanks, odd characters.
ROWS = [
    (1, "one two three"), (1, "one two three"), (2, "one two three"), (2, "another text of the same id"), (3, None), (4, ""), (5, " \t\n "), (None, "one two three"), (None, None),
    (6, LONG), (7, LONG + " end"), (8, PASSAGE), (9, "before " + PASSAGE + " after"), (10, PASSAGE.upper()), (11, "no break a b \u0085 é́ ﬁ ▁ 日本語 🙂" * 9),
    (12, "mail a.b+c@d-e.fr, a@b.c_d@e.f and x@y 10.0.0.1 1.2.3.999 4111 1111 1111 1111 +49 (30) 123456789 password=abc123def456abc789"), (13, "x" * 5000), (14, "ab" * 3000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """The rows above with columns whose names clash with those the operators use."""
    rows = [(i, t, "kept", 1, None, "s") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, fp int, score double, span string").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, FOLDER, "labels")


@pytest.fixture(scope="module")
def given(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def both(given, docs, awkward):
    return [(given, docs), (ROWS, awkward)]


def same(df, columns, expected):
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == collections.Counter(expected)


def words(text):
    return WORDS.findall(text or "")


# --- 1 SimHash

def slow_fingerprint(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values):
    todo, out = set(values), {}
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            f = edge.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 4}
            todo -= near
            edge += near
        out |= dict.fromkeys(group, min(group))
    return out


def test_simhash(given, docs, awkward):
    for rows, df in both(given, docs, awkward):
        prints = [slow_fingerprint(t) for _, t in rows]
        of, first = slow_components(prints), {}
        for (i, _), f in zip(rows, prints):
            if i is not None:
                first[of[f]] = min(first.get(of[f], i), i)
        same(simhash.near_duplicates(df), ["doc_id", "fingerprint", "component_id"], [(i, f"{f:016x}", first.get(of[f])) for (i, _), f in zip(rows, prints)])


def test_simhash_links_of_dense_and_crowded_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 30, np.uint64)
    values = [int(c) for c in centres]
    for c in values[:30]:
        for _ in range(40):
            f = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(b)
            values.append(f)
    values = sorted(set(values))
    expected = slow_components(values)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)  # nearly all buckets are taken apart
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    links = simhash.close_links(spark.createDataFrame(signed, "fp long"))
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(links).collect()}
    groups = collections.defaultdict(set)
    for v in values:
        groups[roots.get(v, v)].add(v)
    wanted = collections.defaultdict(set)
    for v in values:
        wanted[expected[v]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_keeps_one_of_each_group(awkward):
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[3] == 1 and ids[4] == 0 and ids[5] == 0 and None not in ids


def slow_shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_similar(sets):
    """Component of each different set over all pairs with a Jaccard similarity of 0.8 or more."""
    sets, holds, of = list(set(sets)), collections.defaultdict(list), {}
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holds[x] if j < k).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                root[max(top(j), top(k))] = min(top(j), top(k))
    for k, s in enumerate(sets):
        of[s] = top(k)
    return of


def slow_near(rows):
    """Ids and texts that stay: the smallest id of each component, one of equal rows."""
    sets = [slow_shingles(t) for _, t in rows]
    of, least, kept = slow_similar(sets), {}, {}
    for (i, _), s in zip(rows, sets):
        if i is not None:
            least[of[s]] = min(least.get(of[s], i), i)
    for (i, t), s in zip(rows, sets):
        if i == least.get(of[s]):
            kept.setdefault((of[s], i), set()).add(t or "")
    return kept


def similar_texts():
    """Chains of texts that differ from one another in few or many words, around the similarity of 0.8, also of a hot passage."""
    rng, rows = np.random.default_rng(11), []
    for g in range(40):
        base = [f"w{g}x{k}" for k in range(int(rng.integers(6, 300)))] if g % 4 else PASSAGE.split()
        for _ in range(30 if g % 4 == 0 else 8):
            other = list(base)
            for k in rng.integers(0, len(base), int(rng.integers(0, 1 + len(base) // 30 + 1))):
                other[k] = f"new{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(other[:len(other) - int(rng.integers(0, 3))])))
            base = other if rng.random() < 0.3 else base
    return rows


def test_near_stage_leaves_no_similar_pair(spark, monkeypatch, given, docs, awkward):
    from docketlake.llm import similar

    rows = similar_texts()
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for small in (False, True):
        if small:  # crowded buckets are cut, and the order comes from all texts
            monkeypatch.setattr(similar, "BLOCK_SETS", 5)
            monkeypatch.setattr(similar, "SAMPLE", 1)
        for expected, df in [(rows, made), *both(given, docs, awkward)]:
            wanted = slow_near(expected)
            got = collections.Counter((r["doc_id"], r["text"] or "") for r in simhash.deduplicate(df).collect())
            assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(i for _, i in wanted)
            assert all(any(w == i and t in texts for (_, w), texts in wanted.items()) for i, t in got)


# --- 2 and 9 repeated strings and passages

def slow_repeats(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k:k + 400] for _, t in data for k in range(len(t) - 399))
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone[k:k + 400] = True
        rest = bytes(b for b, g in zip(t, gone) if not g)
        yield i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(rest).hexdigest()


def test_substrings(given, docs, awkward):
    small = [(i, t[:20_000] if t else t) for i, t in ROWS]
    cut = awkward.selectExpr("doc_id", "substring(text, 1, 20000) text", "span")
    for rows, df in [(given[:120], docs.filter(docs.doc_id.isin([i for i, _ in given[:120]]))), (small, cut)]:
        same(substring_dedup.remove_repeats(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], slow_repeats(rows))


def slow_passages(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


def test_passages(given, docs, awkward):
    for rows, df in both(given, docs, awkward):
        same(passage_dedup.remove_passages(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], slow_passages(rows))


def test_crowded_buckets_and_long_texts(spark, monkeypatch):
    """One phrase in very many different surroundings, groups of few rows, and texts longer than a part."""
    monkeypatch.setattr(passage_dedup.Words, "group_rows", 4)
    monkeypatch.setattr(substring_dedup.Bytes, "group_rows", 4)
    monkeypatch.setattr(passage_dedup, "PART", 64)
    monkeypatch.setattr(substring_dedup, "PART", 1024)
    rng = np.random.default_rng(2)
    line = "the very same line of many words stands in each of these texts and is long enough to be sampled always " * 3
    tail = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(40)]
    rows = [(k, tail[rng.integers(40)] + " " + line + tail[rng.integers(40)] + tail[rng.integers(3)] * int(rng.integers(1, 9))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(passage_dedup.remove_passages(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], slow_passages(rows))
    same(substring_dedup.remove_repeats(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], slow_repeats(rows))


# --- 3 quality rules

def slow_counts(text):
    w, t = words(text), text or ""
    seen = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(given, docs, awkward, labels):
    for rows, df in both(given, docs, awkward):
        found = quality_rules.quality_verdicts(df, labels)
        failed = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
        same(found, ["doc_id", *quality_rules.COUNTS, "base_failed"], [(i, *slow_counts(t), failed(slow_counts(t))) for i, t in rows])
        assert found.filter("kept and base_failed").count() == 0
        kept = quality_rules.filter_quality(df, labels)
        assert kept.columns == df.columns and kept.count() == found.filter("kept").count()


def test_quality_rules_tell_labels(spark):
    folder = f"{DATA}/sf0.01"
    labels = table(spark, folder, "labels")
    found = quality_rules.quality_verdicts(table(spark, folder, "documents"), labels).filter("not base_failed").join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.98 and found[found.quality == 0].kept.mean() < 0.1


def test_forest_without_labels(awkward, labels):
    found = quality_rules.quality_verdicts(awkward, labels.filter("false"))
    assert found.filter("kept = base_failed").count() == 0


# --- 4 personal data

def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: max(map(int, m[0].split("."))) <= 255, "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_personal_data(given, docs, awkward):
    for rows, df in both(given, docs, awkward):
        expected = []
        for i, t in rows:
            s = slow_spans(t)
            text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in s)
            expected.append((i, *(sum(x[3] == k for x in s) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest()))
        found = pii.personal_data(df)
        same(found, ["doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256"], expected)


def test_many_matches_in_one_text(spark):
    text = "x 10.1.2.3, " * 3000 + "a" * 200_000 + " 1" * 20_000
    found = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["n_ip"] == 3000 and found["spans"].startswith("ip:2:10,ip:14:22,") and found["spans"].count("ip") == 3000


def test_secrets_are_added_and_redacted(spark):
    folder = f"{DATA}/sf0.01"
    df = table(spark, folder, "documents")
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    secrets = re.compile(r"AKIA[0-9A-Z]{16}|\b[0-9a-f]{40}\b|(?<=password=)[0-9a-f]{18}")
    wanted = {(i, m.start()) for i, t in text.items() for m in secrets.finditer(t)}
    found = {(r["doc_id"], int(s.split(":")[1])) for r in pii.personal_data(df).collect() for s in r["spans"].split(",") if s.startswith("secret")}
    assert wanted and len(wanted & found) >= 0.9 * len(wanted) and len(found - wanted) <= 0.1 * len(found)
    after = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert all(not slow_spans(t) for t in after.values()) and sum(t == text[i] for i, t in after.items()) > 800


def test_redaction_of_thousands_of_overlapping_spans(spark):
    """Addresses with dotted numbers in them: an e-mail overlaps the numbers it holds, some of which stick out of it."""
    units = ["é.1.2.3.4.5.6.7.8@a.b ", "x@10.20.30.40 ", "+41 12 345 67 89 10.0.0.1 ", "4111 1111 1111 1111", " 漢 1.2.3.4,", "z@y.1.2.3.4.5\n"]
    rows = [(n, "".join(units[(i * i + n) % len(units)] for i in range(n))) for n in (1, 2, 3, 7, 256, 257, 1000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.personal_data(df).collect()}
    after = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for n, text in rows:
        merged, out, done = [], "", 0
        for start, end, kind in spans[n]:
            if merged and merged[-1][1] > start:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        for start, end, kind in merged:
            out, done = out + text[done:start] + f"<{kind}>", end
        assert after[n] == out + text[done:] and len(merged) < max(len(spans[n]), 2)


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "to a@b.c now", None), (2, None, "x"), (3, "", "y"), (4, "plain", "z")]
    after = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, kind string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in after] == [(1, "to <email> now", None), *rows[1:]]


# --- 5 SentencePiece

def test_sentencepiece(given, docs, awkward):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    for rows, df in both(given, docs, awkward):
        expected = []
        for i, t in rows:
            ids = model.encode(t or "")
            expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        found = sentencepiece_fst.round_trip(df, path)
        same(found, ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"], expected)
        assert found.filter("not same").count() == sum("▁" in (t or "") for _, t in rows)


def test_round_trip_is_one_python_step(docs):
    """Two chained steps would hold two workers, each with the model and its caches, per core."""
    plan = sentencepiece_fst.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_transducer_on_random_strings():
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model, own = SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        t = "".join(rng.choice(list("abcdefghij eéñ▁\n09.,TtSs日🙂\t"), rng.integers(1, 90)))
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == model.encode(t) and own.decode(ids) == model.decode(ids)


# --- 6 exact duplicates

def test_exact_duplicates(given, docs, awkward, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_HEAVY", 3)  # some groups take the other way
    for rows, df in both(given, docs, awkward):
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        same(exact_dedup.exact_duplicates(df), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
             [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows])
        kept = exact_dedup.deduplicate(df)
        assert kept.columns == df.columns
        assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((keep[t], t) for t in groups)


# --- 7 toxicity and 10 quality model

def test_toxicity_on_held_out_rows(spark):
    folder = f"{DATA}/sf0.01"
    labels = table(spark, folder, "labels")
    found = toxicity.toxicity(table(spark, folder, "documents"), labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert held[held.toxic == 0].said.mean() < 0.05 and held[held.toxic == 1].said.mean() > 0.6


def test_quality_model_on_held_out_rows(spark):
    folder = f"{DATA}/sf0.01"
    labels = table(spark, folder, "labels")
    found = quality_model.quality_scores(table(spark, folder, "documents"), labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert found.score.between(0, 1).all() and ((found.score >= 0.3).astype(int) == found.predicted).all()
    assert (held.predicted == held.quality).mean() > 0.9


def test_models_take_awkward_rows(awkward, labels):
    for run in (toxicity.toxicity, quality_model.quality_scores):
        for marks in (labels, labels.filter("false"), labels.selectExpr("cast(null as long) doc_id", "quality", "toxic")):
            assert run(awkward, marks).count() == len(ROWS)


# --- 8 packing

def test_packing(given, docs, awkward):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for rows, df in both(given, docs, awkward):
        found = packing.pack(df, path).toPandas()
        ids = collections.defaultdict(collections.Counter)
        for i, t in rows:
            full = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            for s in range(0, len(full), 4096):
                ids[i][(s, len(full[s:s + 4096]), zlib.crc32(full[s:s + 4096].tobytes()), len(full))] += 1
        got = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found.itertuples())
        assert got == collections.Counter({(i, *p): n for i, c in ids.items() for p, n in c.items()})
        for _, seq in found.sort_values("offset").groupby("sequence_id"):
            assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 4096


def test_words_are_encoded_together_as_alone():
    ids, rng = packing.WordIds(tokenizer_path("word_bpe_49k.json")), random.Random(5)
    signs = [*"abcJIst'.,;:)#01-", "é", "İ", "ß", "Σ", "\u0301", "\u030c", "\u0307", "\u1100", "\u1161", "가", "\u00a0", "\u200d", "😀", "中", "\u0344", "\u0f73", "'s"]
    words = [w for w in ("".join(rng.choices(signs, k=rng.choice((1, 2, 3, 9)))) for _ in range(3000)) if w.encode().split() == [w.encode()]]
    alone = [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert ids._encode([w.encode() for w in words]) == alone


def test_remembered_words_fit_an_executor(monkeypatch):
    monkeypatch.setattr(packing, "_cache", {})
    ids = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    ids._encode = lambda words: [b"0123"] * len(words)
    for start in range(0, 600_000, 1000):
        ids.ids(b" ".join(b"%d" % n for n in range(start, start + 1000)))
    assert len(ids.known.young) + len(ids.known.old) <= 320_000


def test_best_fit_decreasing():
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        place, offset = packing.best_fit_decreasing(lengths, 100)
        free: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [f for f in free if f >= n]
            free.remove(min(fits)) if fits else None
            free.append((min(fits) if fits else 100) - n)
        assert place.max() + 1 == len(free)
        for w in range(place.max() + 1):
            own = np.argsort(offset[place == w])
            assert (offset[place == w][own] == np.cumsum(lengths[place == w][own]) - lengths[place == w][own]).all() and lengths[place == w].sum() <= 100


def test_cache_forgets_in_generations():
    known, asked = TwoGenerations(3), []

    def encode(words_):
        asked.extend(words_)
        return [w.encode() for w in words_]

    for text in ("a b", "c a", "d a", "b a"):
        assert known.joined(text.split(), encode) == text.replace(" ", "").encode()
    assert sorted(asked) == ["a", "b", "c", "d"] and len(known.young) <= 3


# --- all of them

def test_empty_tables(empty, labels):
    path, model = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
    for run in (simhash.near_duplicates, simhash.deduplicate, substring_dedup.remove_repeats, passage_dedup.remove_passages, pii.personal_data, pii.redact,
                exact_dedup.exact_duplicates, exact_dedup.deduplicate, lambda d: quality_rules.quality_verdicts(d, labels), lambda d: quality_rules.filter_quality(d, labels),
                lambda d: sentencepiece_fst.round_trip(d, model), lambda d: toxicity.toxicity(d, labels), lambda d: quality_model.quality_scores(d, labels), lambda d: packing.pack(d, path)):
        assert run(empty).collect() == []


def test_deduplication_takes_columns_named_like_its_helpers(awkward):
    names = ["_id", "_rows", "_own", "_hash", "_digest", "_own_digest", "_own_id", "_row", "root"]
    extra = awkward.select("doc_id", "text", *[F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit(""))).alias(c) for c in names])
    for run in (simhash.deduplicate, exact_dedup.deduplicate):
        found = run(extra)
        assert found.dtypes == extra.dtypes
        same(found, ["doc_id", "text"], [(r["doc_id"], r["text"]) for r in run(awkward).collect()])
        assert all(r[c] == f"{c} {r['text'] or ''}" for r in found.collect() for c in names)


def test_pipeline_stages(spark, awkward, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, table(spark, FOLDER, "documents")):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert found.columns == docs.columns and found.schema == docs.schema
            else:
                assert found.count() >= docs.count()
