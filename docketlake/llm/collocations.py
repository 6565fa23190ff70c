"""Phrases that stand out in each language, by best-first branch and bound (operator 13).

A phrase of 2 to 4 words that occurs often enough (a) is a candidate; cut after k words it scores
``2000000 * a / (l + r)``, l and r being the counts of its parts, and its lowest cut counts.  The
phrases form a tree of prefixes, which grows a word at a time by passes over the texts:

* Counts of prefixes bound what can grow from them: a phrase that begins with p has a <= f(p) and
  r >= a, so its score is at most ``2000000 * f(p) / (f(first word) + f(p))``; likewise from the end.
* Whether a candidate survives depends only on phrases one word longer: a longer one that covers it
  holds one of those, which occurs at least as often.

A round takes the best of the frontier: every bigram and then every trigram whose bound reaches the
score of each language's K-th bigram.  All phrases at or above that score are then known, with their
survival.  A language is settled when its 2000th survivor (ties included) reaches that score, or when
the frontier is empty; the others go on with a larger K.

Texts are read as words with NumPy, a slice of bounded size at a time.  A slice counts its phrases
by exact codes and hands on one row per different phrase; Spark adds these up by (lang, phrase).
Which prefixes a pass extends travels as a bit set of fixed size: if it is too full, more phrases are
counted, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import top_per_key
from ..session import ship_package
from .common import written
from .repeats import bit_set, held, mix

LONGEST = 4
LEAST_COUNT = 30
TOP = 2000
SCALE = 2_000_000
#: A candidate goes if a longer one has at least COVERED / 5 of its count.
COVERED = 4
#: Bytes of text that are turned into words at a time.
SLICE_BYTES = 1 << 21
#: Texts of all languages together that wait to be joined.
WAITING_BYTES = 1 << 23
#: The first K, as a multiple of TOP, and its growth from round to round.
FIRST, GROWTH = 2, 8

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHAPE = "lang string, phrase string, n long"


# --- Counting in a slice of text

def slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, np.ndarray, int]]:
    """(lang, bytes, words that were already counted) in pieces of about SLICE_BYTES; documents are parted by line feeds.

    A longer text is cut between words; each part begins with the last words of the one before.
    """
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            raw = text.as_py().encode()
            if len(raw) > SLICE_BYTES:
                yield from ((lang, *part) for part in parts(raw, longest))
                continue
            waiting.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
            if sizes[lang] >= SLICE_BYTES:
                yield lang, np.frombuffer(b"\n".join(waiting.pop(lang)), np.uint8), 0
                del sizes[lang]
        if sum(sizes.values()) >= WAITING_BYTES:
            for lang in list(waiting):
                yield lang, np.frombuffer(b"\n".join(waiting.pop(lang)), np.uint8), 0
            sizes.clear()
    for lang in list(waiting):
        yield lang, np.frombuffer(b"\n".join(waiting.pop(lang)), np.uint8), 0


def parts(raw: bytes, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a long text; all but the first begin with up to ``longest - 1`` words that were already counted."""
    text = np.frombuffer(raw, np.uint8)
    between = np.append(np.flatnonzero(_BREAK[text] | _BLANK[text]), len(text))
    begin, done, known = 0, 0, 0
    while done < len(text):
        end = int(between[min(np.searchsorted(between, done + SLICE_BYTES), len(between) - 1)])
        yield text[begin:end], known
        first, last = word_places(text[begin:end])
        known = min(longest - 1, len(first))
        begin, done = (begin + int(first[-known]) if known else end), end + 1


def word_places(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word."""
    edge = np.diff((~(_BREAK[text] | _BLANK[text])).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def read_words(text: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the code of each word, and the number of the piece it lies in."""
    first, last = word_places(text)
    piece = np.searchsorted(np.flatnonzero(_BREAK[text]), first)
    inside = ~(_BREAK[text] | _BLANK[text])
    offsets = np.append(0, np.cumsum(last - first)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_LOWER[text[inside]]))
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece


def word_ids(words: pa.Array, lang: str) -> np.ndarray:
    """Identifiers of words of a language, for the bit sets."""
    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def phrase_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """Identifiers of the n words that begin at each place, from those of single words."""
    out = ids[:max(0, len(ids) - n + 1)]
    for k in range(1, n):
        out = mix(out, ids[k:len(ids) - n + 1 + k])
    return out


def count_phrases(text: np.ndarray, n: int, known: int, wanted, lang: str) -> tuple[pa.Array, np.ndarray]:
    """The different phrases of n words and how often each occurs; ``wanted`` picks places by the identifiers of all words."""
    words, code, piece = read_words(text)
    at = np.arange(max(0, len(code) - n + 1))
    at = at[(piece[at] == piece[at + n - 1]) & (at + n > known)]
    if wanted is not None and len(at):
        at = at[wanted(word_ids(words, lang)[code])[at]]
    # Words beyond the first two join a code that is kept small, so that it never passes 64 bits.
    key, base = code[at], np.int64(max(1, len(words)))
    for k in range(1, n):
        if k > 1:
            _, key = np.unique(key, return_inverse=True)
        key = key * base + code[at + k]
    _, where, counts = np.unique(key, return_index=True, return_counts=True)
    begin = at[where]
    columns = [words.take(pa.array(code[begin + k])) for k in range(n)]
    return (pc.binary_join_element_wise(*columns, " ") if n > 1 else columns[0]), counts


def _counting(n: int, chosen):
    """Counts of phrases of n words per slice; ``chosen(ids)`` tells of each place whether a phrase is wanted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text, known in slices(batches, LONGEST):
            phrases, counts = count_phrases(text, n, known, chosen, lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int64))), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

    return run


def counted(rows: DataFrame, n: int, chosen=None) -> DataFrame:
    return rows.mapInArrow(_counting(n, chosen), SHAPE).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


# --- Sets of phrases

def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[tuple[str, str], int] = {}
        ids = np.zeros(b.num_rows, np.uint64)
        for row, (lang, phrase) in enumerate(zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)):
            words = phrase.split(" ")
            new = [w for w in words if (lang, w) not in seen]
            seen.update(zip(((lang, w) for w in new), word_ids(pa.array(new, pa.string()), lang).tolist(), strict=True))
            ids[row] = phrase_ids(np.array([seen[lang, w] for w in words], np.uint64), len(words))[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], ["id"])


def phrase_set(phrases: DataFrame):
    """A bit set of the phrases of (lang, phrase), sent to all tasks."""
    ids = phrases.select("lang", "phrase").mapInArrow(_identified, "id long")
    return phrases.sparkSession.sparkContext.broadcast(bit_set(ids, "id"))


def _both_words(words):
    def chosen(ids: np.ndarray) -> np.ndarray:
        often = held(words.value, ids)
        return often[:-1] & often[1:]

    return chosen


def _grown(n: int, either, first, last):
    """Places of phrases of n + 1 words that hold a phrase of ``either``, or begin with one of ``first`` and end with one of ``last``."""

    def chosen(ids: np.ndarray) -> np.ndarray:
        short = phrase_ids(ids, n)
        found = held(first.value, short[:-1]) & held(last.value, short[1:])
        if either is not None:
            e = held(either.value, short)
            found |= e[:-1] | e[1:]
        return found

    return chosen


# --- Scores and bounds

def _ratio(a: Column, total: Column) -> Column:
    """floor(SCALE * a / total) without rounding: the product may pass 64 bits."""
    wide = F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)")
    return F.call_function("floor", F.try_divide(wide - F.try_mod(wide, total.cast("decimal(21,0)")), total.cast("decimal(21,0)"))).cast("long")


def scored(phrases: DataFrame, n: int, tables: dict[int, DataFrame]) -> DataFrame:
    """``phrases`` of n words with l, r and score of their lowest cut, and the bounds ``ahead`` and ``behind`` of what they may grow into.

    A part that is in no table was ruled out by its bound; then the score is null.
    """
    words = F.split("phrase", " ")
    out, cuts = phrases, []
    for k in range(1, n):
        for name, size, part in ((f"_l{k}", k, F.slice(words, 1, k)), (f"_r{k}", n - k, F.slice(words, k + 1, n - k))):
            counts = tables[size].select("lang", F.col("phrase").alias(f"{name}_p"), F.col("f").alias(name))
            out = out.withColumn(f"{name}_p", F.array_join(part, " ")).join(counts, ["lang", f"{name}_p"], "left").drop(f"{name}_p")
        l, r = F.col(f"_l{k}"), F.col(f"_r{k}")
        cuts.append(F.struct(_ratio(F.col("f"), l + r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    lowest = F.array_min(F.array(*cuts))
    known = reduce(lambda a, b: a & b, [F.col(f"_{s}{k}").isNotNull() for s in "lr" for k in range(1, n)])
    f = F.col("f")
    return out.withColumn("_cut", F.when(known, lowest)).select(
        "lang", "phrase", "f", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"),
        _ratio(f, F.col("_l1") + f).alias("ahead"), _ratio(f, F.col(f"_r{n - 1}") + f).alias("behind"))


def covered(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(lang, phrase) of the shorter candidates that a candidate one word longer covers."""
    words = F.split("phrase", " ")
    n = F.size(words) - 1
    inner = longer.select("lang", F.col("f").alias("_f"), F.explode(F.array(
        F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, 2, n), " "))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return shorter.join(most, ["lang", "phrase"]).filter(F.col("_f") * 5 >= F.col("f") * COVERED).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP, least_count: int = LEAST_COUNT, first: int = FIRST, growth: int = GROWTH,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang is ``und``; a repeated row counts each time.  Ties in score go
    to the larger count, then to the phrase that comes first as UTF-8.  Texts without words give
    nothing, an empty table an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every_word = written(counted(rows, 1), "words")
    totals = every_word.groupBy("lang").agg(F.sum("f").alias("n"))
    often = F.col("f") >= least_count
    tables = {1: every_word.filter(often)}
    # The root of the tree: frequent words, which bound nothing yet.
    pairs = counted(rows, 2, _both_words(phrase_set(tables[1]))).filter(often)
    tables[2] = written(pairs, "bigrams")
    bigrams = written(scored(tables[2], 2, tables), "bigram-scores")
    settled, goal = [], first * top
    while True:
        least = written(_least_scores(bigrams, goal), "least-scores")
        found = _round(rows, bigrams, tables, least, least_count)
        best = written(top_per_key(found, ["lang"], [F.desc("score"), F.desc("f"), F.asc("phrase")], top), "best")
        # Settled: enough survivors, or a frontier that held all bigrams.
        state = best.groupBy("lang").agg(F.count(F.lit(1)).alias("survivors"))
        done = least.join(state, "lang", "left").filter((F.coalesce("survivors", F.lit(0)) >= top) | F.col("whole")).select("lang")
        done = written(done, "settled")
        settled.append(best.join(done, "lang", "left_semi"))
        bigrams = written(bigrams.join(done, "lang", "left_anti"), "bigrams-left")
        if bigrams.isEmpty():
            break
        goal *= growth
    out = reduce(DataFrame.unionByName, settled).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _least_scores(bigrams: DataFrame, goal: int) -> DataFrame:
    """(lang, least, whole): the score of each language's ``goal``-th bigram, 0 if it has fewer."""
    best = top_per_key(bigrams.select("lang", "score"), ["lang"], [F.desc("score")], goal)
    held_ = best.groupBy("lang").agg(F.min("score").alias("_score"), F.max("rank").alias("_rank"))
    return held_.select("lang", F.when(F.col("_rank") >= goal, F.col("_score")).otherwise(0).alias("least"), (F.col("_rank") < goal).alias("whole"))


def _round(rows: DataFrame, bigrams: DataFrame, tables: dict[int, DataFrame], least: DataFrame, least_count: int) -> DataFrame:
    """Every surviving candidate that reaches the least score of its language."""
    often = F.col("f") >= least_count
    two = bigrams.join(least, "lang")
    sets = [phrase_set(two.filter(F.col(c) >= F.col("least"))) for c in ("ahead", "behind")]
    # A part of a phrase of four words has to be known from one side only: either its beginning or its end can be good enough.
    three = written(counted(rows, 3, _from_either(2, *sets)).filter(often), "trigrams")
    trigrams = written(scored(three, 3, tables), "trigram-scores")
    three_left = trigrams.join(least, "lang")
    sets = [phrase_set(three_left.filter(F.col(c) >= F.col("least"))) for c in ("score", "ahead", "behind")]
    four = written(counted(rows, 4, _grown(3, *sets)).filter(often), "fourgrams")
    fourgrams = scored(four, 4, tables | {3: three})
    good = (F.col("score") >= F.col("least"))
    columns = ["lang", "phrase", "f", "l", "r", "score"]
    levels = [(two, three), (three_left, four), (fourgrams.join(least, "lang"), None)]
    out = []
    for level, longer in levels:
        c = level.filter(good).select(*columns)
        out.append(c if longer is None else c.join(covered(longer, c), ["lang", "phrase"], "left_anti"))
    return reduce(DataFrame.unionByName, out)


def _from_either(n: int, first, last):
    def chosen(ids: np.ndarray) -> np.ndarray:
        short = phrase_ids(ids, n)
        return held(first.value, short[:-1]) | held(last.value, short[1:])

    return chosen


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM t, range(1, 5) s(k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
tot AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
h AS MATERIALIZED (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
u AS (SELECT h.lang, h.phrase, h.a, h.k, h.j, x.a AS l, y.a AS r, (2000000::HUGEINT * h.a) // (x.a + y.a) AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.tail),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
q AS (SELECT * FROM m s WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = s.lang AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 80 * s.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN tot USING (lang) WHERE rank <= 2000
"""
