"""Quality rules with an isolation forest over their statistics (operator 3).

Each text gives a few rule statistics.  An isolation forest is grown on a bounded sample of
labelled rows: documents that random splits isolate early are anomalous.  The cut between kept and
rejected scores is calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Rows the forest may be grown on: the bound of what reaches the driver.
MAX_FIT_ROWS = 8192
TREES, TREE_ROWS = 128, 256
#: Bins of the scores (0 .. 1) from which the cut is chosen.
SCORE_BINS = 1000
#: How many wrongly kept labelled rows weigh as much as one wrongly rejected.
REJECT_COST = 3.0
#: What a statistic has to gain on the sample to be watched.
LEAST_GAIN = 0.02
#: The base rules.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols_per_char", "repeats_per_word", "dup_lines_share", "capitals_share", "marks_per_word", "bars_per_word"]

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _CAPITAL | np.isin(np.arange(256), np.arange(97, 123))
_MARK = np.isin(np.arange(256), list(b"!?"))
_STARTS = (np.arange(256) & 0xC0) != 0x80


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(numbers) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    hit = np.zeros(len(window), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= hit
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Rule counts and the ratios the forest sees."""
    words = text.split()
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, chars = len(words), int(kinds[_STARTS & ~_SPACE].sum())
    symbols = int(kinds[_SYMBOL].sum())
    lines, seen, dup = [x for x in text.split(b"\n") if x.strip()], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    repeats = repeated_words(words)
    w = max(n, 1)
    ratios = [symbols / max(chars, 1), repeats / w, dup / max(len(lines), 1), kinds[_CAPITAL].sum() / max(kinds[_LETTER].sum(), 1),
              kinds[_MARK].sum() / w, kinds[124] / w]
    return [n, chars, symbols, dup, repeats], [float(x) for x in ratios]


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, children, and the path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    rows: int
    usual: np.ndarray
    cut: float = 2.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score between 0 and 1; higher: isolated earlier."""
        x = np.maximum(x - self.usual, 0)
        total, every = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[every, np.maximum(f, 0)] < self.value[t, at]
                at = np.where(inner, np.where(goes, self.left[t, at], self.right[t, at]), at)
            total += self.length[t, at]
        return 2.0 ** (-total / len(self.feature) / max(_usual_path(self.rows), 1e-9))


def _usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def usual_values(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Per statistic, the value that best parts good rows from bad ones; infinite where none parts them.

    The forest sees only the excess over it, so what good documents have as well is not anomalous.
    """
    out = np.full(good.shape[1], np.inf)
    for f in range(good.shape[1] if len(bad) else 0):
        tries = np.unique(np.quantile(np.concatenate([good[:, f], bad[:, f]]), np.linspace(0, 1, 201)))
        gain = [(bad[:, f] > v).mean() - REJECT_COST * (good[:, f] > v).mean() for v in tries]
        if max(gain) > LEAST_GAIN:
            out[f] = tries[int(np.argmax(gain))]
    return out


def grow(good: np.ndarray, bad: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Trees of random splits of the box that the whole sample spans; ``rows`` good rows fall through each.

    The box is split, not the range of a node's rows: a value no good row has is cut off all the
    sooner the further out it lies.
    """
    rng, rows, usual = np.random.default_rng(seed), min(rows, len(good)), usual_values(good, bad)
    x = np.maximum(good - usual, 0)
    top = np.maximum(x.max(0), np.maximum(bad - usual, 0).max(0)) if len(bad) else x.max(0)
    wide = np.flatnonzero(top > 0)
    deepest = int(np.ceil(np.log2(max(rows, 2))))
    size = 2 ** (deepest + 1)
    feature, value = np.full((trees, size), -1), np.zeros((trees, size))
    left, right, length = np.zeros((trees, size), np.int64), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, used = [(0, rng.choice(len(x), rows, replace=False), 0, np.zeros(len(top)), top)], 1
        while todo:
            at, own, depth, low, high = todo.pop()
            if depth == deepest or not len(own) or not len(wide):
                length[t, at] = depth + _usual_path(len(own))
                continue
            f = rng.choice(wide)
            v = rng.uniform(low[f], high[f])
            goes = x[own, f] < v
            feature[t, at], value[t, at], left[t, at], right[t, at] = f, v, used, used + 1
            lower, upper = high.copy(), low.copy()
            lower[f] = upper[f] = v
            todo += [(used, own[goes], depth + 1, low, lower), (used + 1, own[~goes], depth + 1, upper, high)]
            used += 2
    return Forest(feature, value, left, right, length, rows, usual)


_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [statistics(t.as_py().encode()) for t in b.column(1)]
        counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
        ratios = np.array([r for _, r in found], float).reshape(-1, len(RATIOS))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, counts.T), *map(pa.array, ratios.T)], ["doc_id", *COUNTS, *RATIOS])


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).mapInArrow(_measure, _STATS)


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEAT_PERCENT * n_words)


def _with_score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in RATIOS]) if b.num_rows else np.zeros((0, len(RATIOS)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.scores(x))], [*b.schema.names, "score"])

    return run


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    return stats.mapInArrow(_with_score(forest), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", score double")


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Forest | None:
    """The forest with its cut, or None when no document is labelled.

    The usual values come from at most ``max_rows`` rows of each label, chosen by the hash of their
    id; the trees grow on the good ones.  The cut is the score that best separates all labelled rows which pass the base rules; one good row lost
    weighs as much as REJECT_COST bad rows kept.
    """
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    known = written(stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marked, "doc_id").select("doc_id", "good", *RATIOS), "labelled")
    good, bad = (np.array([tuple(r) for r in known.filter(which).orderBy(F.xxhash64("doc_id"), *RATIOS).limit(max_rows).select(*RATIOS).collect()],
                          float).reshape(-1, len(RATIOS)) for which in ("good", "not good"))
    if not len(good):
        return None
    forest = grow(good, bad)
    bins = score(known, forest).groupBy(F.floor(F.col("score") * SCORE_BINS).alias("bin"), "good").count().collect()
    counts = np.zeros((2, SCORE_BINS + 2))
    for r in bins:
        counts[int(r["good"]), int(r["bin"]) + 1] += r["count"]
    # At place k: the share of rows of each label with a bin of k or more.
    above = counts[:, ::-1].cumsum(1)[:, ::-1] / np.maximum(counts.sum(1, keepdims=True), 1)
    gain = above[0] - REJECT_COST * above[1]
    forest.cut = (len(gain) - 1 - int(np.argmax(gain[::-1])) - 1) / SCORE_BINS
    return forest


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null or empty text has no words and fails the base rules.  Repeated rows get equal rows; rows
    without an id are judged like others but never serve as labelled rows.  Without labelled rows
    the base rules decide alone and the score is 0.  Other columns are ignored.
    """
    stats = written(rule_statistics(docs, id_col, text_col), "rule-stats")
    forest = fit(stats, labels)
    scored = score(stats, forest) if forest else stats.withColumn("score", F.lit(0.0))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") < (forest.cut if forest else 2.0))).alias("kept"), "score")


def _keep(forest: Forest | None, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics((t.as_py() or "").encode()) for t in b.column(place)]
            kept = np.array([not base_failed(c[0], c[4]) for c, _ in found], bool)
            if forest and len(found):
                kept &= forest.scores(np.array([r for _, r in found])) < forest.cut
            yield b.filter(pa.array(kept))

    return run


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, with all their columns."""
    forest = fit(written(rule_statistics(docs, id_col, text_col), "rule-stats"), labels)
    return docs.mapInArrow(_keep(forest, docs.columns.index(text_col)), docs.schema)
