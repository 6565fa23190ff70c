"""Quality classifier: a generalised additive model with pairwise interactions (operator 10).

Every feature is cut into bins.  Boosting visits the features in turn; each visit fits a shallow
tree to the residuals over the bins of one feature and adds a small step of it to that feature's
lookup table.  Then the pairs of features that explain most of what is left get tables of their
own in the same way.  A score is the sum of looked-up values, added for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import COUNTS, RATIOS, rule_statistics

#: Labelled rows the model may be fitted on: the bound of what reaches the driver.
MAX_FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 4
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
#: Keeps leaves of few rows near zero.
SHRINK = 10.0
FOLDS = 5
THRESHOLD = 0.3
FEATURES = ["log_words", "chars_per_word", *RATIOS]


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: one of five by the checksum of the id; rows without an id are none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _matrix(columns: dict[str, np.ndarray]) -> np.ndarray:
    words = columns["n_words"]
    return np.column_stack([np.log1p(words), columns["word_chars"] / np.maximum(words, 1), *(columns[c] for c in RATIOS)])


@dataclass
class Additive:
    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse(b[:, i], self.edges[i]), coarse(b[:, j], self.edges[j])]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(edges) + 1)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient sums g and weights h."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl ** 2 / (hl + SHRINK) + (g.sum() - gl) ** 2 / (h.sum() - hl + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value per bin of a tree of that depth over one feature's bins."""
    gain, cut = _best_cut(g, h)
    if depth == 0 or gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + SHRINK))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over a grid: one cut of the first feature, then one of the second on either side."""
    best, values = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + SHRINK)
    for cut in range(1, len(g)):
        gain, parts = -total, []
        for a, b in ((0, cut), (cut, len(g))):
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            more, at = _best_cut(gs, hs)
            gain += gs.sum() ** 2 / (hs.sum() + SHRINK) + max(more, 0)
            parts.append(np.tile(shallow_tree(gs, hs, 1) if more > 0 else np.full(len(gs), gs.sum() / (hs.sum() + SHRINK)), (b - a, 1)))
        if gain > best:
            best, values = gain, np.concatenate(parts)
    return best, values


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges])
    b, z = model.bins(x), np.full(len(x), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = residuals()
            step = RATE * shallow_tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)))
            table += step
            z += step[b[:, f]]
    cells = {(i, j): coarse(b[:, i], edges[i]) * PAIR_BINS + coarse(b[:, j], edges[j]) for i, j in combinations(range(x.shape[1]), 2)}
    size = PAIR_BINS * PAIR_BINS

    def tree(at: np.ndarray) -> tuple[float, np.ndarray]:
        g, h = residuals()
        return pair_tree(np.bincount(at, g, size).reshape(PAIR_BINS, -1), np.bincount(at, h, size).reshape(PAIR_BINS, -1))

    model.pairs = sorted(cells, key=lambda p: -tree(cells[p])[0])[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for p, table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * tree(cells[p])[1]
            table += step
            z += step.ravel()[cells[p]]
    return model


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Additive | None:
    """Learned from at most ``max_rows`` labelled rows outside the held-out fold, chosen by the hash of their id."""
    marked = labels.filter("doc_id is not null and quality is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    columns = ["n_words", "word_chars", *RATIOS]
    rows = stats.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), *columns).limit(max_rows).select("y", *columns).collect()
    if not rows:
        return None
    data = np.array([tuple(r) for r in rows], float)
    return fit_additive(_matrix(dict(zip(columns, data[:, 1:].T, strict=True))), data[:, 0])


def _with_score(model: Additive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix({c: b.column(c).to_numpy(zero_copy_only=False) for c in [*COUNTS, *RATIOS]})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Null and empty texts are scored from statistics that are all zero.  Repeated rows get equal
    rows; a row without an id is not held out and never learned from.  Without labelled rows each
    score is 0.5.  An empty table gives an empty result; other columns are ignored.
    """
    stats = written(rule_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels)
    scored = stats.mapInArrow(_with_score(model), "doc_id long, score double") if model else stats.select("doc_id", F.lit(0.5).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
