"""Toxicity categories by a classifier chain (operator 7).

The vocabulary is chosen by how much more often labelled toxic documents hold a word, or the
beginning of a word, than others.  Linear models then follow one another: insult, contempt, other
abuse, toxic at all.  Each later model also sees the probabilities of the earlier ones; while it is
trained these come from models that have not seen the row (out of fold).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .quality_model import held_out

#: Labelled rows that models are fitted on, and entries of the vocabulary: the bounds of what reaches the driver.
MAX_FIT_ROWS, MAX_VOCABULARY = 20_000, 2048
#: A vocabulary entry occurs in at least so many of the fitted rows.
LEAST_ROWS = 5
#: ... and stands out towards toxic rows by at least so much.
LEAST_WEIGHT = 8.0
FOLDS = 5
STEPS, STEP, DECAY = 300, 0.5, 1e-4
THRESHOLD = 0.5
PREFIXES = (4, 5)
# Words that tell the categories of a row labelled as toxic; rows with none of them are other abuse.
CATEGORY_WORDS = {
    "insult": ["idiot", "moron", "loser", "clown", "stupid", "fool", "dumb"],
    "contempt": ["scum", "trash", "worthless", "pathetic", "disgusting", "garbage", "vermin"],
}
CHAIN = ["insult", "contempt", "other", "toxic"]

_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Different lower-case words, and their first letters (marked by a trailing star)."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            seen[toxic].update(terms(text.as_py()))
        for toxic, c in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([n * (1 - toxic) for n in c.values()], pa.int64()), pa.array([n * toxic for n in c.values()], pa.int64())],
                                             ["term", "other", "toxic"])


def vocabulary(sample: DataFrame) -> list[str]:
    """The terms whose share of toxic rows stands out most: the largest log-likelihood ratio towards toxic rows."""
    n = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, n = (n["t"] or 0), n["n"]
    counted = sample.select("text", "toxic").mapInArrow(_count_terms, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t"))
    share, rate = (F.col("t") + 0.5) / (t + 1.0), (F.col("o") + 0.5) / (n - t + 1.0)
    ranked = counted.filter((F.col("t") + F.col("o") >= LEAST_ROWS) & (share > rate)).withColumn("weight", F.col("t") * F.log(share / rate) + F.col("o") * F.log(rate / share))
    return [r["term"] for r in ranked.filter(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "term").limit(MAX_VOCABULARY).select("term").collect()]


def _present(vocab: dict[str, int], text: str) -> list[int]:
    return sorted({vocab[t] for t in terms(text) if t in vocab})


@dataclass
class Linear:
    """Logistic regression over present terms and the chain's earlier logits."""

    bias: float
    weights: np.ndarray
    chained: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return self.bias + np.bincount(row, self.weights[term], len(earlier)) + earlier @ self.chained


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row: np.ndarray, term: np.ndarray, earlier: np.ndarray, y: np.ndarray, size: int) -> Linear:
    """Adagrad steps over all rows; the two classes weigh alike."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    model = Linear(0.0, np.zeros(size), np.zeros(earlier.shape[1]))
    past = [1e-8, np.full(size, 1e-8), np.full(earlier.shape[1], 1e-8)]
    for _ in range(STEPS):
        d = (_probability(model.logits(row, term, earlier)) - y) * weight
        slopes = [d.sum(), np.bincount(term, d[row], size) + DECAY * model.weights, earlier.T @ d + DECAY * model.chained]
        past = [p + g * g for p, g in zip(past, slopes, strict=True)]
        moves = [STEP * g / np.sqrt(p) for p, g in zip(past, slopes, strict=True)]
        model.bias, model.weights, model.chained = model.bias - moves[0], model.weights - moves[1], model.chained - moves[2]
    return model


@dataclass
class Chain:
    vocab: dict[str, int]
    models: list[Linear]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.array([t for r in rows for t in r], np.int64)
        out = np.zeros((len(rows), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = _probability(m.logits(row, term, out[:, :k]))
        return out


def fit_chain(vocab: dict[str, int], rows: list[list[int]], targets: np.ndarray, fold: np.ndarray) -> Chain:
    n, size = len(rows), len(vocab)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    term = np.array([t for r in rows for t in r], np.int64)
    unseen, models = np.zeros((n, 0)), []
    for k in range(targets.shape[1]):
        p = np.zeros(n)
        for f in range(FOLDS):
            train, rest = fold != f, fold == f
            place = np.cumsum(train) - 1
            m = fit_linear(place[row[train[row]]], term[train[row]], unseen[train], targets[train, k], size)
            p[rest] = _probability(m.logits(row, term, unseen))[rest]
        models.append(fit_linear(row, term, unseen, targets[:, k], size))
        unseen = np.column_stack([unseen, p])
    return Chain(vocab, models)


def category_targets(texts_: list[str], toxic: np.ndarray) -> np.ndarray:
    """Columns of CHAIN for labelled rows: which of the category words a toxic row holds."""
    words = [set(_WORDS.findall(t.lower())) for t in texts_]
    named = [toxic & np.array([not w.isdisjoint(v) for w in words], int) for v in CATEGORY_WORDS.values()]
    return np.column_stack([*named, toxic & ~np.any(named, axis=0), toxic]).astype(float)


def _sample_rows(batches: Iterator[pa.RecordBatch], vocab: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [t.as_py() for t in b.column("text")]
        targets = category_targets(found, np.array(b.column("toxic").to_pylist(), int)) if found else np.zeros((0, len(CHAIN)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_present(vocab, t) for t in found], pa.list_(pa.int32())), *(pa.array(c) for c in targets.T)],
                                         ["doc_id", "terms", *CHAIN])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Chain | None:
    """Learned from at most ``max_rows`` labelled rows outside the held-out fold, chosen by the hash of their id; None without toxic and other rows."""
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id")).limit(max_rows)
    # At most max_rows ids of 12 bytes are broadcast.  Of rows with one id the smallest text is taken.
    sample = written(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-sample")
    vocab = {t: i for i, t in enumerate(vocabulary(sample))}
    rows = sample.mapInArrow(lambda batches: _sample_rows(batches, vocab), "doc_id long, terms array<int>, " + ", ".join(f"{c} double" for c in CHAIN)).orderBy("doc_id").collect()
    targets = np.array([[r[c] for c in CHAIN] for r in rows], float).reshape(-1, len(CHAIN))
    if not len(rows) or targets[:, -1].min() == targets[:, -1].max():
        return None
    return fit_chain(vocab, [r["terms"] for r in rows], targets, np.arange(len(rows)) % FOLDS)


def _with_probabilities(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities([_present(chain.vocab, t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in p.T)], ["doc_id", *(f"p_{c}" for c in CHAIN)])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, p_insult, p_contempt, p_other, p_toxic, toxic (p_toxic >= THRESHOLD).

    A null or empty text has no terms and gets the lowest probabilities.  Repeated rows get equal
    rows; a row without an id is scored like others and never learned from.  Without labelled rows
    of both kinds every probability is 0.  An empty table gives an empty result; other columns are
    ignored.
    """
    chain, rows = fit(docs, labels, id_col, text_col), texts(docs, id_col, text_col)
    names = [f"p_{c}" for c in CHAIN]
    if chain is None:
        scored = rows.select("doc_id", *[F.lit(0.0).alias(n) for n in names])
    else:
        scored = rows.mapInArrow(_with_probabilities(chain), "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), *names, (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
