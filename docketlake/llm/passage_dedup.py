"""Removal of passages that an earlier document holds, with prefix-partitioned suffix trees (operator 9).

Suffixes of the word sequences are split by a prefix of four words; a prefix that too many
different suffixes share is made longer, up to a whole window, so that each group fits into memory.
Each group builds its subtree from sorted suffixes and the lengths of their common prefixes; an
internal node at least a window deep is a maximal repeat, and carries the smallest document below
it.  See ``repeats`` for how suffixes are sampled and dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import Spans, Unit, covered, cut_texts, keyed, mix, repeated_intervals

WINDOW = 13
PREFIX = 4
#: Words worked on at a time; longer texts are cut into overlapping parts.
PART = 1 << 17


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def prefix_ids(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of 4 and of 13 words at every place that has so many."""
    def pair(x: np.ndarray, d: int) -> np.ndarray:
        return mix(x[:-d], x[d:]) if len(x) > d else x[:0]

    four = pair(pair(words, 1), 2)
    eight = pair(four, 4)
    return four, pair(eight, WINDOW - 8)


class Words(Unit):
    window = WINDOW
    group_rows = 16_384

    def spans(self, texts_: list[bytes]) -> Iterator[Spans]:
        parts, size = [], 0
        for number, t in enumerate(texts_):
            words = t.split()
            for start in range(0, len(words) - WINDOW + 1, PART):
                parts.append((number, start, word_hashes(words[start:start + PART + WINDOW - 1])))
                size += len(parts[-1][2])
                if size >= PART:
                    yield self._of(parts)
                    parts, size = [], 0
        if parts:
            yield self._of(parts)

    def _of(self, parts: list[tuple[int, int, np.ndarray]]) -> Spans:
        lengths = np.array([len(p[2]) for p in parts])
        offset = np.cumsum(lengths) - lengths
        joined = np.concatenate([p[2] for p in parts])
        four, windows = prefix_ids(joined)
        counts = lengths - WINDOW + 1
        starts = np.arange(counts.sum()) + np.repeat(offset - np.cumsum(counts) + counts, counts)
        inside = np.lib.stride_tricks.sliding_window_view(four, WINDOW - PREFIX + 1)
        of = starts + np.argmin(inside, axis=1)[starts]
        change = np.flatnonzero(np.diff(of, prepend=-1))
        first, last = starts[change], starts[np.append(change[1:], len(starts)) - 1]
        of = of[change]
        part = np.searchsorted(offset, first, side="right") - 1
        span = mix(mix(windows[first], windows[last]), ((last - first) * 64 + of - first).astype(np.uint64))
        shift = offset[part] - np.array([p[1] for p in parts])[part]
        return Spans(np.array([p[0] for p in parts])[part], four[of], span, (first - shift).astype(np.int32), (last - shift).astype(np.int32),
                     lambda i: joined[first[i]:last[i] + WINDOW].tobytes())

    def _starts(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(c) // 8 for c in contents], np.int64)
        counts = lengths - WINDOW + 1
        row = np.repeat(np.arange(len(contents)), counts)
        at = np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(counts) + counts, counts)
        return row, at, np.frombuffer(b"".join(contents), np.uint64)

    def windows(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        row, at, words = self._starts(contents)
        return row, prefix_ids(words)[1][at]

    def totals(self, contents: list[bytes], values: np.ndarray) -> list[np.ndarray]:
        """Smallest value below the deepest node of each suffix: leaves are suffixes cut off at a window."""
        row, at, words = self._starts(contents)
        suffix = words[at[:, None] + np.arange(WINDOW)]
        order = np.lexsort(suffix.T[::-1])
        common = (suffix[order][1:] == suffix[order][:-1]).cumprod(axis=1).sum(axis=1)  # common prefixes of neighbours
        node = np.cumsum(np.concatenate([[True], common < WINDOW])) - 1
        least = np.minimum.reduceat(values[row][order], np.flatnonzero(np.diff(node, prepend=-1)))
        out = np.empty(len(row), np.int64)
        out[order] = least[node]
        return np.split(out, np.cumsum(np.bincount(row, minlength=len(contents)))[:-1])

    def merged(self, value: str) -> Column:
        return F.min(value)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, cuts in zip(b.column(1), b.column(2), strict=True):
            words, found = text.as_py().encode().split(), cuts.as_py()
            gone = covered(len(words), found)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Every word is removed that a 13-word window covers which also starts in a document with a
    smaller id.  A null text has no words.  Rows without an id neither lose words nor count as
    earlier; rows of one id are no earlier than one another.  An empty table gives an empty
    result; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    named = rows.filter("doc_id is not null")
    cuts = repeated_intervals(named, Words(), F.min("doc_id"), F.col("value") < F.col("most"), lambda total, doc: total < doc)
    return cut_texts(rows, cuts, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
