"""Removal of repeated byte strings with bucket-pointer refinement (operator 2).

Suffixes start in buckets by their first 32 bytes.  Where a bucket holds different texts, the
identifiers of its suffixes are refined to 64, 128, 256 and 400 bytes: the identifier at twice the
length is that of two bucket identifiers, the suffix's own and the one at the later offset, which
the step before has just refined.  Suffixes alone in their bucket leave at once.  See ``repeats``
for how suffixes are sampled and dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import Spans, Unit, covered, cut_texts, keyed, mix, repeated_intervals

WINDOW = 400
Q = 32
#: Bytes worked on at a time; longer texts are cut into overlapping parts.
PART = 1 << 18


def identifiers(text: np.ndarray, length: int = Q) -> np.ndarray:
    """Bucket identifiers of the first ``length`` bytes (8 times a power of two) at every place that has so many."""
    x = text.astype(np.uint64)
    for d in (1, 2, 4):
        x = x[:-d] | (x[d:] << np.uint64(8 * d)) if len(x) > d else x[:0]
    d = 8
    while d < length:
        x = mix(x[:-d], x[d:]) if len(x) > d else x[:0]
        d *= 2
    return x


def window_ids(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 400-byte windows at some places, from those of 32 bytes."""
    x = ids[at]
    for d in [*range(Q, WINDOW - Q + 1, Q), WINDOW - Q]:
        x = mix(x, ids[at + d])
    return x


def smallest(ids: np.ndarray) -> np.ndarray:
    """For each window, the place of the smallest 32-byte identifier in it (by its upper 42 bits, then the first)."""
    w = WINDOW - Q + 1
    x = (ids & ~np.uint64((1 << 22) - 1)) | np.arange(len(ids), dtype=np.uint64)
    d = 1
    while 2 * d <= w:
        x = np.minimum(x[:-d], x[d:])
        d *= 2
    return (np.minimum(x[:len(x) - (w - d)], x[w - d:]) & np.uint64((1 << 22) - 1)).astype(np.int64)


class Bytes(Unit):
    window = WINDOW
    group_rows = 2048

    def spans(self, texts_: list[bytes]) -> Iterator[Spans]:
        parts, size = [], 0
        for number, t in enumerate(texts_):
            for start in range(0, len(t) - WINDOW + 1, PART):
                parts.append((number, start, t[start:start + PART + WINDOW - 1]))
                size += len(parts[-1][2])
                if size >= PART:
                    yield self._of(parts)
                    parts, size = [], 0
        if parts:
            yield self._of(parts)

    def _of(self, parts: list[tuple[int, int, bytes]]) -> Spans:
        lengths = np.array([len(p[2]) for p in parts])
        offset = np.cumsum(lengths) - lengths
        joined = b"".join(p[2] for p in parts)
        ids = identifiers(np.frombuffer(joined, np.uint8))
        anchor = smallest(ids)
        # Windows that lie inside one part.
        counts = lengths - WINDOW + 1
        starts = np.arange(counts.sum()) + np.repeat(offset - np.cumsum(counts) + counts, counts)
        of = anchor[starts]
        change = np.flatnonzero(np.diff(of, prepend=-1))
        first, last = starts[change], starts[np.append(change[1:], len(starts)) - 1]
        of = of[change]
        part = np.searchsorted(offset, first, side="right") - 1
        span = mix(mix(window_ids(ids, first), window_ids(ids, last)), ((last - first) * 1024 + of - first).astype(np.uint64))
        shift = offset[part] - np.array([p[1] for p in parts])[part]
        return Spans(np.array([p[0] for p in parts])[part], ids[of], span, (first - shift).astype(np.int32), (last - shift).astype(np.int32),
                     lambda i: joined[first[i]:last[i] + WINDOW])

    def _starts(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in contents], np.int64)
        counts = lengths - WINDOW + 1
        row = np.repeat(np.arange(len(contents)), counts)
        return row, np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(counts) + counts, counts)

    def windows(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        row, at = self._starts(contents)
        return row, window_ids(identifiers(np.frombuffer(b"".join(contents), np.uint8)), at)

    def totals(self, contents: list[bytes], values: np.ndarray) -> list[np.ndarray]:
        row, at = self._starts(contents)
        ids, depth = identifiers(np.frombuffer(b"".join(contents), np.uint8)), Q
        alive = np.arange(len(at))
        while True:
            own = ids[at[alive]]
            order = np.argsort(own, kind="stable")
            same = np.zeros(len(order), bool)
            equal = own[order][1:] == own[order][:-1]
            same[1:] |= equal
            same[:-1] |= equal
            alive = np.sort(alive[order[same]])
            if depth == WINDOW or not len(alive):
                break
            step = min(depth, WINDOW - depth)
            ids = mix(ids[:-step], ids[step:])
            depth += step
        out = values[row].copy()
        if len(alive):
            _, group = np.unique(ids[at[alive]], return_inverse=True)
            out[alive] = np.bincount(group, values[row[alive]])[group].astype(np.int64)
        return np.split(out, np.cumsum(np.bincount(row, minlength=len(contents)))[:-1])

    def merged(self, value: str) -> Column:
        return F.sum(value)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, cuts in zip(b.column(1), b.column(2), strict=True):
            t = text.as_py().encode()
            gone = covered(len(t), cuts.as_py())
            rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
            rows.append((len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) > 0)), hashlib.sha256(rest).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that a 400-byte string covers which also starts anywhere else; all of
    them, the first one too.  A null text is empty; texts under 400 bytes stay whole.  Repeated
    rows repeat each other; rows without an id count like others.  An empty table gives an empty
    result; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    cuts = repeated_intervals(rows, Bytes(), F.count(F.lit(1)), F.col("value") > 1, lambda total, doc: total > 1)
    return cut_texts(rows, cuts, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
