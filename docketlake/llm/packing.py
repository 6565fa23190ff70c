"""Packing of token sequences by best-fit decreasing (operator 8).

Tokenising cuts a document into full windows and one shorter rest.  Full windows are sequences of
their own.  The rests are dealt evenly into groups of a fixed size; each group places its rests
longest first, and a segment tree over remaining capacity finds the tightest window that is still
open.  Only lengths travel; the token ids stay where they were made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, row_groups, stable_row_hash, texts, written

WINDOW = 4096
END_ID = 2
#: Rests that one group places together.
GROUP_ROWS = 16_384
#: Words of each of two generations whose ids a Python worker remembers (about 230 bytes a word); two workers share an executor with its heap.
CACHED_WORDS = 150_000
#: Words that are encoded in one call.
ENCODED_WORDS = 256
#: Windows before the first window of the next group.
_GROUP_STRIDE = 1 << 32

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = _PIECES + ", sequence_id long, offset long"
_cache: dict[str, TwoGenerations] = {}


class WordIds:
    """Token ids of a text as little-endian unsigned 32-bit bytes, word by word.

    For tokenizers that drop white space before they look for tokens: ids of a text are the ids of
    its ASCII-blank separated parts.  Parts seen before come from a bounded cache; when its young
    generation is full it becomes the old one, from which parts that are seen again come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _cache.setdefault(path, TwoGenerations(CACHED_WORDS))

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Words are encoded as one text, which costs less than one by one; the place where a token starts tells its word."""
        found: list[bytes] = []
        for i in range(0, len(words), ENCODED_WORDS):
            part = [w.decode() for w in words[i:i + ENCODED_WORDS]]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, at = np.array(e.ids, "<u4").tobytes(), np.array([start for start, _ in e.offsets], np.int64)
            cut = (4 * np.searchsorted(at, np.cumsum([0] + [len(w) + 1 for w in part]))).tolist()
            found += [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return found

    def ids(self, text: bytes) -> bytes:
        return self.known.joined(text.split(), self._encode)


def _cut(path: str, window: int, end_id: int):
    """Arrow batches of (doc_id, text) -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode.ids(text.as_py().encode()) + end
                n = len(ids) // 4
                rows += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s:4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class OpenWindows:
    """Open windows by remaining capacity.  The tree's leaves count the windows of each capacity; a node sums its children."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.of: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.of[capacity].append(window)
            self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest capacity of at least ``least``, taken out."""
        i = least + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up to the first right neighbour that holds a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.of[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 .. window); longest first, into the tightest open window."""
    place, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    free = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity, w = free.take(n) or (window, opened)
        opened += w == opened
        place[i], offset[i] = w, window - capacity
        free.put(capacity - n, w)
    return place, offset


def _place(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        place, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) + 1) * _GROUP_STRIDE + place, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file that drops white space.  A null or empty text
    is the end id alone.  Repeated rows and rows without an id are packed like any other.  Ids of
    sequences are unique, with gaps.  An empty table gives an empty result; other columns are
    ignored.
    """
    pieces = written(texts(docs, id_col, text_col).mapInArrow(_cut(tokenizer, window, end_id), _PIECES), "pieces")
    full = pieces.filter(F.col("length") == window).select("*", F.monotonically_increasing_id().alias("_n"))
    # Full windows take negative ids, groups positive ones.
    full = full.select(*pieces.columns, (-F.col("_n") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < window)
    rest = rest.withColumn("_group", F.pmod(stable_row_hash(), F.lit(row_groups(rest, GROUP_ROWS))))
    return full.unionByName(rest.groupBy("_group").applyInPandas(_place(window), _PLACED))
