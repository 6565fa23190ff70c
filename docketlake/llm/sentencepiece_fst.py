"""SentencePiece encoding and decoding as weighted finite-state transduction (operator 5).

Three transducers are compiled from a model file: the normaliser (a blank before the text, blanks
become the piece mark), the pieces, and byte fallback for characters without a piece.  They are
composed with each input, lazily: a state is a position and the last piece, an arc reads one piece.
The path of least weight in the tropical semiring (weights add along a path, the least path wins)
gives the ids.

The model is a byte-pair model, whose result is not the path of best scores.  It is known, however,
which pieces may stand side by side: exactly those pairs that merging their joint characters gives
back.  An arc therefore weighs nothing after a piece it may follow, and infinitely much after any
other; exactly one path stays finite, and it is the merge result.

No piece goes on across a piece mark, nor over an ASCII character that no piece holds; so a text
falls apart into segments there.  A segment falls apart further between characters that stand side by
side in no piece.  Each different part is composed once per worker.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, texts

MARK = "▁"
#: Segments of each of two generations that a Python worker remembers; longer ones are composed each time.
CACHED_SEGMENTS, CACHED_LENGTH = 400_000, 64
#: The same for the parts of segments.
CACHED_PARTS = 200_000
#: Pairs of pieces whose weight a Python worker remembers.
CACHED_PAIRS = 1_000_000
_START, _BYTES = -1, -2
_compiled: dict[str, Transducer] = {}
DECODED = "doc_id long, text_sha256 string, n_tokens long, ids_crc32 long, text string"


class Transducer:
    """The compiled transducers of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.joints = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Acceptor of the pieces: beginnings of pieces, with the id where one ends (-1: none).
        self.arcs = dict.fromkeys((p[:k] for p in self.ids for k in range(1, len(p))), -1) | self.ids
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on across a mark are not supported")
        held = set("".join(self.ids))
        lone = "".join(c for c in map(chr, range(128)) if c not in held and c != " ")
        self.segments = re.compile(f"[{re.escape(lone)}]|{MARK}*[^{MARK}{re.escape(lone)}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.output = [bytes([bytes_of[i]]) if i in bytes_of else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.known, self.parts = TwoGenerations(CACHED_SEGMENTS), TwoGenerations(CACHED_PARTS)

    def merged(self, text: str) -> list[str]:
        """Characters merged by the best score, the leftmost first among equals."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
        return parts

    def follows(self, last: int, piece: int) -> bool:
        """Whether the arc of ``piece`` has a finite weight after ``last``."""
        if last < 0:
            return True
        key = last * len(self.pieces) + piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.pieces[last] + self.pieces[piece]) == [self.pieces[last], self.pieces[piece]]
        return ok

    def shortest(self, segment: str) -> list[int]:
        """Ids on the only path of finite weight through the composition with one segment.

        Relaxes states in order of position.  ``back[i]`` maps the last piece of each finite path
        to position i onto the state before it.
        """
        n, ids, arcs, pairs, size = len(segment), self.ids, self.arcs, self.pairs, len(self.pieces)
        if n == 1 and segment in ids:
            return [ids[segment]]
        back: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        back[0][_START] = (0, _START)
        for i in range(n):
            here = back[i]
            if not here:
                continue
            if segment[i] not in ids:  # byte fallback: a character of its own, after anything
                back[i + 1][_BYTES] = (i, next(iter(here)))
                continue
            for j in range(i + 1, n + 1):
                piece = arcs.get(segment[i:j])
                if piece is None:
                    break
                if piece < 0 or (i == 0 and j == n and self.merged(segment) != [segment]):
                    continue
                for last in here:
                    ok = pairs.get(last * size + piece) if last >= 0 else True
                    if self.follows(last, piece) if ok is None else ok:
                        back[j][piece] = (i, last)
                        break
        out: list[int] = []
        at, last = n, next(iter(back[n]))
        while at:
            i, before = back[at][last]
            out += [self.byte_ids[b] for b in reversed(segment[i:at].encode())] if last == _BYTES else [last]
            at, last = i, before
        return out[::-1]

    def _composed(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self.shortest, parts)]

    def _encoded(self, segments: list[str]) -> list[bytes]:
        """Each segment from its parts."""
        out, joints = [], self.joints
        for s in segments:
            cuts = [0, *(i for i in range(1, len(s)) if s[i - 1:i + 1] not in joints), len(s)]
            parts = [s[a:b] for a, b in zip(cuts, cuts[1:])]
            out.append(self.parts.joined(parts, self._composed) if len(s) <= CACHED_LENGTH else b"".join(self._composed(parts)))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts = self.segments.findall(MARK + text.replace(" ", MARK))
        if max(map(len, parts)) <= CACHED_LENGTH:
            return self.known.joined(parts, self._encoded)
        return b"".join(self.known.joined([p], self._encoded) if len(p) <= CACHED_LENGTH else self._encoded([p])[0] for p in parts)

    def decode(self, ids: list[int]) -> str:
        """Output side of the pieces; bytes that are no UTF-8 become replacement characters, the blank before the text goes."""
        return b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in batches:
        ids = [t.encode(x.as_py()) for x in b.column(1)]
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "text_sha256", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in batches:
        rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
             pa.array([t.decode(r.tolist()) for r in rows], pa.string())], ["doc_id", "text_sha256", "n_tokens", "ids_crc32", "text"])


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Both directions in one Python worker, so that not each core has two workers with the compiled model and its caches."""
    yield from _decode(_encode(batches, path), path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 and the ids of each text under the SentencePiece model file ``model``.

    A null or empty text has no ids.  Repeated rows and rows without an id are encoded like any
    other.  An empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col).withColumn("text_sha256", F.sha2("text", 256))
    return rows.mapInArrow(partial(_encode, path=model), "doc_id long, text_sha256 string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text_sha256, n_tokens, ids_crc32 (unsigned, of little-endian 32-bit ids) and the decoded text of rows of ``encode``; null ids give an empty text."""
    return encoded.select("doc_id", "text_sha256", "ids").mapInArrow(partial(_decode, path=model), DECODED)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, text_sha256, decoded_sha256, same (decoding gave the text back).

    A text that holds the piece mark itself comes back with a blank in its place.
    """
    rows = texts(docs, id_col, text_col).withColumn("text_sha256", F.sha2("text", 256))
    decoded = rows.mapInArrow(partial(_round_trip, path=model), DECODED)
    return decoded.select("doc_id", "n_tokens", "ids_crc32", "text_sha256", F.sha2("text", 256).alias("decoded_sha256")).withColumn("same", F.col("text_sha256") == F.col("decoded_sha256"))
