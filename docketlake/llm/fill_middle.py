"""Fill-in-the-middle transformation by block rotation in place (operator 11).

A text is taken as UTF-8 bytes.  The cuts, given in code points, are scanned for in the bytes; the
sentinels are put in front of the three segments in one bytearray, ``P prefix M middle S suffix``,
and the segments change places by rotations of three reversals each: the tail (middle, suffix) for
``psm``, the whole for ``spm``.  Reversals swap blocks of fixed size from both ends, so nothing but
the bytearray grows with the text.  ``restore`` finds the sentinels, rotates back and takes them out.

Row work only: no shuffle, no state between rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Bytes that a reversal swaps at a time.
BLOCK = 1 << 16
#: Bytes of text after which a batch of results is handed on.
YIELD_BYTES = 1 << 22


@dataclass(frozen=True)
class Plan:
    """The sentinels and how often each form is taken, in percent.

    No sentinel may hold another one or begin with the end of one: then the first match of a
    sentinel in an output is always the one that was put there.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_from: int = 90
    spm_below: int = 20
    seed: int = 1

    def __post_init__(self):
        marks = self.marks
        for a in marks:
            for b in marks:
                inside = a is not b and a in b
                if not a or inside or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can be mistaken for each other")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()

    def draws(self, doc_id: int) -> list[int]:
        """Four numbers below 2^32 that depend on the id alone."""
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).digest()
        return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def reverse(view: np.ndarray, begin: int, end: int) -> None:
    """Reverse the bytes of ``view`` between two places, a block from each end at a time."""
    while end - begin > 1:
        n = min(BLOCK, (end - begin) // 2)
        left = view[begin:begin + n].copy()
        view[begin:begin + n] = view[end - n:end][::-1]
        view[end - n:end] = left[::-1]
        begin, end = begin + n, end - n


def rotate(buffer: bytearray, begin: int, split: int, end: int) -> int:
    """Exchange the neighbours [begin, split) and [split, end); returns where they now meet."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, begin, split)
    reverse(view, split, end)
    reverse(view, begin, end)
    return begin + end - split


def scan_cuts(text: bytes, cuts: list[int], chars: int) -> list[int]:
    """The byte places of some code point places (ascending)."""
    if chars == len(text):
        return cuts
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(begins[c]) if c < chars else len(text) for c in cuts]


def arrange(text: bytes, first: int, second: int, form: str, plan: Plan) -> bytearray:
    """The text with its segments, cut at two byte places, in the order of ``form``."""
    p, s, m = plan.marks
    out = bytearray(text)
    out[second:second] = s
    out[first:first] = m
    out[0:0] = p
    at_m = len(p) + first
    at_s = at_m + len(m) + second - first
    rotate(out, 0 if form == "spm" else at_m, at_s, len(out))
    return out


def rearrange(output: bytes, form: str, plan: Plan) -> bytearray:
    """The text that ``arrange`` was given, from its result and the form."""
    p, s, m = plan.marks
    out = bytearray(output)
    if form == "spm":
        begin, met = 0, out.find(p, len(s))
    else:
        begin = out.find(s, len(p))
        met = out.find(m, begin + len(s))
    at_s = rotate(out, begin, met, len(out))
    at_m = out.find(m, len(p))
    del out[at_s:at_s + len(s)]
    del out[at_m:at_m + len(m)]
    del out[:len(p)]
    return out


def _transform(plan: Plan):
    def one(doc_id: int | None, text: str) -> tuple:
        raw, n = text.encode(), len(text)
        if doc_id is None or not raw or any(mark in raw for mark in plan.marks):
            return doc_id, n, "plain", None, None, text
        h1, h2, h3, h4 = plan.draws(doc_id)
        if h3 % 100 >= plan.plain_from:
            return doc_id, n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "spm" if h4 % 100 < plan.spm_below else "psm"
        return doc_id, n, form, first, second - first, arrange(raw, *scan_cuts(raw, [first, second], n), form, plan).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bounded(batches, 1):
            yield pa.RecordBatch.from_pylist([dict(zip(TRANSFORMED.names, one(r[0].as_py(), r[1].as_py()), strict=True)) for r in rows], TRANSFORMED)

    return run


def _bounded(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[tuple]]:
    """The rows of batches, in lists of bounded text size."""
    for b in batches:
        rows, size = [], 0
        for row in zip(*b.columns, strict=True):
            rows.append(row)
            size += len(row[text_at].as_buffer()) + 64
            if size >= YIELD_BYTES:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


TRANSFORMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                         ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    A null text is empty.  Texts that are empty or hold a sentinel, and rows without an id (nothing
    to draw cuts from), stay plain, as does the drawn share of the others; their two lengths are
    null.  Segments may be empty.  Equal rows give equal results.  An empty table gives an empty
    result; other columns are ignored.
    """
    return texts(docs, id_col, text_col).mapInArrow(_transform(plan), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(transformed: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``transformed`` with one more column, restored: each text rebuilt from its output and form alone."""
    names = ["output", "form"]
    others = [c for c in transformed.columns if c not in ("restored", "output")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.select(*others, "output").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            output, form = (b.column(b.schema.get_field_index(c)) for c in names)
            at = 0
            for rows in _bounded(iter([pa.RecordBatch.from_arrays([output, form], names)]), 0):
                found = [o.as_py() if f.as_py() == "plain" else rearrange(o.as_py().encode(), f.as_py(), plan).decode() for o, f in rows]
                part = b.slice(at, len(rows))
                at += len(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "restored"])

    return transformed.select(*others, "output").mapInArrow(run, f"{fields}, restored string")


_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents),
g AS (SELECT *, {_H.format(1)} % (n + 1) AS c1, {_H.format(9)} % (n + 1) AS c2,
  CASE WHEN h IS NULL OR n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= 90 THEN 'plain'
       WHEN {_H.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS p, CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS m FROM g)
SELECT doc_id, n, form, p AS prefix_chars, m AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, p + m + 1) || '<M>' || substr(t, p + 1, m)
    ELSE '<S>' || substr(t, p + m + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
