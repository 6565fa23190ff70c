"""Finding repeated windows of fixed length in a corpus; used by the byte and the word operator.

Every window of a text (400 bytes, or 13 words) has one sampled suffix start in it: the place of the
smallest q-gram identifier.  Windows of equal content have it at the same place, so windows meet on
the bucket of that q-gram and nothing is shuffled for the other places.  Neighbouring windows with
the same suffix start form a span.

1. Buckets of q-grams in which anything can repeat are found with one aggregation.
2. Their spans are gathered.  A span that repeats as a whole settles all its windows.
3. Of buckets with several different spans, each different span is taken once, with its content.
   Buckets are dealt into groups of bounded size, in which windows are compared (``Unit.totals``);
   a bucket that is larger than a group is taken apart into single windows.

Which identifiers are wanted by a later pass over the texts is told by a bit set of fixed size.  A
bit set too full only lets more candidates through; each is then joined exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Bits of a set of wanted identifiers: 8 MiB, whatever the input.
SET_BITS = 1 << 26
#: Rows of a batch that are worked on at a time.
SLICE_ROWS = 512

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    x = (a ^ (a >> np.uint64(29))) * _K1 + (b ^ (b >> np.uint64(32))) * _K2
    x ^= x >> np.uint64(31)
    x *= _K3
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Spans:
    """Spans of a batch: text number, q-gram bucket, span identifier, first and last window start, and their contents on demand."""

    text: np.ndarray
    bucket: np.ndarray
    span: np.ndarray
    first: np.ndarray
    last: np.ndarray
    content: Callable[[int], bytes]


class Unit:
    """What a window is made of, and how the windows of a group are compared."""

    window: int
    group_rows: int

    def spans(self, texts_: list[bytes]) -> Iterator[Spans]:
        raise NotImplementedError

    def windows(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row number and identifier of every window of some contents."""
        raise NotImplementedError

    def totals(self, contents: list[bytes], values: np.ndarray) -> list[np.ndarray]:
        """Per content, one total per window over all contents that hold it."""
        raise NotImplementedError

    def merged(self, value: str) -> Column:
        """How values of equal windows are added up."""
        raise NotImplementedError


def bit_set(df: DataFrame, column: str) -> np.ndarray:
    """Bits of the identifiers in ``column``, as at most SET_BITS / 64 words that are gathered on the driver."""
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(SET_BITS - 1)), 6)
    bits = df.groupBy(word.alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(SET_BITS // 64, np.uint64)
    out[bits.column("w").to_numpy()] = bits.column("b").to_numpy().view(np.uint64)
    return out


def held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & np.uint64(SET_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Few rows at a time with their texts as bytes, so that a worker never holds those of a whole batch."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(at, SLICE_ROWS)
            yield part, [t.as_py().encode() for t in part.column("text")]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def _buckets(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _slices(batches):
            for s in unit.spans(found):
                yield pa.RecordBatch.from_arrays([_signed(s.bucket), b.column("doc_id").take(pa.array(s.text))], ["bucket", "doc_id"])

    return run


def _candidates(unit: Unit, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _slices(batches):
            for s in unit.spans(found):
                k = np.flatnonzero(held(wanted.value, s.bucket))
                of = pa.array(s.text[k])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(of), b.column("text_key").take(of), pa.array(s.first[k]), pa.array(s.last[k]), _signed(s.span[k]), _signed(s.bucket[k])],
                                                 ["doc_id", "text_key", "first", "last", "span", "bucket"])

    return run


def _contents(unit: Unit, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _slices(batches):
            for s in unit.spans(found):
                k = np.flatnonzero(held(wanted.value, s.span))
                k = k[np.unique(s.span[k], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([_signed(s.span[k]), pa.array([s.content(i) for i in k.tolist()], pa.binary())], ["span", "content"])

    return run


def _group_totals(unit: Unit):
    def run(rows: pa.Table) -> pa.Table:
        found = unit.totals(rows.column("content").to_pylist(), rows.column("value").to_numpy())
        return pa.table({"span": rows.column("span"), "totals": pa.array(found, pa.list_(pa.int64()))})

    return run


def _single_windows(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE_ROWS // 2) for x in batches for at in range(0, x.num_rows, SLICE_ROWS // 2)):
            row, ids = unit.windows(b.column("content").to_pylist())
            place = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
            span, value = b.column("span").to_numpy(zero_copy_only=False), b.column("value").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(span[row]), pa.array(value[row]), pa.array(place), _signed(ids)], ["span", "value", "place", "id"])

    return run


def repeated_intervals(rows: DataFrame, unit: Unit, value: Column, can_repeat: Column, removes: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc_id, text_key, cuts): the places of each text that are covered by windows which are removed.

    ``rows`` has doc_id, text and text_key.  ``value`` aggregates the rows of a span (or bucket);
    ``can_repeat`` says of an aggregated ``value`` and ``most`` (the largest doc_id) whether anything
    is removed at all; ``removes(total, doc_id)`` decides on a window.
    """
    sc = rows.sparkSession.sparkContext
    most = F.max("doc_id").alias("most")
    # 1. Buckets in which anything can repeat.
    buckets = rows.mapInArrow(_buckets(unit), "bucket long, doc_id long").groupBy("bucket").agg(value.alias("value"), most).filter(can_repeat)
    wanted = sc.broadcast(bit_set(buckets, "bucket"))
    # 2. Their spans, and the different ones.
    spans = written(rows.mapInArrow(_candidates(unit, wanted), "doc_id long, text_key long, first int, last int, span long, bucket long"), "spans")
    different = written(spans.groupBy("span").agg(value.alias("value"), most, F.max("bucket").alias("bucket")), "different-spans")
    crowd = different.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    open_spans = written(different.join(crowd, "bucket").select("span", "bucket", "value", "crowd"), "open-spans")
    # 3. Compare the windows of different spans of one bucket.
    open_set = sc.broadcast(bit_set(open_spans, "span"))
    contents = rows.mapInArrow(_contents(unit, open_set), "span long, content binary").groupBy("span").agg(F.first("content").alias("content"))
    compared = written(contents.join(open_spans, "span"), "span-contents")
    groups = max(1, -(-compared.count() // unit.group_rows))
    dealt = compared.filter(F.col("crowd") <= unit.group_rows).withColumn("_group", F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    settled = dealt.groupBy("_group").applyInArrow(_group_totals(unit), "span long, totals array<long>")
    single = compared.filter(F.col("crowd") > unit.group_rows).select("span", "value", "content").mapInArrow(_single_windows(unit), "span long, value long, place int, id long")
    single = written(single, "single-windows")
    totals = single.groupBy("id").agg(unit.merged("value").alias("total"))
    pieces = single.join(totals, "id").groupBy("span").agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("t"))
    settled = written(settled.unionByName(pieces.select("span", F.transform("t", lambda t: t["total"]).alias("totals"))), "window-totals")
    # Spans that are removed somewhere: as a whole, or window by window.
    # Written, so that the join below reads both sides from plain shuffles and a span of very many texts can be split.
    verdicts = different.join(settled, "span", "left").filter(can_repeat | F.col("totals").isNotNull()).select("span", "value", "totals")
    found = spans.join(written(verdicts, "verdicts"), "span")
    whole = F.array(F.struct("first", (F.col("last") + unit.window).alias("end")))

    def goes(i: Column) -> Column:
        return removes(F.get("totals", i), F.col("doc_id"))

    every = F.sequence(F.lit(0), F.size("totals") - 1)
    begins = F.filter(every, lambda i: goes(i) & ~F.coalesce(goes(i - 1), F.lit(False)))
    ends = F.filter(every, lambda i: goes(i) & ~F.coalesce(goes(i + 1), F.lit(False)))
    parts = F.zip_with(begins, ends, lambda a, b: F.struct((F.col("first") + a).alias("first"), (F.col("first") + b + unit.window).alias("end")))
    cuts = F.when(F.col("totals").isNotNull(), parts).when(removes(F.col("value"), F.col("doc_id")), whole)
    return found.select("doc_id", "text_key", F.explode(cuts).alias("cut")).groupBy("doc_id", "text_key").agg(F.collect_set("cut").alias("cuts"))


def covered(size: int, cuts: list[dict] | None) -> np.ndarray:
    """Which places the cuts cover."""
    depth = np.zeros(size + 1, np.int64)
    for c in cuts or ():
        depth[c["first"]] += 1
        depth[c["end"]] -= 1
    return np.cumsum(depth[:size]) > 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one id apart."""
    return texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def cut_texts(rows: DataFrame, cuts: DataFrame, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each text together with its cuts and finish it with ``finish`` (doc_id, text, cuts -> schema).

    Texts that the bit set of cut texts rules out are finished where they lie and never shuffled.
    """
    cuts = written(cuts, "cuts")
    wanted = rows.sparkSession.sparkContext.broadcast(bit_set(cuts, "text_key"))

    def split(keep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = held(wanted.value, b.column("text_key").to_numpy(zero_copy_only=False).view(np.uint64))
                yield b.filter(pa.array(mask == keep))

        return run

    shape = "doc_id long, text string, text_key long"
    none = F.lit(None).cast(cuts.schema["cuts"].dataType).alias("cuts")
    plain = rows.mapInArrow(split(False), shape).select("doc_id", "text", none).mapInArrow(finish, schema)
    c = cuts.alias("c")
    r = rows.mapInArrow(split(True), shape).alias("r")
    both = r.join(c, F.expr("r.doc_id <=> c.doc_id and r.text_key = c.text_key"), "left").select("r.doc_id", "r.text", "c.cuts")
    return plain.unionByName(both.mapInArrow(finish, schema))
