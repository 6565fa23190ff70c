"""Near-duplicate groups by SimHash with bit-sliced comparison (operator 1).

Different fingerprints are bucketed on every pair of six blocks of their bits: two fingerprints
within four bits agree in at least two blocks, so no link is lost.  Inside a bucket the bits are
stored as vertical planes, 64 fingerprints to a word; carry-save adders count the differing bits
of a whole word at once, and a word is abandoned as soon as all its lanes exceed the radius.  A
crowded bucket is cut into blocks that are compared pairwise.  Each comparison returns a spanning
forest, never all pairs; components are joined by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .similar import marks_and_links

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: First bit and width of the blocks; two of them make a bucket key.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints of one side of a comparison.
BLOCK_ROWS = 4096
#: (fingerprint, word) pairs compared at a time.
PAIRS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64 bits; a bit is set when more than half of the shingle hashes have it.  No words: 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)), "<u8", len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        counts += np.unpackbits(h[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py().encode()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text that tells rows of one id apart, and the fingerprint as a signed long."""
    return texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all fingerprints, 64 to a word; the last word is filled up with zeros."""
    padded = np.zeros(-(-max(len(fps), 1) // 64) * 64, "<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits per lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_lanes(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a fingerprint and a word of 64 others: the pairs that are left, and their lanes within RADIUS (4) bits.

    Per lane, ones, twos and fours count differing bits modulo 8 and ``over`` remembers a carry
    out of them; after every eight planes words without a lane within the radius are dropped.
    """
    at = np.arange(len(query))
    ones, twos, fours, over = (np.zeros(len(query), np.uint64) for _ in range(4))
    for first in range(0, 64, 8):
        x = [planes[b, word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1))) for b in range(first, first + 8)]
        ones, t1 = _add(ones, x[0], x[1])
        ones, t2 = _add(ones, x[2], x[3])
        twos, f1 = _add(twos, t1, t2)
        ones, t1 = _add(ones, x[4], x[5])
        ones, t2 = _add(ones, x[6], x[7])
        twos, f2 = _add(twos, t1, t2)
        fours, e = _add(fours, f1, f2)
        over |= e
        lanes = lanes & ~(over | (fours & (ones | twos)))
        left = lanes != 0
        if not left.all():
            at, query, word, lanes, ones, twos, fours, over = (v[left] for v in (at, query, word, lanes, ones, twos, fours, over))
    return at, lanes


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of the linked nodes; labels point to the smallest node of a component."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def link_units(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many comparisons at once: ``left`` with ``right``, or with itself where ``right`` is empty."""
    own = np.array([len(r) == 0 for r in right])
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    queries, others = np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*(x if o else r for x, r, o in zip(left, right, own, strict=True)), np.zeros(0, np.uint64)])
    # Lane numbers of each comparison, and of each query that is itself a lane.
    n_lanes = np.where(own, n_left, n_right)
    end = np.cumsum(n_lanes)
    unit = np.repeat(np.arange(len(left)), n_left)
    place = np.arange(len(queries)) - np.repeat(np.cumsum(n_left) - n_left, n_left)
    first = np.where(own[unit], (end - n_lanes)[unit] + place + 1, (end - n_lanes)[unit])  # each pair once
    last = end[unit]
    planes = bit_planes(others)
    n_words = np.where(first < last, (last - 1) // 64 - first // 64 + 1, 0)
    ends = np.cumsum(n_words)
    # Nodes: lanes first, then the queries that are no lanes.
    query_node = np.where(own[unit], first - 1, len(others) + np.arange(len(queries)))
    label = np.arange(len(others) + len(queries))
    for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
        pair = np.arange(start, min(start + PAIRS_AT_ONCE, int(ends[-1])))
        q = np.searchsorted(ends, pair, side="right")
        w = first[q] // 64 + pair - (ends - n_words)[q]
        low, high = np.maximum(first[q] - 64 * w, 0).astype(np.uint64), np.minimum(last[q] - 64 * w, 64).astype(np.uint64)
        lanes = (~np.uint64(0) << low) & (~np.uint64(0) >> (np.uint64(64) - high))
        at, lanes = near_lanes(planes, queries[q], w, lanes)
        i, bit = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        label = merge(label, query_node[q[at[i]]], 64 * w[at[i]] + bit)
    values = np.concatenate([others, queries])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        def lists(c: pa.ListArray) -> list[np.ndarray]:
            flat, ends = c.flatten().to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()
            return np.split(flat, (ends[1:-1] - ends[0])) if len(c) else []

        x, y = link_units(lists(b.column(0)), lists(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints within RADIUS of one another; ``fps`` holds each once."""
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    keys = [F.struct(F.lit(i * 8 + j).alias("band"), F.shiftleft(block[i], 11).bitwiseOR(block[j]).alias("key")) for i, j in combinations(range(len(BLOCKS)), 2)]
    banded = fps.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.*")
    crowd = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    parts = F.ceil(F.col("_n") / BLOCK_ROWS)
    members = banded.join(crowd, ["band", "key"]).select("band", "key", "fp", F.pmod(F.xxhash64("fp", "band"), parts).alias("_own"), parts.alias("_parts"))
    units = members.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other")).select(
        "band", "key", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "fp", "_own")
    grouped = units.groupBy("band", "key", "_lo", "_hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("_own") == F.col("_lo"), F.col("fp")))).alias("left"),
        F.sort_array(F.collect_list(F.when((F.col("_own") == F.col("_hi")) & (F.col("_lo") < F.col("_hi")), F.col("fp")))).alias("right"))
    return grouped.select("left", "right").mapInArrow(_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node per linked node, as (node, root), by large-star and small-star steps.

    Each step is written to the shared folder.  A node's neighbours are only aggregated and
    joined; as the aggregates are written first, both sides of a join come from plain shuffles,
    and a node with very many neighbours is split like any skewed key.
    """
    stars = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large-stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = written(small.select("e.*").filter("u <> v").distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("_first")), "different-fingerprints")
    return _named(marked, first, components(close_links(first.select("fp"))))


def _named(marked: DataFrame, first: DataFrame, roots: DataFrame) -> DataFrame:
    """The marked rows with the root of their component and its smallest id."""
    # Only linked fingerprints take part below; all others are components of their own.
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()).join(first, "fp")
    smallest = linked.groupBy("root").agg(F.min("_first").alias("_smallest"))
    # Written, so that the last join reads both sides from plain shuffles and a fingerprint of very many rows can be split.
    known = written(first.join(linked.join(smallest, "root").select("fp", "root", "_smallest"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("_first")).otherwise(F.col("_smallest")).alias("component_id")), "known-fingerprints")
    return marked.join(known, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    The component is named by the smallest id that is reachable over links of at most RADIUS
    bits.  A null, empty or blank text has fingerprint zero and links like any other.  A component
    in which no row has an id has a null name.  Repeated rows share their component.  An empty
    table gives an empty result; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns; of rows equal in id and text one stays.

    Texts are linked when the Jaccard similarity of their five-word shingles is at least 0.8: first
    those whose fingerprints over these shingles ``close_links`` finds, if the shingles confirm them,
    then all pairs of different components that the radius does not reach (``similar``).
    """
    found = _named(*marks_and_links(docs, id_col, text_col, components, close_links)).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A component may hold several texts under its smallest id.
    kept = found.groupBy("root", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
    kept = rows.alias("r").join(kept.alias("k"), F.expr("r.root = k.root and r.doc_id <=> k.doc_id and r.text_hash = k.text_hash")).select(
        F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"), "_rows")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_own_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_own"))
    joined = own.join(kept, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    single = joined.filter("_rows = 1").select("_row.*")
    repeated = joined.filter("_rows > 1").groupBy("_id", "_hash").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(repeated)
