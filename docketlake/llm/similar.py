"""Links between texts whose shingle sets are similar, without loss (near-duplicate stage of the pipeline).

Similar means a Jaccard similarity of SHARE / OF or more over different shingles of SHINGLE_WORDS
words.  At that similarity fingerprints of 64 bits differ in about ten bits, so that no radius
keeps all pairs.  SimHash comes first: fingerprints of the same shingles are linked by bit planes
(``simhash.close_links``), and links that the shingles of both confirm make components.  Between
different components, candidates are found by a bound that holds for every pair:

1. Shingles have one global order.  Two similar sets share one of the first n / 5 + 1 shingles of
   each (n: size of the set), so sets that meet on none of these are never compared.  Shingles
   that are frequent in a sample come last; the sample only decides the order, and the links are
   the same with any order.
2. Sets that meet carry SKETCH_BITS bits, the parities of their shingles per hash value.  Two
   sketches never differ in more bits than their sets differ in shingles, so pairs beyond the
   allowed difference are dropped by one comparison of words.
   Of the pairs that are left, sketches that are as wide as the sets need are compared once more.
3. Pairs that are still left are decided exactly by the shingles both have.

A crowd of near copies is not multiplied out: at first the sets of a bucket are only held against
few of them (stars).  When the components of these links are known, the pairs that still lie in
different components are held against each other; a crowd just below the threshold, whose sets
stay apart, is multiplied out there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .repeats import bit_set, held

SHINGLE_WORDS = 5
#: The least similarity, 4 / 5.
SHARE, OF = 4, 5
SKETCH_BITS = 512
#: Sets of one bucket that are compared in one piece.
BLOCK_SETS = 1024
#: One text of so many is in the sample; shingles seen so often in it are late in the order, the most frequent of them by their counts.
SAMPLE, OFTEN, ORDERED = 64, 3, 1 << 16
#: Rows of a batch whose shingles are held at a time.
SLICE_ROWS = 256


def shingles(text: bytes) -> np.ndarray:
    """Different hashes of the text's shingles in ascending order; a shorter text is one shingle, no words are none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE_WORDS, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b]) for a, b in zip(starts, ends[k - 1:].tolist(), strict=True)), np.uint64, len(starts)))


def set_id(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes())).view(np.int64))


def simhash(found: np.ndarray) -> int:
    """64 bits; a bit is set when more than half of the different shingles have it.  No shingles: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 8192):
        counts += np.unpackbits(found[i:i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles per value of their upper bits; a power of two of bits, at least as many as shingles."""
    width = max(SKETCH_BITS.bit_length() - 1, len(found).bit_length())
    return np.packbits(np.bincount((found >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1).tobytes()


def folded(wide: bytes, size: int) -> bytes:
    """The sketch of the same set with ``size`` bytes."""
    if len(wide) == size:
        return wide
    return np.packbits(np.unpackbits(np.frombuffer(wide, np.uint8)).reshape(8 * size, -1).sum(1) & 1).tobytes()


def prefix(found: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles one of which every similar set has among its own; ``late`` are known to be frequent, with their ranks in the order."""
    if not len(found):
        return found
    of = np.zeros(len(found), np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late, found), len(late) - 1)
        of = np.where(late[at] == found, rank[at], 0)
    least_shared = -(-SHARE * len(found) // OF)
    return found[np.lexsort((found, of))[:len(found) - least_shared + 1]]


def _longs(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(at, SLICE_ROWS)
            yield part, [shingles(t.as_py().encode()) for t in part.column("text")]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, found in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["key"])


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ORDERED shingles that are frequent in the sample, ascending, and their ranks."""
    sample = rows.filter(F.pmod(F.xxhash64("text_hash"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "key long")
    top = sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(ORDERED).toArrow()
    late, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(late)
    return late[order], n[order]


def _marks(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = frequent.value
        for b, found in _slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(map(set_id, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(simhash, found), pa.int64()),
                 pa.array(map(sketch, found), pa.binary()), _longs([prefix(f, late, rank) for f in found])],
                ["doc_id", "text_hash", "fp", "n", "print", "sketch", "prefix"])

    return run


def _meeting(wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            here = held(wanted.value, keys.view(np.uint64))
            row = pa.array(row[here])
            narrow = pa.array([folded(w, SKETCH_BITS // 8) for w in b.column("sketch").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[here]), b.column("fp").take(row), b.column("n").take(row), narrow.take(row)], ["key", "fp", "n", "sketch"])

    return run


def _close(n: np.ndarray, bits: np.ndarray, i, j) -> np.ndarray:
    """Whether sets i and j may be similar, by their sizes and sketches."""
    sized = OF * np.minimum(n[i], n[j]) >= SHARE * np.maximum(n[i], n[j])
    return sized & ((OF + SHARE) * np.bitwise_count(bits[i] ^ bits[j]).sum(-1, dtype=np.int64) <= (OF - SHARE) * (n[i] + n[j]))


def _candidates(stars: bool) -> Callable:
    """Pairs of each bucket that may be similar: those of stars that cover the bucket, or all pairs of different components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, bits, root = b.column(0).flatten().flatten()
            fp, n, root = fp.to_numpy(), n.to_numpy(), root.to_numpy()
            bits = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            ends = b.column(0).offsets.to_numpy()
            starts, ends = (ends - ends[0])[:-1], (ends - ends[0])[1:]
            two = starts[ends - starts == 2]
            two = two[_close(n, bits, two, two + 1) & (root[two] != root[two + 1])]
            left, right = [two], [two + 1]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                rest = np.arange(s, e)
                while len(rest) > 1:
                    i, rest = rest[0], rest[1:]
                    apart = root[rest] != root[i]
                    near = _close(n, bits, i, rest) & apart
                    right.append(rest[near])
                    left.append(np.full(len(right[-1]), i))
                    if stars:
                        rest = rest[~near & apart]
            left, right = np.concatenate(left), np.concatenate(right)
            for at in range(0, len(left), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(fp[left[at:at + (1 << 16)]]), pa.array(fp[right[at:at + (1 << 16)]])], ["a", "b"])

    return run


def _pairs(members: DataFrame, keys: DataFrame, stars: bool) -> DataFrame:
    """Different candidate pairs (a, b) with a < b of the buckets in ``keys``, which are cut into blocks when they are crowded."""
    parts = F.ceil(F.col("_n") / BLOCK_SETS)
    dealt = members.join(keys, "key").select("key", "fp", "n", "sketch", "root", F.pmod(F.xxhash64("fp", "key"), parts).alias("_own"), parts.alias("_parts"))
    units = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    grouped = units.groupBy("key", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi")).agg(
        F.sort_array(F.collect_list(F.struct("fp", "n", "sketch", "root"))).alias("sets"))
    return grouped.filter(F.size("sets") > 1).select("sets").mapInArrow(_candidates(stars), "a long, b long").distinct()


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar by their wide sketches."""
    for b in batches:
        n, left, right = b.column("n").to_numpy(), b.column("_left").to_pylist(), b.column("_right").to_pylist()
        differ = np.zeros(len(n), np.int64)
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            size = min(len(x), len(y))
            differ[k] = np.bitwise_count(np.frombuffer(folded(x, size), np.uint64) ^ np.frombuffer(folded(y, size), np.uint64)).sum(dtype=np.int64)
        yield b.select(["a", "b"]).filter(pa.array((OF + SHARE) * differ <= (OF - SHARE) * n))


def _sets(wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here = b.filter(pa.array(held(wanted.value, b.column("text_hash").to_numpy().view(np.uint64))))
            for _, found in _slices([here]):
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, found), pa.int64()), _longs(found)], ["fp", "shingles"])

    return run


def _similar(rows: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written pairs that are similar, decided by all their shingles."""
    sc = rows.sparkSession.sparkContext
    left = written(pairs.join(first.select(F.col("fp").alias("a"), F.col("n").alias("_n"), F.col("sketch").alias("_left")), "a"), "left-sketches")
    sides = left.join(first.select(F.col("fp").alias("b"), "n", F.col("sketch").alias("_right")), "b")
    pairs = written(sides.select("a", "b", (F.col("_n") + F.col("n")).alias("n"), "_left", "_right").mapInArrow(_open, "a long, b long"), "open-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = sc.broadcast(bit_set(first.join(nodes, "fp").select("_text"), "_text"))
    found = rows.select("text_hash", "text").mapInArrow(_sets(wanted), "fp long, shingles array<long>")
    sets = written(found.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    sides = written(pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("_a")), "a"), "left-sides")
    both = sides.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return written(both.filter((OF + SHARE) * shared >= SHARE * (F.size("_a") + F.size("_b"))).select("a", "b"), "similar")


def _print_links(first: DataFrame, close_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of sets with a < b: those of one fingerprint with its smallest, and the smallest of fingerprints that link."""
    prints = written(first.groupBy("print").agg(F.min("fp").alias("head")), "prints")
    same = first.join(prints, "print").filter("fp <> head").select(F.col("fp").alias("x"), F.col("head").alias("y"))
    near = written(close_links(prints.select(F.col("print").alias("fp"))), "close-prints")
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(prints.select(F.col("print").alias(end), F.col("head").alias(name)), end)
    return written(same.unionByName(near.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "print-links")


def _rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    return sets.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _of_several(members: DataFrame) -> DataFrame:
    """Buckets that hold sets of different components, with their sizes."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("key", "_n")


def marks_and_links(docs: DataFrame, id_col: str, text_col: str, components: Callable[[DataFrame], DataFrame],
                    close_links: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the identifier ``fp`` of their set of shingles; the smallest id per set; (node, root) of each set that is linked with others."""
    sc = docs.sparkSession.sparkContext
    rows = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    frequent = sc.broadcast(_frequent(rows))
    marked = written(rows.mapInArrow(_marks(frequent), "doc_id long, text_hash long, fp long, n long, print long, sketch binary, prefix array<long>"), "shingle-marks")
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.min("text_hash").alias("_text"), F.first("n").alias("n"), F.first("print").alias("print"),
                                                F.first("sketch").alias("sketch")), "different-sets")
    # SimHash, then what its radius does not reach.
    close = _similar(rows, first, _print_links(first, close_links))
    roots = components(close)
    crowd = written(marked.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"), "meeting-shingles")
    wanted = sc.broadcast(bit_set(crowd, "key"))
    meeting = marked.select("fp", "n", "sketch", "prefix").mapInArrow(_meeting(wanted), "key long, fp long, n long, sketch binary").join(crowd, "key")
    members = written(_rooted(meeting.groupBy("key", "fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), roots), "meeting-sets")
    stars = written(_pairs(members, written(_of_several(members), "buckets"), True), "star-pairs")
    links = close.unionByName(_similar(rows, first, stars))
    roots = components(links)
    # Pairs of one bucket that no star decided.
    labelled = written(_rooted(members.drop("root"), roots), "labelled-sets")
    apart = written(_of_several(labelled), "open-buckets")
    others = written(_pairs(labelled, apart, False).join(stars, ["a", "b"], "left_anti"), "other-pairs")
    more = _similar(rows, first, others)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return marked.select("doc_id", "text_hash", "fp"), first.select("fp", "_first"), roots
