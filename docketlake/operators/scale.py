"""Building blocks that keep working when one key holds a third of all rows.

* ``first_by`` / ``last_by`` aggregate with map-side combine, where a window would send the
  whole key to one task.
* ``top_per_key`` is a window with a rank limit, which Spark cuts down per partition before
  the shuffle.
* ``ordered_blocks`` and the functions below it compute neighbours, running sums and last
  seen values over keys of any size: rows are range partitioned by key *and* order, each
  block is handled on its own, and one row per (key, block) carries the state across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_by(df: DataFrame, keys: list[str], order: list[str], cols: list[str] | None = None) -> DataFrame:
    """The first row of each key in ``order`` (ascending)."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    picked = F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def last_by(df: DataFrame, keys: list[str], order: list[str], cols: list[str] | None = None) -> DataFrame:
    """The last row of each key in ``order`` (ascending)."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    picked = F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for heavy row work when the scan gave fewer partitions than cores.

    On a large table the scan already has many partitions and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def ordered_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range partition by keys and order; ``_block`` is the partition a row fell into.

    ``order`` has to end in a unique column, so that equal keys and dates can still be
    split.  The result is checkpointed: the block borders come from a sample, so they may
    be computed only once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id())
    return cut_lineage(blocks)


def _block_state(blocks: DataFrame, keys: list[str], state: list[Column]) -> DataFrame:
    return blocks.groupBy(*keys, "_block").agg(*state)


def next_row(df: DataFrame, keys: list[str], order: list[str], cols: list[str], out: str = "next") -> DataFrame:
    """Add the struct of ``cols`` of the following row of the same key (null at the end)."""
    blocks = ordered_blocks(df, keys, order)
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    across = W.partitionBy(*keys).orderBy("_block") if keys else W.orderBy("_block")
    heads = (
        _block_state(blocks, keys, [F.min_by(F.struct(*cols), F.struct(*order)).alias("_head")])
        .withColumn("_after", F.lead("_head").over(across))
        .select(*keys, "_block", "_after")
    )
    return (
        blocks.withColumn(out, F.lead(F.struct(*cols)).over(inside))
        .join(heads, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce(out, "_after"))
        .drop("_block", "_after")
    )


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add, per name, the sum of its value over the rows of the key up to and including this one."""
    for out, value in values.items():
        df = df.withColumn(out, value)
    blocks = ordered_blocks(df, keys, order)
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = (W.partitionBy(*keys) if keys else W).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = _block_state(blocks, keys, [F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    summed = blocks.select(*[c for c in blocks.columns if c not in values], *[F.sum(v).over(inside).alias(v) for v in values])
    out = summed.join(offsets, [*keys, "_block"], "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(v), F.lit(0)) + F.col(f"_o_{v}")).drop(f"_o_{v}")
    return out.drop("_block")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and including this one."""
    return running_sums(df, keys, order, {out: value})


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add the last non-null ``value`` of the key strictly before this row."""
    blocks = ordered_blocks(df.withColumn("_v", value), keys, order)
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = (W.partitionBy(*keys) if keys else W).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        _block_state(blocks, keys,
                     [F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail")])
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(before))
        .drop("_tail")
    )
    return (
        blocks.withColumn(out, F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop("_v", "_block", "_carried")
    )


def _pieces(text: str, n: Column) -> Column:
    """All different pieces of n characters; a look-ahead walks the text once."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(F.col(text), pattern, F.lit(1)))


def containing(needles: DataFrame, hays: DataFrame, keys: list[str], piece: int = 6) -> DataFrame:
    """Pairs (keys, nid, hid) where the hay text contains the needle text.

    ``needles``: keys, nid, text.  ``hays``: keys, hid, text.  A needle meets hays on its
    rarest piece of ``piece`` characters (all of it when shorter), so a common beginning
    does not bring everything together.  Every candidate is verified.

    All sides grow with the texts, and Spark takes the pieces of a text for no more than the text
    itself, so the joins ask for a shuffle: a broadcast of pieces would fill the driver.
    """
    size = F.least(F.length("text"), F.lit(piece))
    # Pieces travel as hashes of (keys, length, piece); equal hashes of different pieces fail the final test.
    hashed = lambda df, id: df.select(*keys, id, F.explode(_pieces("text", F.col("_n"))).alias("_p"), "_n").select(
        *keys, id, F.xxhash64(*keys, "_n", "_p").alias("_h"))
    small = needles.filter("text <> ''").withColumn("_n", size)
    wanted = hashed(small, "nid")
    sizes = small.select(*keys, "_n").distinct()
    grams = hashed(hays.join(sizes.hint("merge"), keys).filter(F.length("text") >= F.col("_n")), "hid")
    grams = grams.join(wanted.select("_h").distinct().hint("merge"), "_h", "left_semi")
    freq = grams.groupBy("_h").agg(F.count("*").alias("_f"))
    rare = wanted.join(freq.hint("merge"), "_h").groupBy(*keys, "nid").agg(F.min_by("_h", F.struct("_f", "_h")).alias("_h"))
    pairs = rare.join(grams.select("_h", "hid").hint("merge"), "_h").select(*keys, "nid", "hid")
    n = needles.select(*keys, "nid", F.col("text").alias("_needle")).hint("merge")
    h = hays.select(*keys, "hid", F.col("text").alias("_hay")).hint("merge")
    return pairs.join(n, [*keys, "nid"]).join(h, [*keys, "hid"]).filter(F.contains("_hay", "_needle")).select(*keys, "nid", "hid")
