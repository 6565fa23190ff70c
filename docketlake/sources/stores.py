"""Tables on disk: upserts, snapshots, exports and the vector payload."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..session import cut_lineage


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """All old rows of the keys in ``replaced`` (those in ``new`` by default) give way to the new rows.

    Name the keys of the whole batch: one whose new version has no rows loses its old ones.
    """
    gone = (new if replaced is None else replaced).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def save_replacing(spark: SparkSession, new: DataFrame, path: str, keys: list[str], buckets: int = 64, replaced: DataFrame | None = None) -> None:
    """``replace_by_key`` on disk: only the buckets that hold a replaced key are rewritten.

    Choose ``buckets`` so that a batch touches few of them; a table keeps the number it was begun
    with.  The rebalance hint groups the rows by bucket for writing and splits a bucket that is
    too large for one task.  A batch of many keys touches all buckets; ``append_version`` costs
    no more than the batch.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    fresh = new.select("*", bucket)
    if exists(spark, path):
        gone = (new if replaced is None else replaced).select(*keys).distinct().select(*keys, bucket)
        gone = cut_lineage(gone)
        old = spark.read.schema(fresh.schema).parquet(path).join(gone.select("bucket").distinct(), "bucket", "left_semi").join(gone.drop("bucket"), keys, "left_anti")
        fresh = cut_lineage(fresh.unionByName(old))  # the folder is read and overwritten in one go
        # A bucket of which nothing is left is not overwritten by a dynamic write.
        for r in gone.select("bucket").distinct().join(fresh.select("bucket").distinct(), "bucket", "left_anti").collect():
            _delete(spark, f"{path}/bucket={r['bucket']}")
    fresh.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def newest_version(spark: SparkSession, path: str) -> int:
    """Number of the last finished version of a table of versions, 0 if there is none."""
    keys = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/keys")
    fs = keys.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName().removeprefix("version=") for f in fs.listStatus(keys)] if fs.exists(keys) else []
    return max((int(n) for n in found if n.isdigit() and exists(spark, f"{keys}/version={n}/_SUCCESS")), default=0)


def append_version(spark: SparkSession, new: DataFrame, path: str, keys: list[str], replaced: DataFrame | None = None) -> int:
    """``replace_by_key`` on disk at the cost of the batch alone; returns the number of its version.

    The rows go into a folder of their own, then the keys they replace (those of ``new`` and of
    ``replaced``), which makes the version a finished one.  Nothing older is touched: a version
    that broke off is not seen by ``newest_rows`` and is overwritten by the next one, and a batch
    that comes again replaces its own keys.  One writer at a time; the columns stay the same.
    """
    n = newest_version(spark, path) + 1
    rows = f"{path}/rows/version={n}"
    new.write.mode("overwrite").parquet(rows)
    gone = spark.read.schema(new.schema).parquet(rows).select(*keys)
    gone = gone if replaced is None else gone.unionByName(replaced.select(*keys))
    gone.distinct().write.mode("overwrite").parquet(f"{path}/keys/version={n}")
    return n


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of each key's newest version; null is a key like others.  A table of one version needs no join."""
    n = newest_version(spark, path)
    if n == 0:
        raise ValueError(f"no finished version in {path}")
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("version") <= n)
    if n == 1:
        return rows.drop("version")
    last = spark.read.parquet(f"{path}/keys").filter(F.col("version") <= n).groupBy(*keys).agg(F.max("version").alias("version"))
    same = [rows[k].eqNullSafe(last[k]) for k in keys]
    return rows.join(last, functools.reduce(lambda a, b: a & b, same, rows["version"] == last["version"]), "left_semi").drop("version")


def compact_versions(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """The newest rows as a table of one version in the new folder ``target``; ``path`` stays as it is."""
    if exists(spark, target):
        raise ValueError(f"{target} is there already")
    append_version(spark, newest_rows(spark, path, keys), target, keys)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_snapshot(metrics: DataFrame, path: str, snapshot_type: str, as_of, by: str | None = None) -> None:
    """Append one computed bundle; the newest per (type, case) is the valid one."""
    case = F.col(by).cast("string") if by else F.lit("*")
    metrics.select(
        F.lit(snapshot_type).alias("snapshot_type"), case.alias("case_key"), F.lit(as_of).cast("timestamp").alias("computed_at"),
        "category", "section", "label", "value", "unit",
    ).write.mode("append").partitionBy("snapshot_type").parquet(path)


def newest_snapshot(snapshots: DataFrame, as_of, max_age_minutes: int = rules.SNAPSHOT_MINUTES) -> DataFrame:
    """Rows of the newest snapshot per (type, case) that is not too old at ``as_of``."""
    keys = ["snapshot_type", "case_key"]
    limit = F.lit(as_of).cast("timestamp")
    usable = snapshots.filter(F.col("computed_at").between(limit - F.make_dt_interval(mins=F.lit(max_age_minutes)), limit))
    newest = usable.groupBy(*keys).agg(F.max("computed_at").alias("computed_at"))
    return usable.join(newest, [*keys, "computed_at"], "left_semi")


def flatten_bundles(bundles: list[DataFrame]) -> DataFrame:
    """Several metric bundles as one frame of (category, section, label, value, unit)."""
    cols = ["category", "section", "label", "value", "unit"]
    return functools.reduce(DataFrame.unionByName, [b.select(*cols) for b in bundles])


def export_metrics(bundles: list[DataFrame], path: str) -> None:
    flatten_bundles(bundles).write.mode("overwrite").csv(path, header=True)


def vector_payload(vectors: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors that are not synced yet, with what the index stores beside them.

    Columns that a table lacks are null in the payload.
    """
    c = chunks.select("doc_id", "chunk_index", F.col("chunk_index").alias("_index"), "page_start", "section", *([F.col("chunk_id").alias("_chunk")] if "chunk_id" in chunks.columns else []))
    df = vectors.filter(~F.col("is_synced")).join(c, ["doc_id", "chunk_index"], "left").join(docs, "doc_id")
    return df.select("vec_id", "embedding", F.struct(
        F.col("doc_id"), F.coalesce("_index", F.lit(0)).alias("chunk_index"), F.coalesce("page_start", F.lit(1)).alias("page"),
        F.coalesce("section", F.lit("")).alias("section"), F.col("case_id"), F.col("title"),
        *[(F.col(c) if c in df.columns else F.lit(None).cast(kind)).alias(name) for c, name, kind in (
            ("_chunk", "chunk_id", "string"), ("owner_id", "owner_id", "string"), ("filename", "filename", "string"), ("mime_type", "document_type", "string"),
            ("user_tags", "tags", "string"), ("created_at", "created_at", "timestamp"), ("embedding_version", "embedding_version", "string"))]).alias("payload"))


def delete_document_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def reset_sync(vectors: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Clear the sync mark of all vectors, or of the given documents."""
    if ids is None:
        return vectors.withColumn("is_synced", F.lit(False))
    marked = ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    return vectors.join(marked, "doc_id", "left").withColumn(
        "is_synced", F.col("is_synced") & F.col("_hit").isNull()).drop("_hit")


def pending_documents(vectors: DataFrame) -> DataFrame:
    return vectors.filter(~F.col("is_synced")).select("doc_id").distinct()
