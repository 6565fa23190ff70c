"""Exact deduplication with a heavy-hitter split (operator 6).

Texts are compared by their SHA-256.  A Misra-Gries style summary of bounded size (the frequent
items sketch behind ``approx_top_k``) names the digests that may be frequent.  Their counts and
winners are then computed exactly with map-side aggregation and broadcast, so that copies of them
are decided where they lie and never meet in one task.  All other digests use ordinary
shuffles: counted with map-side aggregation, then joined with their winners.  The summary only decides which way a digest takes:
the rows are the same whatever it names.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

#: Most digests that are broadcast (44 bytes each): the proven bound of both broadcasts.
MAX_HEAVY = 1024
#: Counters of one summary; a digest with more than 1/6144 of a summary's rows is always among them.
COUNTERS = 8192
#: Summaries that are built side by side and then added up.
SUMMARIES = 32


def frequent_digests(digests: DataFrame, column: str = "digest") -> DataFrame:
    """At most MAX_HEAVY digests that may be frequent: the merged Misra-Gries summaries, largest counts first."""
    local = digests.groupBy((F.spark_partition_id() % SUMMARIES).alias("_s")).agg(
        F.expr(f"approx_top_k(hex({column}), {MAX_HEAVY}, {COUNTERS})").alias("_top"))
    merged = local.select(F.explode("_top").alias("_t")).groupBy(F.unhex("_t.item").alias(column)).agg(F.sum("_t.count").alias("_n"))
    return merged.filter("_n > 1").orderBy(F.desc("_n"), column).limit(MAX_HEAVY).select(column)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest ``doc_id`` stays.  A null text is the empty text and groups with
    it.  Rows without an id stay only if no row of the group has one.  Rows that tie on the
    largest id are all marked; ``deduplicate`` then leaves one of them.  An empty table gives an
    empty result; other columns are ignored.
    """
    digests = written(texts(docs, id_col, text_col).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    # Written, so that both reads below see the same names.
    named = written(frequent_digests(digests), "frequent")
    winners = written(
        digests.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "winners")
    heavy = digests.join(F.broadcast(winners), "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = digests.join(F.broadcast(named), "digest", "left_anti")
    # Written, so that the join reads both sides from plain shuffles and a digest that no summary named can still be split.
    last = written(rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "last-rows")
    light = rest.join(last, "digest").select("doc_id", "digest", "keep_id", "group_size")
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in id and text one stays."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").groupBy("doc_id", F.unhex("text_sha256").alias("_digest")).agg(
        F.count(F.lit(1)).alias("_rows")).withColumnRenamed("doc_id", "_id")
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_own_id"), digest.alias("_own_digest"))
    found = own.join(kept, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest")))
    # Repeated rows are rare, and only their first row of each partition travels.
    single = found.filter("_rows = 1").select("_row.*")
    repeated = found.filter("_rows > 1").groupBy("_id", "_digest").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(repeated)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
