"""Removal of lines that many documents share, with levelled sorted runs of line hashes (operator 12).

Documents come in batches by falling id.  A run is a table with one row per line key of a batch, its
documents counted and the largest of them noted, bucketed and sorted by the key's hash, so that merge
joins read it as it lies.  A new batch is merge-anti-joined with the runs: lines whose key a run
already counts in enough documents are settled, since later batches only bring smaller ids, and leave
at once; the others become the batch's own run.  When a level holds ``fanout`` runs, they are
compacted into one run of the next level.  In the end the runs tell which keys lose their lines, and
each document gets the places of its own lost lines.

DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import texts, written

#: Code points a key needs, and documents that have to hold it, before its lines go.
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Batches of one call, and runs of a level that are compacted into one.
BATCHES = 4
FANOUT = 2

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def key_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_key, place, h1, h2): every line with a long enough key, which travels as a hash of 128 bits."""
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "_line"))
    keyed = lines.select("doc_id", "text_key", "place", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= least_chars)
    return keyed.select("doc_id", "text_key", "place", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))


class LineRuns:
    """The runs of the batches seen so far: names of bucketed tables, by level."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{checkpoint_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.written: list[str] = []

    def _run(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        entries.select(*KEYS, "docs", "last").write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.written.append(name)
        return name

    def all(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch; all its ids are smaller than those before.  Rows without an id are no documents."""
        own = lines.filter("doc_id IS NOT NULL").groupBy(*KEYS).agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last"))
        for run in self.all():
            settled = self.spark.table(run).filter(F.col("docs") >= self.least_docs).select(*KEYS)
            own = own.join(settled.hint("merge"), KEYS, "left_anti")
        self.levels[0].append(self._run(own))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._run(self.merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def merged(self, runs: list[str]) -> DataFrame:
        """One entry (h1, h2, docs, last) per key: batches share no document, so counts add up.

        The files are read as one plain table: a union of bucketed tables would be taken for one that
        is dealt by key, which it is not, and the aggregate would miss its shuffle.
        """
        every = self.spark.read.schema("h1 long, h2 long, docs long, last long").parquet(*[f"{self.folder}/{r}" for r in runs])
        return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def repeated(self) -> DataFrame:
        """(h1, h2, last): keys that enough documents hold, written as a table of its own; the runs are given up."""
        out = written(self.merged(self.all()).filter(F.col("docs") >= self.least_docs).select(*KEYS, "last"), "repeated-lines")
        for name in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.written = [[]], []
        return out


def _bounds(rows: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into about equal batches."""
    shares = [i / batches for i in range(1, batches)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 1000).alias("b")).first()["b"]
    return sorted(set(found or []))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
                        fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept (the lines that stay, joined by line feeds).

    A key that at least ``least_docs`` documents hold loses all its lines except in the largest
    doc_id.  A null or empty text is one empty line.  Rows of one id are one document: they count
    once, and if the id is the largest, all of them keep their lines.  Rows without an id do not
    count and lose every line whose key is repeated.  A document may lose all lines; then ``kept``
    is empty.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    bounds = _bounds(rows, batches)
    number = F.lit(0)
    for b in bounds:
        number = number + F.when(F.col("doc_id") <= b, 1).otherwise(0)
    lines = written(key_lines(rows, least_chars).withColumn("batch", number), "key-lines", "batch")
    runs = LineRuns(spark, least_docs, fanout)
    for i in range(len(bounds) + 1):
        runs.add(lines.filter(F.col("batch") == i))
    # Written runs on one side and a written table on the other: plain shuffles, in which a hot key can be split.
    lost = lines.join(runs.repeated().hint("merge"), KEYS).filter("doc_id IS NULL OR doc_id < last")
    places = lost.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).agg(F.collect_set("place").alias("places"))
    found = rows.join(written(places, "lost-places"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key")), "left")
    split = found.select("doc_id", F.split("text", "\n").alias("l"), F.coalesce("places", F.array().cast("array<int>")).alias("places"), "text")
    stay = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("places"))
    kept = F.when(F.size("places") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("l", i)), "\n"))
    return split.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"), kept.alias("kept"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM e),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.place, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
