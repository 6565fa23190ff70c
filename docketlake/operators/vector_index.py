"""Approximate vector search on a coarse index: every vector lies in the cell of its nearest centroid.

The centroids are fitted on a bounded sample, every vector is indexed, and how many cells a query has
to look into is measured, not guessed: on calibration queries held against exact search.  Candidates are
scored exactly, so a result only differs from exact search by what lies in cells that were not probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unit
from ..session import cut_lineage, ship_package
from .scale import top_per_key
from .vectors import QUERY_BLOCK, VECTOR_BLOCK, _best, _unit_rows, must, vector_search

#: Vectors the centroids are fitted on (expected number), and most centroids: what every task holds of the index.
SAMPLE_ROWS = 1 << 16
MAX_CELLS = 4096
#: Queries the number of probes is measured with, and the part of their true neighbours that has to be found.
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.95


@dataclass(frozen=True)
class CoarseIndex:
    """``rows``: the vectors with their cell and all other columns.  ``probes``: cells that a query looks into."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    vid: str = "vec_id"
    vec: str = "embedding"

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _cells_in_order(centroids: np.ndarray, values, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first; ties by number."""
    if len(centroids) == 1:
        return np.zeros((len(values), 1), np.int64)
    return np.argsort(-(_unit_rows(values) @ centroids.T), axis=1, kind="stable")[:, :n]


def build_index(vectors: DataFrame, cells: int | None = None, vid: str = "vec_id", vec: str = "embedding", sample_rows: int = SAMPLE_ROWS,
                target_recall: float = TARGET_RECALL, k: int = 10, seed: int = 1) -> CoarseIndex:
    """Index all ``vectors``; about the square root of their number as cells by default.

    Vectors that are null or zero lie in some cell and are found with score 0 or not at all.  An empty
    table, or one without any direction, gives an index of one cell.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n = vectors.count()
    if n == 0:
        return CoarseIndex(np.zeros((1, 1)), vectors.withColumn("cell", F.lit(0)), 1, vid, vec)
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, n))
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col(vid)), F.lit(n)) < sample_rows
    # A vector without a direction says nothing of where the cells should be.
    sample = cut_lineage(vectors.filter(chosen).select(unit(vec).alias("u")).filter("u IS NOT NULL").distinct()).select(array_to_vector("u").alias("features"))
    cells = min(cells, sample.count())
    if cells <= 1:
        return CoarseIndex(np.zeros((1, 1)), cut_lineage(vectors.withColumn("cell", F.lit(0))), 1, vid, vec)
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample)
    centres = np.array(model.clusterCenters())
    centroids = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(_cells_in_order(shared.value, [v if v is not None else np.zeros(centroids.shape[1]) for v in values], 1)[:, 0].astype(np.int32))

    cell = F.pandas_udf(nearest, "int")
    rows = cut_lineage(vectors.withColumn("cell", cell(F.col(vec))))
    index = CoarseIndex(centroids, rows, len(centroids), vid, vec)
    return replace(index, probes=calibrated_probes(index, n, target_recall, k, seed))


def calibrated_probes(index: CoarseIndex, n: int, target_recall: float, k: int, seed: int) -> int:
    """The fewest cells in which ``target_recall`` of the true neighbours of the calibration queries lie."""
    chosen = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(index.vid)), F.lit(n)) < CALIBRATION_QUERIES
    queries = cut_lineage(index.rows.filter(chosen & F.col(index.vec).isNotNull()).select(F.col(index.vid).alias("query_id"), index.vec))
    # Each query finds itself, which says nothing.
    exact = vector_search(queries, index.rows.select(index.vid, index.vec), k + 1, vid=index.vid, vec=index.vec).filter(F.col("query_id") != F.col(index.vid))
    true = exact.join(index.rows.select(index.vid, "cell"), index.vid).select("query_id", "cell").collect()  # CALIBRATION_QUERIES * k rows
    if not true:
        return index.cells
    asked = queries.collect()
    order = _cells_in_order(index.centroids, [r[index.vec] for r in asked], index.cells)
    place = {r["query_id"]: np.argsort(o) for r, o in zip(asked, order, strict=True)}
    needed = np.sort([place[r["query_id"]][r["cell"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))) - 1)]) + 1


def search_index(index: CoarseIndex, queries: DataFrame, k: int, threshold: float | None = None, filters: dict | None = None, qid: str = "query_id",
                 probes: int | None = None) -> DataFrame:
    """The k best vectors per query among the probed cells: (query, vector, score, rank), scores exact.

    Queries and vectors meet by cell.  A cell with many vectors or many queries is cut into a grid, so a
    group holds at most about VECTOR_BLOCK vectors and QUERY_BLOCK queries, and only its best are written.
    """
    probes = min(probes or index.probes, index.cells)
    vid, vec = index.vid, index.vec
    shared = index.rows.sparkSession.sparkContext.broadcast(index.centroids)

    def probed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(list(_cells_in_order(shared.value, values, probes).astype(np.int32)))

    asked = queries.filter(F.col(vec).isNotNull()).select(qid, vec)
    asked = cut_lineage(asked.withColumn("cell", F.explode(F.pandas_udf(probed, "array<int>")(F.col(vec)))))
    rows = index.rows.filter(must(filters) & F.col(vec).isNotNull()).select(vid, vec, "cell")
    grid = rows.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("_vs")).join(
        asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("_qs")), "cell")
    block = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    # The grid has a row per cell at most, MAX_CELLS.
    q = asked.join(F.broadcast(grid), "cell").withColumn("_q", block(qid, "_qs")).withColumn("_v", every("_vs")).drop("_qs", "_vs")
    v = rows.join(F.broadcast(grid), "cell").withColumn("_v", block(vid, "_vs")).withColumn("_q", every("_qs")).drop("_qs", "_vs")
    # Both sides may come from one table; a cogroup needs columns of their own.
    q, v = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (q, v))
    kinds = dict(queries.dtypes) | dict(index.rows.dtypes)

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({qid: [], vid: [], "score": []})
        x, y, s = _best(a[qid].to_numpy(), _unit_rows(a[vec]), None, b[vid].to_numpy(), _unit_rows(b[vec]), None, k, threshold)
        return pd.DataFrame({qid: x, vid: y, "score": s})

    keys = ["cell", "_q", "_v"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(product, f"{qid} {kinds[qid]}, {vid} {kinds[vid]}, score double")
    return top_per_key(found, [qid], [F.desc("score"), F.asc(vid)], k)


def save_index(index: CoarseIndex, path: str) -> None:
    """Write the index as two tables; the vectors are parted by cell, so a later search reads only the cells it probes."""
    spark = index.rows.sparkSession
    index.rows.repartition("cell", F.pmod(F.xxhash64(index.vid), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist(), index.probes, index.vid, index.vec) for i, c in enumerate(index.centroids)],
                          "cell int, centroid array<double>, probes int, vid string, vec string").coalesce(1).write.parquet(f"{path}/cells")


def load_index(spark: SparkSession, path: str) -> CoarseIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS rows
    return CoarseIndex(np.array([c["centroid"] for c in cells]), spark.read.parquet(f"{path}/rows"), cells[0]["probes"], cells[0]["vid"], cells[0]["vec"])
