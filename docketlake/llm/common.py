"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

#: The words of every operator here: runs of bytes other than blank and TAB .. CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that other columns can't clash; a null text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str, *parted_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The table outlives lost executors, is compressed, and later reads take only the
    columns they need, and only the parts they ask for if it is parted by a column.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parted_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_groups(df: DataFrame, rows: int) -> int:
    """How many groups of about ``rows`` rows a written table makes, one at least."""
    return max(1, -(-df.count() // rows))


def stable_row_hash(salt: int = 0) -> Column:
    """Spreads the rows of a written table evenly, whatever they hold; the same on a retried task."""
    return F.xxhash64(F.monotonically_increasing_id(), F.lit(salt))


class TwoGenerations:
    """Remembers the encoded form of words in a Python worker, in bounded memory.

    When the young generation is full it becomes the old one; words seen again come back from it.
    """

    def __init__(self, capacity: int):
        self.capacity, self.young, self.old = capacity, {}, {}

    def joined(self, words: list, encode: Callable[[list], list[bytes]]) -> bytes:
        """The encoded words, one after the other; ``encode`` gives those not known."""
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            self._learn(set(words), encode)
            return b"".join(map(self.young.__getitem__, words))

    def _learn(self, words: set, encode: Callable[[list], list[bytes]]) -> None:
        new = [w for w in words if w not in self.young]
        if len(self.young) + len(new) > self.capacity:
            self.young, self.old, new = {}, self.young, list(words)
        self.young.update((w, self.old[w]) for w in new if w in self.old)
        new = [w for w in new if w not in self.young]
        self.young.update(zip(new, encode(new), strict=True))
