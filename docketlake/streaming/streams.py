"""Streaming forms of ingestion, deduplication, activity windows and job state.

All of them use built-in stateful operators, which combine rows before the shuffle and drop
state behind the watermark.  Rows later than the watermark are dropped and counted by Spark
(``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import rules
from ..operators.chunking import ChunkLimits, chunk_documents, select_strategy
from ..operators.cleaning import clean_documents
from ..operators.scale import spread
from ..sources.files import decode_files
from ..session import cut_lineage, ship_package
from ..sources.stores import exists, save_replacing
from ..sources.tables import SCHEMAS

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream: Parquet files, or folders of them, whose name begins with the table's; timestamps become instants for watermarks."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    df = reader.parquet(f"{folder}/{name}*.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """New text files as they arrive, decoded; the path is the document id."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).load(folder)
    return decode_files(raw).withColumnRenamed("path", "doc_id")


def ingest_batch(documents: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """Clean, refuse damaged texts, pick a strategy, chunk: one step for batch and stream.

    The cleaned texts are stored in between: inlined into the chunker, the cleaning chain would be worked out again
    wherever a text is named.
    """
    cleaned = clean_documents(documents)
    usable = cut_lineage(cleaned.select("doc_id", "category", F.when(F.col("reject_reason").isNull(), F.col("cleaned")).alias("usable")))
    return chunk_documents(usable, select_strategy(F.col("category")), text="usable", limits=limits)


def stream_ingest(documents: DataFrame, chunk_path: str, checkpoint: str, limits: ChunkLimits = ChunkLimits()) -> StreamingQuery:
    """documents (doc_id, text, category) -> chunk table; a document that comes again replaces its chunks.

    All keys of a batch are replaced, so a new version without chunks (empty or refused) leaves no
    old ones.  Of several versions of a document in one batch one is taken: the largest ``version``
    if there is such a column, else the largest text.  Replaying a batch after a failure writes the
    same rows again, so the table stays right.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            order = F.struct(*[c for c in ("version", "text", "category") if c in batch.columns])
            rest = [c for c in batch.columns if c != "doc_id"]
            newest = cut_lineage(batch.groupBy("doc_id").agg(F.max_by(F.struct(*rest), order).alias("_d")).select("doc_id", "_d.*"))
            save_replacing(batch.sparkSession, ingest_batch(spread(newest, "doc_id"), limits), chunk_path, ["doc_id"], replaced=newest)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(uploads: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key; a key is remembered for the watermark delay."""
    return uploads.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_activity(events: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None, ts: str = "ts",
                      delay: str = "1 hour", aggs: list[Column] | None = None) -> DataFrame:
    """Counts per tumbling (or sliding) window and key, emitted once the watermark passed the window."""
    win = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, delay).groupBy(win, *(by or [])).agg(*(aggs or [F.count("*").alias("events")]))
    return out.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def session_activity(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions per key: rows with no gap of that length between them."""
    out = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count("*").alias("events"))
    return out.select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def _last_log(logs: DataFrame) -> Column:
    progress = F.least(F.greatest("progress", F.lit(0)), F.lit(100))
    return F.max_by(F.struct("status", progress.alias("progress"), "step", "log_id"), F.struct("created_at", "log_id")).alias("state")


def job_state(logs: DataFrame) -> DataFrame:
    """Current status, progress and step per job: the last log row so far."""
    return logs.groupBy("job_id").agg(_last_log(logs)).select("job_id", "state.*")


def closed_jobs(logs: DataFrame, ttl: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """State of a job once it has been silent for ``ttl`` (append mode), then its state is dropped.

    ``stuck`` marks jobs that fell silent without reaching an end.
    """
    quiet = logs.withWatermark("created_at", delay).groupBy(F.session_window("created_at", ttl).alias("s"), "job_id").agg(_last_log(logs))
    return quiet.select("job_id", F.col("s.start").alias("first_seen"), F.col("s.end").alias("silent_at"), "state.*",
                        (~F.col("state.status").isin(rules.TERMINAL_STATUSES)).alias("stuck"))


def job_state_stream(logs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of current job states: each batch replaces the jobs it changed.

    The table is the state: a batch is reduced to the last row of each of its jobs and compared
    with what the table holds of them.  The stream itself keeps nothing, so nothing has to expire,
    and a replayed or late batch changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        last = cut_lineage(batch.groupBy("job_id").agg(_last_log(batch), F.max(F.struct("created_at", "log_id")).alias("at")).select("job_id", "state.*", F.col("at.created_at").alias("created_at")))
        if exists(spark, path):
            known = spark.read.parquet(path).select(last.columns).join(last.select("job_id"), "job_id", "left_semi")
            rest = [c for c in last.columns if c != "job_id"]
            last = cut_lineage(last.unionByName(known).groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "log_id")).alias("s")).select("job_id", "s.*"))
        save_replacing(spark, last, path, ["job_id"])

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- job state kept by the stream itself ---------------------------------------------------------

_MOMENT = "timestamp"
_JOB_STATE = "status string, progress int, step string, log_id bigint, created_at timestamp"
_JOB_NEWS = "job_id bigint, kind string, " + _JOB_STATE


def _newest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last log row of each job."""
    return pdf.sort_values(["created_at", "log_id"], kind="stable").drop_duplicates("job_id", keep="last")


def _newest_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _newest(pdf)


class JobMonitor(StatefulProcessor):
    """Holds the last log row of a job and one timer.

    A newer row is told as ``update`` and moves the timer.  When event time passes the timer, an unfinished job is
    told as ``stuck`` and a finished one as ``closed``; either way its state is dropped, so the state holds only jobs
    that were heard of within ``silence`` (``keep`` once finished) of the watermark.
    """

    def __init__(self, silence_ms: int, keep_ms: int, finished: list[str]):
        self.silence_ms, self.keep_ms, self.finished = silence_ms, keep_ms, frozenset(finished)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _JOB_STATE)

    def _row(self, key, kind: str, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], kind, *state)], columns=["job_id", "kind", "status", "progress", "step", "log_id", "created_at"]).astype({"progress": "Int32"})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        newest = None
        for pdf in rows:
            r = _newest(pdf).iloc[0]
            if newest is None or (r["created_at"], r["log_id"]) > (newest["created_at"], newest["log_id"]):
                newest = r
        known = self.last.get()
        if newest is None or (known is not None and (pd.Timestamp(known[4]), known[3]) >= (newest["created_at"], newest["log_id"])):
            return
        state = (newest["status"], None if pd.isna(newest["progress"]) else int(newest["progress"]), newest["step"], int(newest["log_id"]), newest["created_at"].to_pydatetime())
        self.last.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wait = self.keep_ms if state[0] in self.finished else self.silence_ms
        # In UTC, as all timestamps of the engine.
        self.handle.registerTimer(int(newest["created_at"].tz_localize("UTC").timestamp() * 1000) + wait)
        yield self._row(key, "update", state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        state = self.last.get()
        self.last.clear()
        if state is not None:
            yield self._row(key, "closed" if state[0] in self.finished else "stuck", tuple(state))

    def close(self) -> None:
        pass


def job_monitor(logs: DataFrame, silence_hours: float = 6, keep_hours: float | None = None, delay: str = "1 hour") -> DataFrame:
    """Job news as a stream: (job_id, kind, status, progress, step, log_id, created_at), append only.

    ``update``: the state changed; ``stuck``: an unfinished job was silent for ``silence_hours`` of event time; ``closed``:
    a finished one for ``keep_hours`` (the same by default).  Rows that come again or late change nothing: they are not
    newer than the state, and once the state is gone they are behind the watermark.  A job that speaks again after
    it was told stuck is told as ``update``.  Before the shuffle each partition keeps the last row of each job, so that a
    job with very many rows does not burden one task.  Needs the RocksDB state store (``job_monitor_stream`` sets it).
    """
    ship_package(logs.sparkSession)
    progress = F.least(F.greatest("progress", F.lit(0)), F.lit(100)).cast("int").alias("progress")
    rows = logs.select(F.col("job_id").cast("long").alias("job_id"), "status", progress, "step", F.col("log_id").cast("long").alias("log_id"), F.col("created_at").cast(_MOMENT).alias("created_at"))
    rows = rows.filter("job_id IS NOT NULL AND created_at IS NOT NULL AND log_id IS NOT NULL")
    shape = "job_id bigint, status string, progress int, step string, log_id bigint, created_at timestamp"
    few = rows.mapInPandas(_newest_of_batches, shape).withWatermark("created_at", delay)
    ms = lambda hours: int(hours * 3_600_000)
    monitor = JobMonitor(ms(silence_hours), ms(silence_hours if keep_hours is None else keep_hours), list(rules.TERMINAL_STATUSES))
    return few.groupBy("job_id").transformWithStateInPandas(monitor, _JOB_NEWS, "Append", "EventTime")


def job_monitor_stream(logs: DataFrame, path: str, checkpoint: str, silence_hours: float = 6, keep_hours: float | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Write job news as Parquet, each exactly once; their state lives in RocksDB, not on the heap."""
    spark = logs.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return job_monitor(logs, silence_hours, keep_hours, delay).writeStream.format("parquet").outputMode("append").option("path", path).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def current_jobs(news: DataFrame) -> DataFrame:
    """What the news say of each job now: its last state, and the last ``kind`` told of that state."""
    at = F.struct("created_at", "log_id", (F.col("kind") != "update").alias("told"))
    return news.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "step", "log_id", "kind"), at).alias("s")).select("job_id", "s.*")


def run_append(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into Parquet, and read the result."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
