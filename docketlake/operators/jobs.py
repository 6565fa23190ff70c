"""Rules on the job table and its append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import contains_any, rounded
from .scale import last_by, running_sum

# Which log message moves which stage, and to what.
STAGE_STARTS = {
    "Extraction": ["starting", "running", "extraction started"],
    "Cleaning": ["cleaning & normalizing", "cleaning started"],
    "Chunking": ["generating chunks", "chunking started"],
}
STAGE_ENDS = {
    "Extraction": ["saving extracted text", "extracted text saved"],
    "Cleaning": ["saving cleaned text", "cleaned text saved"],
    "Chunking": ["saving chunks", "chunks saved"],
}


def job_stage_timeline(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Five stages per job with status and time.

    Each log line may move several stages.  The last move of a stage decides its status;
    its time is that of the last start.  All of it is one aggregate per job.
    """
    msg = F.lower("message")
    at = F.struct("created_at", "log_id")
    aggs = [F.max(F.when(contains_any(msg, ["queued", "created"]), F.col("created_at"))).alias("queued_at")]
    for stage in STAGE_STARTS:
        start, end = contains_any(msg, STAGE_STARTS[stage]), contains_any(msg, STAGE_ENDS[stage])
        move = F.when(end, "completed").when(start, "running")
        aggs.append(F.max_by(move, F.when(move.isNotNull(), at)).alias(f"{stage}_status"))
        aggs.append(F.max(F.when(start, F.col("created_at"))).alias(f"{stage}_at"))
    done = F.when(msg.contains("failed"), "failed").when(contains_any(msg, ["completed", "finished"]), "completed")
    aggs.append(F.max_by(F.struct(done.alias("status"), F.col("created_at").alias("at")), F.when(done.isNotNull(), at)).alias("end"))
    folded = logs.groupBy("job_id").agg(*aggs)
    j = jobs.select("job_id", "status", F.col("created_at").alias("job_created"), "completed_at").join(folded, "job_id", "left")

    status = F.col("status")
    own = {s: F.coalesce(F.col(f"{s}_status"), F.lit("pending")) for s in STAGE_STARTS}
    # A failed job fails the last stage that was still running.
    failing = F.coalesce(*[F.when(own[s] == "running", s) for s in ["Chunking", "Cleaning", "Extraction"]])
    stage_status = {
        s: F.when(status == "completed", "completed").when((status == "failed") & (failing == s), "failed").otherwise(own[s])
        for s in STAGE_STARTS
    }
    final = F.when(status.isin("completed", "failed", "cancelled"), status).otherwise(F.coalesce("end.status", F.lit("pending")))
    final_at = F.when(status.isin("completed", "failed", "cancelled"), F.col("completed_at")).otherwise(F.col("end.at"))
    row = lambda name, st, ts: F.struct(name.alias("stage"), st.alias("status"), ts.alias("stage_at"))
    return j.select("job_id", F.inline(F.array(
        row(F.lit("Queued"), F.lit("completed"), F.coalesce("queued_at", "job_created")),
        *[row(F.lit(s), stage_status[s], F.col(f"{s}_at")) for s in STAGE_STARTS],
        row(F.initcap(F.when(final.isin("completed", "failed"), final).otherwise("terminal")), final, final_at),
    )))


def job_warnings(texts: DataFrame) -> DataFrame:
    """Low confidence and the stored warnings, which are a JSON list or a JSON object."""
    low = F.when(F.col("confidence") < 0.70, F.concat(
        F.lit("Low OCR confidence score detected: "), rounded(F.col("confidence") * 100, 1).cast("string"), F.lit("%")))
    as_list = F.from_json("warnings_json", "array<string>")
    as_map = F.from_json("warnings_json", "map<string,string>")
    pairs = F.transform(F.map_entries(as_map), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    stored = F.when(F.col("warnings_json").startswith("["), as_list).when(F.col("warnings_json").startswith("{"), pairs)
    every = F.filter(F.concat(F.array(low), F.coalesce(stored, F.array())), lambda w: w.isNotNull())
    return texts.select("doc_id", F.explode(every).alias("warning"))


def job_metrics(records: DataFrame, names=tuple(rules.JOB_METRICS)) -> DataFrame:
    """The last value of each named metric per job, 0 when missing; the job id sits in JSON."""
    job = F.get_json_object("metadata_json", "$.job_id").cast("long")
    at = F.struct("recorded_at", "record_id")
    return records.withColumn("job_id", job).filter("job_id is not null").groupBy("job_id").agg(*[
        F.coalesce(F.max_by("metric_value", F.when(F.col("metric_name") == n, at)), F.lit(0.0)).alias(n) for n in names])


def is_active(status: Column) -> Column:
    return status.isin(rules.ACTIVE_STATUSES)


def reject_active_duplicates(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with a flag: true when the document already has an active job of that type."""
    active = jobs.filter(is_active(F.col("status"))).select("document_id", "job_type").distinct().withColumn("_busy", F.lit(True))
    return requests.join(active, ["document_id", "job_type"], "left").withColumn(
        "rejected", F.coalesce("_busy", F.lit(False))).drop("_busy")


def retryable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries")))


def cancellable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin(rules.TERMINAL_STATUSES))


def fold_job_log(logs: DataFrame) -> DataFrame:
    """Current state of each job: its last log row, progress clamped to 0..100."""
    df = logs.withColumn("progress", F.least(F.greatest("progress", F.lit(0)), F.lit(100)))
    return last_by(df, ["job_id"], ["created_at", "log_id"], ["status", "progress", "step", "created_at", "log_id"])


def backlog_position(jobs: DataFrame) -> DataFrame:
    """1-based place in the waiting line; a document and type that waits twice counts once."""
    waiting = jobs.filter(F.col("status").isin("pending", "queued"))
    first = waiting.groupBy("document_id", "job_type").agg(F.min(F.struct("created_at", "job_id")).alias("f")).select(
        "document_id", "job_type", "f.created_at", "f.job_id")
    return running_sum(first, [], ["created_at", "job_id"], F.lit(1), "position").select("job_id", "document_id", "job_type", "position")
