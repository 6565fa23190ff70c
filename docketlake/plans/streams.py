"""Queries that run a stream over the given tables and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..session import checkpoint_dir
from ..streaming import streams as op
from . import standins as st
from .jobs import _FOLD
from .registry import query

D = st.duck


def _folders(spark):
    """A fresh output and checkpoint folder in the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/ckpt"


@query("l1_stream_ingest")
def l1(spark, folder):
    """Documents as a stream through cleaning and chunking into a chunk table."""
    docs = op.stream_table(spark, folder, "documents").withColumn("category", F.when(F.col("lang") == "en", "pdf").otherwise("text"))
    out, ckpt = _folders(spark)
    op.stream_ingest(docs, out, ckpt).awaitTermination()
    chunks = spark.read.parquet(out)
    return chunks.groupBy("strategy").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("chars").alias("chars"))


@query("l2_stream_dedupe", "SELECT DISTINCT user_id, event_type, props FROM events")
def l2(spark, folder):
    df = op.stream_dedupe(op.stream_table(spark, folder, "events"), ["user_id", "event_type", "props"], delay="40 days")
    return op.run_append(df.select("user_id", "event_type", "props"), *_folders(spark))


_MAX = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("l3_windowed_activity", f"""SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY event_type, date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_MAX}""")
def l3(spark, folder):
    df = op.windowed_activity(op.stream_table(spark, folder, "events"), "1 day", by=["event_type"], aggs=[F.count("*").alias("events"), rounded(F.sum("value"), 4).alias("value")])
    out = op.run_append(df, *_folders(spark))
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "events", "value")


@query("l3_sliding_activity", f"""WITH h AS (SELECT unnest([0, 1, 2, 3]) AS k), e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS s FROM events, h)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) AS events FROM e GROUP BY s HAVING s + INTERVAL 1 DAY <= {_MAX}""")
def l3_sliding(spark, folder):
    df = op.windowed_activity(op.stream_table(spark, folder, "events"), "1 day", "6 hours")
    return op.run_append(df, *_folders(spark)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "events")


@query("l4_session_activity", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_MAX}""")
def l4(spark, folder):
    out = op.run_append(op.session_activity(op.stream_table(spark, folder, "events")), *_folders(spark))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


def _logs(spark, folder):
    """The job log stand-in as a stream."""
    events = op.stream_table(spark, folder, "events")
    return spark.sql(st.JOB_LOGS, events=events)


@query("l5_job_state_stream", _FOLD)
def l5(spark, folder):
    out, ckpt = _folders(spark)
    op.job_state_stream(_logs(spark, folder), out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("job_id", "status", "progress", "step", "log_id")


@query("l5_closed_jobs", f"""WITH l AS ({D(st.JOB_LOGS)}), g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY job_id ORDER BY created_at, log_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM l),
s AS (SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY created_at, log_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT job_id, max(log_id) FILTER (log_id = last) AS log_id, arg_max(status, (created_at, log_id)) AS status, arg_max(status, (created_at, log_id)) NOT IN ('completed', 'failed', 'cancelled') AS stuck
FROM (SELECT *, last_value(log_id) OVER (PARTITION BY job_id, k ORDER BY created_at, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM s) GROUP BY job_id, k HAVING max(created_at) + INTERVAL 6 HOUR <= {_MAX}""")
def l5_closed(spark, folder):
    return op.run_append(op.closed_jobs(_logs(spark, folder)), *_folders(spark)).select("job_id", "log_id", "status", "stuck")


@query("l5_job_monitor", f"""WITH l AS ({D(st.JOB_LOGS)}), s AS (SELECT job_id, arg_max(status, (created_at, log_id)) AS status, least(greatest(arg_max(progress, (created_at, log_id)), 0), 100) AS progress,
arg_max(log_id, (created_at, log_id)) AS log_id, max(created_at) AS last_at FROM l GROUP BY job_id)
SELECT job_id, log_id, status, CAST(progress AS INTEGER) AS progress, CASE WHEN last_at + INTERVAL 6 HOUR > {_MAX} THEN 'update' WHEN status IN ('completed', 'failed', 'cancelled') THEN 'closed' ELSE 'stuck' END AS kind FROM s""")
def l5_monitor(spark, folder):
    """Job state held by the stream, with timers that tell stuck jobs and drop finished ones."""
    out, ckpt = _folders(spark)
    op.job_monitor_stream(_logs(spark, folder), out, ckpt).awaitTermination()
    return op.current_jobs(spark.read.parquet(out)).select("job_id", "log_id", "status", "progress", "kind")
