"""Queries over the job table, its log and its metric records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import jobs as op
from . import standins as st
from .registry import query
from .sqltext import LIKE_ANY

D = st.duck
_JOBS_OF_USER = """SELECT user_id AS job_id, user_id, user_id % 200 AS document_id, CASE user_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed'
  WHEN 2 THEN 'cancelled' ELSE 'running' END AS status, min(ts) AS created_at, max(ts) AS completed_at FROM {events} GROUP BY user_id"""


def _stage_sql() -> str:
    msg = "lower(message)"
    aggs = [f"max(created_at) FILTER ({LIKE_ANY(msg, ['queued', 'created'])}) AS queued_at"]
    for s in op.STAGE_STARTS:
        a, b = LIKE_ANY(msg, op.STAGE_STARTS[s]), LIKE_ANY(msg, op.STAGE_ENDS[s])
        aggs.append(f"arg_max(CASE WHEN {b} THEN 'completed' ELSE 'running' END, (created_at, log_id)) FILTER ({a} OR {b}) AS {s}_status")
        aggs.append(f"max(created_at) FILTER ({a}) AS {s}_at")
    end = LIKE_ANY(msg, ["completed", "finished", "failed"])
    aggs.append(f"arg_max(CASE WHEN contains({msg}, 'failed') THEN 'failed' ELSE 'completed' END, (created_at, log_id)) FILTER ({end}) AS end_status")
    aggs.append(f"max(created_at) FILTER ({end}) AS end_at")
    fix = lambda s: f"coalesce({s}_status, 'pending')"
    failing = f"CASE WHEN {fix('Chunking')} = 'running' THEN 'Chunking' WHEN {fix('Cleaning')} = 'running' THEN 'Cleaning' WHEN {fix('Extraction')} = 'running' THEN 'Extraction' END"
    term = "status IN ('completed', 'failed', 'cancelled')"
    final = f"CASE WHEN {term} THEN status ELSE coalesce(end_status, 'pending') END"
    rows = ["SELECT job_id, 'Queued' AS stage, 'completed' AS status, coalesce(queued_at, created_at) AS stage_at FROM f"]
    for s in op.STAGE_STARTS:
        rows.append(f"SELECT job_id, '{s}', CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'failed' AND {failing} = '{s}' THEN 'failed' ELSE {fix(s)} END, {s}_at FROM f")
    rows.append(f"SELECT job_id, CASE {final} WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' ELSE 'Terminal' END, {final}, CASE WHEN {term} THEN completed_at ELSE end_at END FROM f")
    return (f"WITH j AS ({D(_JOBS_OF_USER)}), g AS (SELECT job_id, {', '.join(aggs)} FROM ({D(st.JOB_LOGS)}) GROUP BY job_id),\n"
            "f AS (SELECT j.*, g.* EXCLUDE (job_id) FROM j LEFT JOIN g USING (job_id))\n"
            "SELECT job_id, stage, status, strftime(stage_at, '%Y-%m-%d %H:%M:%S') AS stage_at FROM (" + " UNION ALL ".join(rows) + ")")


@query("j22_job_stage_timeline", _stage_sql())
def j22(spark, folder):
    return op.job_stage_timeline(st.rows(spark, folder, _JOBS_OF_USER), st.rows(spark, folder, st.JOB_LOGS)).withColumn(
        "stage_at", F.date_format("stage_at", "yyyy-MM-dd HH:mm:ss"))


_WARN = """SELECT doc_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence, CASE doc_id % 4 WHEN 0 THEN '["blurred page","no text layer"]'
  WHEN 1 THEN concat(chr(123), '"page": "blank"', chr(125)) WHEN 2 THEN 'broken' END AS warnings_json FROM {documents}"""


@query("j23_job_warnings", f"""WITH w AS ({D(_WARN)})
SELECT doc_id, concat('Low OCR confidence score detected: ', round(confidence * 100, 1), '%') AS warning FROM w WHERE confidence < 0.7
UNION ALL SELECT doc_id, unnest(['blurred page', 'no text layer']) FROM w WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'page: blank' FROM w WHERE doc_id % 4 = 1""")
def j23(spark, folder):
    return op.job_warnings(st.rows(spark, folder, _WARN))


@query("j24_job_metrics", f"""WITH r AS (SELECT *, CAST(metadata_json->>'$.job_id' AS BIGINT) AS job_id FROM ({D(st.JOB_METRICS)}))
SELECT job_id, {', '.join(f"coalesce(arg_max(metric_value, (recorded_at, record_id)) FILTER (metric_name = '{m}'), 0) AS {m}" for m in rules.JOB_METRICS)}
FROM r GROUP BY job_id""")
def j24(spark, folder):
    return op.job_metrics(st.rows(spark, folder, st.JOB_METRICS))


_REQUESTS = "SELECT doc_id AS document_id, CASE doc_id % 2 WHEN 0 THEN 'embeddings' ELSE 'vector_sync' END AS job_type FROM {documents}"
_OLD_JOBS = f"SELECT * FROM ({st.JOBS}) q"


@query("k1_reject_active_duplicates", f"""WITH r AS ({D(_REQUESTS)}), a AS (SELECT DISTINCT document_id, job_type FROM ({D(_OLD_JOBS)}) WHERE status IN
  ('pending', 'queued', 'starting', 'running'))
SELECT r.document_id, r.job_type, a.document_id IS NOT NULL AS rejected FROM r LEFT JOIN a ON a.document_id = r.document_id AND a.job_type = r.job_type""")
def k1(spark, folder):
    return op.reject_active_duplicates(st.rows(spark, folder, _REQUESTS), st.rows(spark, folder, _OLD_JOBS))


@query("k2_retryable_jobs", f"SELECT job_id, status, retry_count FROM ({D(st.JOBS)}) WHERE status = 'failed' AND retry_count < max_retries")
def k2(spark, folder):
    return op.retryable_jobs(st.rows(spark, folder, st.JOBS)).select("job_id", "status", "retry_count")


@query("k2_cancellable_jobs", f"SELECT job_id, status FROM ({D(st.JOBS)}) WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def k2b(spark, folder):
    return op.cancellable_jobs(st.rows(spark, folder, st.JOBS)).select("job_id", "status")


_FOLD = f"""SELECT job_id, arg_max(status, o) AS status, CAST(arg_max(least(greatest(progress, 0), 100), o) AS INTEGER) AS progress, arg_max(step, o) AS step,
  max(log_id) FILTER (log_id = last_id) AS log_id FROM (SELECT *, (created_at, log_id) AS o, last_value(log_id) OVER (PARTITION BY job_id
  ORDER BY created_at, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM ({D(st.JOB_LOGS)})) GROUP BY job_id"""


@query("k3_fold_job_log", _FOLD)
def k3(spark, folder):
    return op.fold_job_log(st.rows(spark, folder, st.JOB_LOGS)).select("job_id", "status", "progress", "step", "log_id")


_WAITING = st.JOBS


@query("k4_backlog_position", f"""WITH f AS (SELECT document_id, job_type, min((created_at, job_id)) AS m FROM ({D(_WAITING)}) WHERE status IN ('pending', 'queued')
  GROUP BY document_id, job_type)
SELECT m[2] AS job_id, document_id, job_type, row_number() OVER (ORDER BY m) AS position FROM f""")
def k4(spark, folder):
    return op.backlog_position(st.rows(spark, folder, _WAITING))
