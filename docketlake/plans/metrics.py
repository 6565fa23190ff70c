"""Queries over the metric bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import metrics as op
from ..sources.tables import load_table
from . import standins as st
from .registry import query
from .sqltext import CASE_CONTAINS

D = st.duck


def _bundle(src: str, category: str, cards=None, groups=None) -> str:
    """UNION ALL form of a bundle: one SELECT per card and per distribution."""
    parts = []
    for name, (expr, unit) in (cards or {}).items():
        parts.append(f"SELECT '{category}' AS category, 'metrics' AS section, '{name}' AS label, CAST({expr} AS DOUBLE) AS value, "
                     f"'{unit}' AS unit FROM {src}")
    for section, g in (groups or {}).items():
        label, agg, unit = g if isinstance(g, tuple) else (g, "count(*)", "count")
        parts.append(f"SELECT '{category}' AS category, '{section}' AS section, CAST({label} AS VARCHAR) AS label, CAST({agg} AS DOUBLE) AS "
                     f"value, '{unit}' AS unit FROM {src} GROUP BY {label}")
    return "\nUNION ALL ".join(parts)


def _share(part: str, digits: int = 1, empty: float = 100.0) -> str:
    return f"CASE WHEN count(*) > 0 THEN round({part} / count(*)::DOUBLE * 100.0, {digits}) ELSE {empty} END"


def _n(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


def _case_groups():
    dflt = lambda c, d: f"coalesce(nullif({c}, ''), '{d}')"
    return {
        "cases_by_status": "status",
        "cases_by_court": dflt("court_name", "Unknown Court"),
        "cases_by_jurisdiction": dflt("jurisdiction", "Unknown Jurisdiction"),
        "cases_by_category": CASE_CONTAINS("lower(coalesce(description, ''))", rules.CASE_CATEGORIES, rules.CASE_CATEGORY_DEFAULT),
        "cases_by_advocate": dflt("client_name", "Unknown Advocate"),
        "cases_by_judge": dflt("judge_name", "Unknown Judge"),
        "case_growth_trend": "strftime(created_at, '%Y-%m')",
    }


@query("j1_case_metrics", f"WITH c AS ({D(st.CASES)})\n" + _bundle("c", "cases", {
    "Total Cases": ("count(*)", "cases"), "Open Cases": (_n("status = 'open'"), "cases"), "Closed Cases": (_n("status = 'closed'"), "cases"),
    "Archived Cases": (_n("status = 'archived'"), "cases"), "Completion Rate": (_share(_n("status = 'closed'"), 4, 0.0), "%")}, _case_groups()))
def j1(spark, folder):
    return op.case_metrics(st.rows(spark, folder, st.CASES))


_SIZES = ("CASE WHEN file_size < 1048576 THEN '< 1MB' WHEN file_size <= 5242880 THEN '1MB - 5MB' WHEN file_size <= 10485760 THEN "
          "'5MB - 10MB' ELSE '> 10MB' END")


@query("j2_document_metrics", f"WITH d AS ({D(st.FILES)})\n" + _bundle("d", "documents", {
    "Total Documents": ("count(*)", "files"), "Storage Used": ("round(sum(file_size) / 1048576.0::DOUBLE, 2)", "MB"),
    "Success Rate": (_share(_n("status = 'processed'")), "%")}, {
    "documents_by_case": "coalesce(nullif(case_id, ''), 'Unassigned')", "documents_by_type": "coalesce(nullif(mime_type, ''), 'unknown')",
    "file_size_distribution": _SIZES, "processing_success_rates": "status", "upload_trends": "strftime(created_at, '%Y-%m')"})
    + """\nUNION ALL SELECT * FROM (SELECT 'documents', 'largest_documents', filename, round(file_size / 1048576.0::DOUBLE, 2), 'MB' FROM d
ORDER BY file_size DESC, doc_id LIMIT 5)""")
def j2(spark, folder):
    return op.document_metrics(st.rows(spark, folder, st.FILES))


_J3_STAGES = {"extraction_duration": "Extraction", "cleaning_duration": "Cleaning", "chunking_duration": "Chunking",
              "total_processing_duration": "Total Run"}


@query("j3_processing_metrics", f"WITH j AS ({D(st.JOBS)}), r AS ({D(st.JOB_METRICS)})\n" + _bundle("j", "processing", {
    "Total Jobs Run": ("count(*)", "jobs"), "Completed Jobs": (_n("status = 'completed'"), "jobs"),
    "Failed Jobs": (_n("status = 'failed'"), "jobs"), "Success Rate": (_share(_n("status = 'completed'")), "%")})
    + "".join(f"\nUNION ALL SELECT 'processing', 'stage_durations', '{label}', round(avg(metric_value), 2), 's' FROM r WHERE metric_name = '{m}'"
              for m, label in _J3_STAGES.items()))
def j3(spark, folder):
    return op.processing_metrics(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.JOB_METRICS))


_VECTORS = "SELECT vec_id, embedding, label, vec_id % 3 > 0 AS is_synced FROM {embeddings}"
_SECS = "(epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0::DOUBLE"


@query("j4_embedding_metrics", f"WITH v AS ({D(_VECTORS)}), j AS (SELECT * FROM ({D(st.JOBS)}) WHERE job_type = 'embeddings' AND status = 'completed')\n"
       + _bundle("v", "embeddings", {"Vectors": ("count(*)", "vectors"), "Dimension": ("max(len(embedding))", "dims")}) + "\nUNION ALL "
       + _bundle("j", "embeddings", {"Avg Latency": (f"round(avg({_SECS}), 2)", "s")}))
def j4(spark, folder):
    jobs = st.rows(spark, folder, st.JOBS).filter("job_type = 'embeddings'")
    return op.embedding_metrics(load_table(spark, folder, "embeddings"), jobs)


@query("j5_vector_index_metrics", f"WITH v AS ({D(_VECTORS)}), j AS (SELECT * FROM ({D(st.JOBS)}) WHERE job_type = 'vector_sync')\n"
       + _bundle("j", "vector_index", {"Sync Jobs": ("count(*)", "jobs"), "Successful Syncs": (_n("status = 'completed'"), "jobs"),
                                      "Failed Syncs": (_n("status = 'failed'"), "jobs")}) + "\nUNION ALL "
       + _bundle("v", "vector_index", {"Total Vectors": ("count(*)", "vectors"), "Synced Vectors": (_n("is_synced"), "vectors")}))
def j5(spark, folder):
    return op.vector_index_metrics(st.rows(spark, folder, _VECTORS), st.rows(spark, folder, st.JOBS).filter("job_type = 'vector_sync'"))


@query("j6_retrieval_metrics", f"WITH l AS ({D(st.RETRIEVAL_LOG)})\n" + _bundle("l", "retrieval", {
    "Search Queries": ("count(*)", "searches"), "Avg Latency": ("round(avg(latency_ms), 1)", "ms"),
    "Avg Chunks": ("round(avg(chunks_returned), 1)", "chunks"), "Avg Relevance": ("round(avg(top_score) * 100.0::DOUBLE, 1)", "%")},
    {"query_categories": CASE_CONTAINS("lower(query_text)", rules.QUERY_CATEGORIES, rules.QUERY_CATEGORY_DEFAULT)}))
def j6(spark, folder):
    return op.retrieval_metrics(st.rows(spark, folder, st.RETRIEVAL_LOG))


@query("j7_conversation_metrics", f"WITH s AS (SELECT session_id, count(*) AS n FROM ({D(st.MESSAGES)}) GROUP BY 1)\n" + _bundle("s", "conversations", {
    "Sessions": ("count(*)", "sessions"), "Messages": ("sum(n)", "msgs"), "Avg Messages": ("round(sum(n) / count(*)::DOUBLE, 1)", "msgs")})
    + """\nUNION ALL SELECT * FROM (SELECT 'conversations', 'messages_per_session', concat('Session ', session_id), CAST(n AS DOUBLE), 'msgs'
FROM s ORDER BY session_id LIMIT 5)""")
def j7(spark, folder):
    return op.conversation_metrics(st.rows(spark, folder, st.MESSAGES), first=5)


_USAGE = f"""SELECT *, ok, CAST(u->>'$.prompt_tokens' AS BIGINT) AS pt, CAST(u->>'$.completion_tokens' AS BIGINT) AS ct,
  CAST(u->>'$.estimated_cost' AS DOUBLE) AS cost, coalesce(u->>'$.model_used', 'mock') AS model FROM (SELECT *, u IS NOT NULL AS ok FROM
  (SELECT *, CASE WHEN json_valid(token_usage_json) THEN CAST(token_usage_json AS JSON) END AS u FROM ({D(st.MESSAGES)}) WHERE role = 'assistant'))"""


@query("j8_model_metrics", f"WITH m AS ({_USAGE})\n" + _bundle("m", "models", {
    "Total Requests": ("count(*)", "reqs"), "Avg Latency": ("round(avg(latency_ms), 1)", "ms")}, {"requests_by_model": "model"}))
def j8(spark, folder):
    return op.model_metrics(st.rows(spark, folder, st.MESSAGES))


@query("j9_token_metrics", f"WITH m AS (SELECT * FROM ({_USAGE}) WHERE ok)\n" + _bundle("m", "tokens", {
    "Prompt Tokens": ("sum(pt)", "tokens"), "Completion Tokens": ("sum(ct)", "tokens"), "Total Tokens": ("sum(pt + ct)", "tokens")},
    {"tokens_by_model": ("model", "sum(pt + ct)", "tokens")}))
def j9(spark, folder):
    return op.token_metrics(st.rows(spark, folder, st.MESSAGES))


_COST = "coalesce(sum(cost), 0)"


@query("j10_cost_metrics", f"WITH m AS ({_USAGE})\n" + _bundle("m", "cost", {
    "Total Spend": (f"round({_COST}, 4)", "USD"), "Avg Cost / Req": (f"round({_COST} / count(*), 4)", "USD"),
    "Projected Monthly": (f"round({_COST} * 30, 2)", "USD")},
    {"cost_by_model": ("CASE WHEN ok THEN model ELSE '(no usage)' END", f"round({_COST}, 4)", "USD")}))
def j10(spark, folder):
    return op.cost_metrics(st.rows(spark, folder, st.MESSAGES))


@query("j11_citation_metrics", f"""WITH m AS (SELECT *, CAST(citations_json AS JSON) AS c FROM ({D(st.MESSAGES)}) WHERE role = 'assistant'),
e AS (SELECT unnest(from_json(c, '["JSON"]'))->>'$.document_title' AS t FROM m)
SELECT 'citations' AS category, 'metrics' AS section, 'Citations Logged' AS label, CAST(sum(coalesce(json_array_length(c), 0)) AS DOUBLE) AS value, 'cites' AS unit FROM m
UNION ALL SELECT 'citations', 'metrics', 'Avg Citations / Chat', round(sum(coalesce(json_array_length(c), 0)) / count(*)::DOUBLE, 1), 'cites' FROM m
UNION ALL SELECT 'citations', 'citations_by_document', t, count(*)::DOUBLE, 'count' FROM e GROUP BY t""")
def j11(spark, folder):
    return op.citation_metrics(st.rows(spark, folder, st.MESSAGES))


_TL = """SELECT event_id, CASE event_type WHEN 'signup' THEN '' ELSE event_type END AS event_type,
  CASE WHEN value < 5 THEN NULL ELSE ts END AS event_date FROM {events}"""


@query("j12_timeline_metrics", f"WITH e AS ({D(_TL)})\n" + _bundle("e", "timeline", {
    "Timeline Events": ("count(*)", "events"), "Missing Dates": (_n("event_date IS NULL"), "events"),
    "Timeline Completeness": (_share(_n("event_date IS NOT NULL")), "%")},
    {"event_categories": "coalesce(nullif(event_type, ''), 'General Event')"}))
def j12(spark, folder):
    return op.timeline_metrics(st.rows(spark, folder, _TL))


@query("j16_overview", f"WITH c AS ({D(st.CASES)}), s AS (SELECT DISTINCT session_id FROM ({D(st.MESSAGES)}))\n"
       + _bundle("c", "overview", {"Total Cases": ("count(*)", "cases")}, {k: v for k, v in _case_groups().items() if k in ("cases_by_status", "case_growth_trend")})
       + "\nUNION ALL " + _bundle("documents", "overview", {"Total Documents": ("count(*)", "files")})
       + "\nUNION ALL " + _bundle("events", "overview", {"Timeline Events": ("count(*)", "events")})
       + "\nUNION ALL " + _bundle("s", "overview", {"Sessions": ("count(*)", "sessions")}))
def j16(spark, folder):
    return op.overview(st.rows(spark, folder, st.CASES), load_table(spark, folder, "documents"), load_table(spark, folder, "events"),
                       st.rows(spark, folder, st.MESSAGES))


@query("j17_dashboard", f"""WITH c AS ({D(st.CASES)}), d AS ({D(st.FILES)}), j AS ({D(st.JOBS)})
SELECT * FROM (SELECT {_n("NOT archived")} AS total_cases, {_n("NOT archived AND status = 'open'")} AS open_cases,
  {_n("NOT archived AND status = 'closed'")} AS closed_cases, {_n("archived")} AS archived_cases, {_n("NOT archived AND priority = 'urgent'")} AS urgent_cases FROM c),
  (SELECT count(*) AS documents, {_n("is_favorite")} AS favorites FROM d),
  (SELECT {_n("status IN ('pending', 'queued')")} AS queued_jobs, {_n("status IN ('starting', 'running')")} AS running_jobs, {_n("status = 'failed'")} AS failed_jobs FROM j)""")
def j17(spark, folder):
    return op.dashboard(st.rows(spark, folder, st.CASES), st.rows(spark, folder, st.FILES), st.rows(spark, folder, st.JOBS))


_AS_OF = "2024-01-15 10:00:00"
_RUN = f"CASE WHEN status = 'completed' THEN {_SECS} END"


@query("j18_job_stats", f"""WITH j AS ({D(st.JOBS)}) SELECT user_id, {_n("status = 'pending'")} AS pending, {_n("status = 'queued'")} AS queued,
  {_n("status IN ('running', 'starting')")} AS running, {_n("status = 'completed'")} AS completed, {_n("status = 'failed'")} AS failed,
  {_n("status = 'cancelled'")} AS cancelled, {_n("status = 'completed' AND completed_at >= TIMESTAMP '2024-01-15'")} AS completed_today,
  round(avg({_RUN}), 6) AS average_duration_seconds FROM j GROUP BY user_id""")
def j18(spark, folder):
    return op.job_stats(st.rows(spark, folder, st.JOBS), _AS_OF, by=["user_id"], digits=6)


@query("j19_job_dashboard", f"""WITH j AS (SELECT user_id, count(*) AS total_jobs, {_n("status IN ('queued', 'pending')")} AS queued,
  {_n("status IN ('running', 'starting')")} AS running, {_n("status = 'completed'")} AS completed, {_n("status = 'failed'")} AS failed,
  {_n("status = 'cancelled'")} AS cancelled, avg({_RUN}) AS run, avg((epoch_us(started_at) - epoch_us(created_at)) / 1000000.0::DOUBLE) AS wait
  FROM ({D(st.JOBS)}) GROUP BY user_id),
r AS (SELECT user_id, avg(metric_value) FILTER (metric_name = 'total_processing_duration') AS m_run, avg(metric_value) FILTER
  (metric_name = 'queue_wait_time') AS m_wait FROM ({D(st.JOB_METRICS)}) GROUP BY user_id)
SELECT j.user_id, total_jobs, queued, running, completed, failed, cancelled, CASE WHEN completed + failed + cancelled > 0 THEN
  round(completed / (completed + failed + cancelled)::DOUBLE * 100, 2) ELSE 100 END AS success_rate,
  coalesce(round(coalesce(m_run, run), 2), 0) AS average_processing_time, coalesce(round(coalesce(m_wait, wait), 2), 0) AS average_queue_time
FROM j LEFT JOIN r USING (user_id)""")
def j19(spark, folder):
    return op.job_dashboard(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.JOB_METRICS), ["user_id"])


@query("j20_queue_health", f"""SELECT * FROM (SELECT {_n("status IN ('pending', 'queued')")} AS waiting_jobs, {_n("status IN ('starting', 'running')")} AS running_jobs,
  CAST(sum(retry_count) AS BIGINT) AS retry_count, {_n("status = 'failed'")} AS failed_jobs FROM ({D(st.JOBS)})),
  (SELECT round(avg(metric_value) FILTER (metric_name = 'queue_wait_time'), 2) AS average_wait_time, round(avg(metric_value) FILTER
  (metric_name = 'worker_execution_time'), 2) AS average_processing_duration FROM ({D(st.JOB_METRICS)}))""")
def j20(spark, folder):
    return op.queue_health(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.JOB_METRICS))


_DAY = lambda c: f"CAST({c} AS DATE)"


@query("j21_daily_trend", f"""WITH j AS ({D(st.JOBS)}), r AS ({D(st.JOB_METRICS)}),
days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(day, '%Y-%m-%d') AS date, (SELECT count(*) FROM j WHERE {_DAY('created_at')} = day) AS total_jobs,
  (SELECT count(*) FROM j WHERE status = 'completed' AND {_DAY('completed_at')} = day) AS success_count,
  (SELECT count(*) FROM j WHERE status = 'failed' AND {_DAY('completed_at')} = day) AS failure_count,
  coalesce((SELECT round(avg(metric_value), 2) FROM r WHERE metric_name = 'total_processing_duration' AND {_DAY('recorded_at')} = day), 0)
  AS avg_processing_time FROM days""")
def j21_trend(spark, folder):
    return op.daily_trend(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.JOB_METRICS), "2023-12-28", "2024-02-03")


_TEXTS = "SELECT doc_id, text, CAST(1 + n_chars // 3000 AS INT) AS page_count FROM documents"


@query("j21_performance_report", f"""WITH j AS ({D(st.JOBS)}), r AS ({D(st.JOB_METRICS)}), t AS ({_TEXTS}),
c AS (SELECT doc_id, len(string_split(text, '. ')) AS n FROM documents)
SELECT * FROM (SELECT {', '.join(f"coalesce(round(avg(metric_value) FILTER (metric_name = '{m}'), 2), 0) AS {a}" for m, a in [
    ('total_processing_duration', 'average_processing_time'), ('extraction_duration', 'average_extraction_time'),
    ('cleaning_duration', 'average_cleaning_time'), ('chunking_duration', 'average_chunking_time')])} FROM r),
  (SELECT {_share(_n("status = 'completed'"), 2)} AS success_rate, {_share(_n("retry_count > 0"), 2, 0.0)} AS retry_rate,
   {_share(_n("status = 'failed'"), 2, 0.0)} AS failure_rate FROM j),
  (SELECT max(CAST(length(text) AS INT)) AS largest_processed_document_size, min(CAST(length(text) AS INT)) AS smallest_processed_document_size,
   round(avg(page_count), 2) AS average_pages_processed FROM t), (SELECT round(avg(n), 2) AS average_chunks_generated FROM c)""")
def j21(spark, folder):
    docs = load_table(spark, folder, "documents")
    texts = docs.select("doc_id", "text", (1 + F.floor(F.col("n_chars") / 3000)).cast("int").alias("page_count"))
    parts = docs.select("doc_id", F.explode(F.split("text", r"\. ")).alias("c"))
    return op.performance_report(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.JOB_METRICS), texts, parts)
