"""Queries over listings, paging and bulk edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning
from ..operators import jobs as job_rules
from ..operators import listing as op
from ..sources.tables import load_table
from . import standins as st
from .registry import query

D = st.duck
_LIKE = lambda cols, t: "(" + " OR ".join(f"coalesce({c} ILIKE '%{t}%', false)" for c in cols) + ")"


_B1 = f"""FROM ({D(st.FILES)}) WHERE owner_id = 'owner1' AND status = 'processed' AND user_tags ILIKE '%EN%' AND created_at >= TIMESTAMP '2024-01-01'
  AND created_at <= TIMESTAMP '2031-01-01' AND {_LIKE(['title', 'filename', 'user_tags'], 'Src1')}"""


def _b1(spark, folder):
    return op.search(st.rows(spark, folder, st.FILES), {"owner_id": "owner1", "status": "processed", "case_id": None}, "Src1",
                     ["title", "filename", "user_tags"], tag="EN", since="2024-01-01", until="2031-01-01")


@query("b1_search_documents", f"SELECT doc_id, filename, status, is_favorite {_B1} ORDER BY is_favorite DESC, created_at DESC, doc_id LIMIT 10 OFFSET 10")
def b1(spark, folder):
    order = op.sort_order(op.DOCUMENT_SORTS, "newest", "doc_id", favorites_first=True)
    return op.page_of(_b1(spark, folder), order, page=2).select("doc_id", "filename", "status", "is_favorite")


@query("b1_search_documents_info", f"SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 10) AS BIGINT), 1) AS total_pages {_B1}")
def b1_info(spark, folder):
    return op.page_info(_b1(spark, folder))


@query("b2_search_cases", f"""SELECT case_id, title, status FROM ({D(st.CASES)}) WHERE NOT archived AND status = 'open' AND {_LIKE(
    ['title', 'case_number', 'client_name', 'court_name'], 'build')} ORDER BY created_at DESC, case_id LIMIT 25""")
def b2(spark, folder):
    df = op.search_cases(st.rows(spark, folder, st.CASES), None, False, "build", status="open", priority="bogus",
                         statuses=["open", "closed"], priorities=["low", "high", "urgent"])
    return op.page_of(df, op.sort_order(op.CASE_SORTS, "newest", "case_id"), 1, 25).select("case_id", "title", "status")


_ITEMS = "SELECT p_partkey AS id, p_type AS kind, p_brand AS case_id, p_name AS name FROM {part}"


@query("b3_list_items", f"SELECT id, case_id, name FROM ({D(_ITEMS)}) WHERE kind = 'ECONOMY' AND name ILIKE '%RING%'")
def b3(spark, folder):
    return op.list_items(st.rows(spark, folder, _ITEMS), None, "ECONOMY", "kind", "RING", ["name"]).select("id", "case_id", "name")


_EV = "SELECT event_id, user_id AS case_id, event_type AS title, props AS description, ts FROM {events}"


@query("b4_search_timeline", f"SELECT event_id, case_id, title FROM ({D(_EV)}) WHERE contains(lower(title), 'sign') OR contains(lower(description), '77')")
def b4(spark, folder):
    df = st.rows(spark, folder, _EV)
    return op.search_timeline(df, "SIGN").select("event_id", "case_id", "title").union(
        op.search_timeline(df, "77").select("event_id", "case_id", "title")).distinct()


@query("b5_active_jobs", f"SELECT job_id, status, document_id FROM ({D(st.JOBS)}) WHERE status IN ('pending', 'queued', 'starting', 'running')")
def b5(spark, folder):
    df = st.rows(spark, folder, st.JOBS)
    return df.filter(job_rules.is_active(F.col("status"))).select("job_id", "status", "document_id")


@query("b5_list_jobs", f"SELECT job_id, status FROM ({D(st.JOBS)}) WHERE status = 'failed' AND job_type = 'embeddings' ORDER BY created_at DESC, job_id LIMIT 20")
def b5_list(spark, folder):
    df = op.search(st.rows(spark, folder, st.JOBS), {"status": "failed", "job_type": "embeddings"})
    return op.page_of(df, [F.desc("created_at"), F.asc("job_id")], 1, 20).select("job_id", "status")


_OWNERS = "SELECT DISTINCT user_id AS job_id, user_id % 7 AS user_id FROM {events}"


@query("b6_search_logs", f"""SELECT log_id, l.job_id, user_id, message FROM ({D(st.JOB_LOGS)}) l JOIN ({D(_OWNERS)}) o ON o.job_id = l.job_id
  WHERE level = 'ERROR' AND message ILIKE '%FAILED%'""")
def b6(spark, folder):
    return op.search_logs(st.rows(spark, folder, st.JOB_LOGS), st.rows(spark, folder, _OWNERS), None, "FAILED", "ERROR").select(
        "log_id", "job_id", "user_id", "message")


@query("b7_recent_documents", f"""SELECT doc_id, filename FROM ({D(st.FILES)}) ORDER BY last_accessed DESC NULLS LAST, created_at DESC, doc_id LIMIT 15""")
def b7(spark, folder):
    return op.recent_documents(st.rows(spark, folder, st.FILES), 15).select("doc_id", "filename")


@query("b8_owner_jobs", f"""SELECT job_id, document_id, title FROM ({D(st.JOBS)}) j JOIN ({D(st.FILES)}) f ON f.doc_id = j.document_id WHERE owner_id = 'owner2'
  AND job_type = 'embeddings' ORDER BY started_at DESC NULLS LAST, job_id LIMIT 30""")
def b8(spark, folder):
    df = op.owner_jobs(st.rows(spark, folder, st.JOBS), st.rows(spark, folder, st.FILES), "owner2", "embeddings")
    return op.page_of(df, [F.desc_nulls_last("started_at"), F.asc("job_id")], 1, 30).select("job_id", "document_id", "title")


@query("b8_retrieval_history", f"SELECT log_id, query_text FROM ({D(st.RETRIEVAL_LOG)}) WHERE user_id = 3 ORDER BY created_at DESC, log_id LIMIT 10")
def b8_history(spark, folder):
    df = op.search(st.rows(spark, folder, st.RETRIEVAL_LOG), {"user_id": 3})
    return op.page_of(df, [F.desc("created_at"), F.asc("log_id")]).select("log_id", "query_text")


@query("b9_sessions_with_counts", """WITH s AS (SELECT DISTINCT user_id AS session_id FROM events)
SELECT s.session_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = s.session_id) AS messages FROM s""")
def b9(spark, folder):
    sessions = load_table(spark, folder, "events").select(F.col("user_id").alias("session_id")).distinct()
    messages = load_table(spark, folder, "conversations").withColumnRenamed("conv_id", "session_id")
    return op.sessions_with_counts(sessions, messages)


@query("b10_latest_user_message", """SELECT conv_id AS session_id, turn, text FROM conversations WHERE role = 'user'
  QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)""")
def b10(spark, folder):
    return op.latest_user_message(load_table(spark, folder, "conversations").withColumnRenamed("conv_id", "session_id"))


@query("b11_session_messages", "SELECT turn, role, text FROM conversations WHERE conv_id = 7")
def b11(spark, folder):
    return load_table(spark, folder, "conversations").filter("conv_id = 7").orderBy("turn").select("turn", "role", "text")


@query("b12_text_preview", "SELECT doc_id, left(text, 1000) AS preview FROM documents")
def b12(spark, folder):
    return load_table(spark, folder, "documents").select("doc_id", op.text_preview("text").alias("preview"))


@query("b12_raw_vs_clean")
def b12_both(spark, folder):
    docs = st.documents(spark, folder).withColumn("category", F.lit("docx"))
    both = op.raw_vs_clean(docs, cleaning.clean_documents(docs))
    return both.select("doc_id", F.length("raw_text").alias("raw_chars"), F.length("cleaned").alias("clean_chars"),
                       F.col("report.characters_removed").alias("characters_removed"))


_OWN = "SELECT doc_id, source AS case_id, concat('owner', doc_id % 2) AS owner_id FROM {documents}"
_EVEN = "SELECT DISTINCT doc_id - doc_id % 2 AS doc_id FROM {labels}"


@query("b13_bulk_check", f"""WITH d AS ({D(_OWN)}), i AS (SELECT DISTINCT vec_id * 5 AS doc_id FROM embeddings)
SELECT i.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' ELSE 'not_owner' END AS reason FROM i LEFT JOIN d USING (doc_id)
WHERE d.doc_id IS NULL OR owner_id <> 'owner0'""")
def b13_check(spark, folder):
    ids = load_table(spark, folder, "embeddings").select((F.col("vec_id") * 5).alias("doc_id"))
    return op.bulk_check(ids, st.rows(spark, folder, _OWN), "owner0")


@query("b13_bulk_reassign", f"""SELECT doc_id, CASE WHEN doc_id IN ({D(_EVEN)}) THEN 'new case' ELSE case_id END AS case_id FROM ({D(_OWN)})""")
def b13(spark, folder):
    return op.bulk_reassign(st.rows(spark, folder, _OWN), st.rows(spark, folder, _EVEN), "new case", "owner0").select("doc_id", "case_id")


@query("b13_bulk_delete", f"SELECT doc_id, case_id FROM ({D(_OWN)}) WHERE doc_id NOT IN ({D(_EVEN)})")
def b13_delete(spark, folder):
    return op.bulk_delete(st.rows(spark, folder, _OWN), st.rows(spark, folder, _EVEN), "owner0").select("doc_id", "case_id")


@query("b14_set_archived", "SELECT o_orderkey AS case_id, o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AS archived FROM orders")
def b14(spark, folder):
    cases = load_table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "P").alias("archived"))
    ids = load_table(spark, folder, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("case_id"))
    return op.set_flag(cases, ids, "archived", F.lit(True), "case_id")


@query("b14_toggle_favorite", f"SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM ({D(st.FILES)})")
def b14_favorite(spark, folder):
    return op.set_flag(st.rows(spark, folder, st.FILES), load_table(spark, folder, "labels"), "is_favorite", ~F.col("is_favorite"), "doc_id").select(
        "doc_id", "is_favorite")


@query("b14_update_tags", "SELECT doc_id, concat(lang, ',', source) AS tags, 2 AS n_tags FROM documents")
def b14_tags(spark, folder):
    raw = F.concat(F.lit(" "), "lang", F.lit(" ,, "), "source", F.lit(","))
    return load_table(spark, folder, "documents").select("doc_id", op.tags_to_list(raw).alias("t")).select(
        "doc_id", op.tags_to_text("t").alias("tags"), F.size("t").alias("n_tags"))


@query("b15_unique_violations", """SELECT c_nationkey, c_mktsegment, count(*) AS rows FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2
  HAVING count(*) > 1""")
def b15(spark, folder):
    return op.unique_violations(load_table(spark, folder, "customer"), ["c_nationkey", "c_mktsegment"])


@query("b16_active_version", """SELECT conv_id, role, max(turn) AS version, arg_max(text, turn) AS text, count(*) + 1 AS next_version FROM conversations GROUP BY conv_id, role""")
def b16(spark, folder):
    v = load_table(spark, folder, "conversations").withColumnRenamed("turn", "version")
    return op.active_version(v, ["conv_id", "role"]).select("conv_id", "role", "version", "text", "next_version")


@query("b16_activate_version", """WITH c AS (SELECT conv_id, min(turn) AS pick FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT v.conv_id, turn AS version, CASE WHEN pick IS NULL THEN turn = 0 ELSE turn = pick END AS is_active FROM conversations v LEFT JOIN c USING (conv_id)""")
def b16_activate(spark, folder):
    v = load_table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("version"), "role", (F.col("turn") == 0).alias("is_active"))
    chosen = v.filter("role = 'assistant'").groupBy("conv_id").agg(F.min("version").alias("version"))
    return op.activate_version(v, chosen, ["conv_id"]).select("conv_id", "version", "is_active")


@query("b17_format_size", """SELECT doc_id, CASE WHEN n * n < 1024 THEN concat(n * n, ' B') WHEN n * n < 1048576 THEN printf('%.1f KB', n * n / 1024.0::DOUBLE) ELSE
  printf('%.1f MB', n * n / 1048576.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars // 7 AS n FROM documents)""")
def b17(spark, folder):
    n = F.floor(F.col("n_chars") / 7)
    return load_table(spark, folder, "documents").select("doc_id", op.format_size(n * n).alias("size"))
