"""Queries over sources, upload checks and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..functions import rules
from ..operators import metrics
from ..session import checkpoint_dir
from ..sources import files, stores
from ..sources.tables import load_table, owned
from . import standins as st
from .metrics import _bundle
from .registry import query
from .sqltext import CASE_CONTAINS, NL, S

D = st.duck
_LATIN = r"regexp_matches(text, '^[\x{00}-\x{ff}]*$')"


@query("a1_decode_files", f"""SELECT concat('/in/', doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN 'utf-16' WHEN doc_id % 3 = 1 AND {_LATIN} AND NOT
  regexp_matches(text, '^[\\x{{00}}-\\x{{7f}}]*$') THEN 'latin-1' ELSE 'utf-8' END AS encoding, 'txt' AS method, 1 AS page_count, 1.0::DOUBLE AS confidence,
  md5(text) AS digest FROM documents""")
def a1(spark, folder):
    """The texts of documents, encoded in three ways and read back."""
    content = F.expr(r"CASE WHEN doc_id % 3 = 0 THEN encode(text, 'UTF-16') WHEN doc_id % 3 = 1 AND text RLIKE '^[\\x{00}-\\x{ff}]*$' THEN "
                     "encode(text, 'ISO-8859-1') ELSE encode(text, 'UTF-8') END")
    raw = load_table(spark, folder, "documents").select(
        F.concat(F.lit("/in/"), "doc_id").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return files.decode_files(raw).select("path", "encoding", "method", "page_count", "confidence", F.md5("text").alias("digest"))


@query("a2_load_table", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' GROUP BY source")
def a2(spark, folder):
    """Declared schema, two columns read, the owner filter in the scan."""
    return owned(load_table(spark, folder, "documents"), "lang", "en").groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


_PATH = "regexp_replace(url, '[?#].*$', '')"
_EXT = f"lower(regexp_extract({_PATH}, '\\.([^./?#]*)$', 1))"
_DECL = "CASE page_id % 4 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'text/plain' END"


@query("a3_detect_mime", f"""SELECT page_id, coalesce(nullif({_DECL}, 'application/octet-stream'), CASE {_EXT} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in
  rules.MIME_BY_EXTENSION.items())} END, 'application/octet-stream') AS mime FROM pages""")
def a3(spark, folder):
    df = load_table(spark, folder, "pages")
    path = F.regexp_replace("url", "[?#].*$", "")
    return df.select("page_id", files.detect_mime(path, F.expr(_DECL)).alias("mime"))


@query("a4_detect_category", f"""WITH f AS ({D(st.FILES)}), e AS (SELECT *, lower(regexp_extract(filename, '\\.([^./?#]*)$', 1)) AS ext, coalesce(mime_type, '') AS m FROM f)
SELECT doc_id, CASE WHEN ext IN ('doc', 'docx') OR m IN ('{rules.WORD_MIMES[0]}', '{rules.WORD_MIMES[1]}') THEN 'word' WHEN ext = 'pdf' OR m = 'application/pdf'
  THEN 'pdf' WHEN ext = 'txt' OR m = 'text/plain' THEN 'text' WHEN ext IN ('png', 'jpg', 'jpeg', 'webp') OR starts_with(m, 'image/') THEN 'image' ELSE 'other' END
  AS category FROM e""")
def a4(spark, folder):
    return st.rows(spark, folder, st.FILES).select("doc_id", files.detect_category("filename", "mime_type").alias("category"))


@query("a5_route_documents", f"""WITH f AS ({D(st.FILES)}) SELECT doc_id, CASE mime_type WHEN 'text/plain' THEN 'txt' WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png'
  THEN 'image' ELSE 'unsupported' END AS extractor FROM f""")
def a5(spark, folder):
    ok, rejected = files.route_documents(st.rows(spark, folder, st.FILES))
    return ok.select("doc_id", "extractor").unionByName(rejected.select("doc_id", F.lit("unsupported").alias("extractor")))


_OWN_CASES = "SELECT DISTINCT source AS case_id, concat('owner', doc_id % 3) AS owner_id FROM {documents}"
_MIMES = ", ".join(f"'{m}'" for m in rules.ALLOWED_MIMES)


@query("a6_validate_upload", f"""WITH f AS ({D(st.FILES)}), c AS ({D(_OWN_CASES)}), e AS (SELECT f.*, c.case_id IS NOT NULL AS known,
  lower(regexp_extract(filename, '\\.([^./?#]*)$', 1)) AS ext FROM f LEFT JOIN c ON c.case_id = f.case_id AND c.owner_id = f.owner_id)
SELECT doc_id, CASE WHEN NOT known THEN 'case_not_found' WHEN ext NOT IN ('pdf', 'docx', 'txt', 'png', 'jpg', 'jpeg') THEN 'extension'
  WHEN coalesce(mime_type, '') NOT IN ({_MIMES}) THEN 'mime' WHEN file_size > 2000000 THEN 'too_large' END AS reject_reason FROM e""")
def a6(spark, folder):
    return files.validate_upload(st.rows(spark, folder, st.FILES), st.rows(spark, folder, _OWN_CASES), max_bytes=2_000_000).select("doc_id", "reject_reason")


@query("a7_checksum_duplicates", f"""WITH f AS (SELECT *, sha256(text) AS checksum FROM ({D(st.FILES)}))
SELECT doc_id, owner_id, checksum, arg_min(doc_id, (created_at, doc_id)) OVER (PARTITION BY owner_id, checksum) AS original,
  doc_id <> arg_min(doc_id, (created_at, doc_id)) OVER (PARTITION BY owner_id, checksum) AS is_duplicate FROM f""")
def a7(spark, folder):
    return files.checksum_duplicates(st.rows(spark, folder, st.FILES)).select("doc_id", "owner_id", "checksum", "original", "is_duplicate")


@query("a8_replace_by_key", """WITH n AS (SELECT d.doc_id, 'reprocessed' AS source, d.n_chars + l.quality AS n_chars FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n""")
def a8(spark, folder):
    docs = load_table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    new = docs.join(load_table(spark, folder, "labels"), "doc_id").select(
        "doc_id", F.lit("reprocessed").alias("source"), (F.col("n_chars") + F.col("quality")).alias("n_chars"))
    return stores.replace_by_key(docs, new, ["doc_id"])


_SNAP = "SELECT event_type AS snapshot_type, CAST(user_id AS STRING) AS case_key, ts AS computed_at, event_id, value FROM {events}"


@query("a8_table_of_versions", """WITH n AS (SELECT d.doc_id, 'reprocessed' AS source, d.n_chars + l.quality AS n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0)
SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT * FROM n""")
def a8_versions(spark, folder):
    """Documents, then a version with those labelled harmless anew, in which the toxic ones go; compacted and read again."""
    docs, labels = load_table(spark, folder, "documents"), load_table(spark, folder, "labels")
    base = f"{checkpoint_dir(spark)}/versions/{uuid.uuid4().hex}"
    new = docs.join(labels.filter("toxic = 0"), "doc_id").select("doc_id", F.lit("reprocessed").alias("source"), (F.col("n_chars") + F.col("quality")).alias("n_chars"))
    stores.append_version(spark, docs.select("doc_id", "source", "n_chars"), f"{base}/all", ["doc_id"])
    stores.append_version(spark, new, f"{base}/all", ["doc_id"], replaced=labels)
    stores.compact_versions(spark, f"{base}/all", f"{base}/compact", ["doc_id"])
    return stores.newest_rows(spark, f"{base}/compact", ["doc_id"])


@query("a9_newest_snapshot", f"""WITH s AS (SELECT * FROM ({D(_SNAP)}) WHERE computed_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00')
SELECT snapshot_type, case_key, event_id, value FROM s QUALIFY computed_at = max(computed_at) OVER (PARTITION BY snapshot_type, case_key)""")
def a9(spark, folder):
    return stores.newest_snapshot(st.rows(spark, folder, _SNAP), "2024-01-15 00:00:00", max_age_minutes=5 * 24 * 60).select(
        "snapshot_type", "case_key", "event_id", "value")


@query("a10_export_rows", f"WITH l AS ({D(st.RETRIEVAL_LOG)}), e AS (SELECT event_type, ts AS event_date FROM events)\n" + _bundle("l", "retrieval", {
    "Search Queries": ("count(*)", "searches"), "Avg Latency": ("round(avg(latency_ms), 1)", "ms"),
    "Avg Chunks": ("round(avg(chunks_returned), 1)", "chunks"), "Avg Relevance": ("round(avg(top_score) * 100.0::DOUBLE, 1)", "%")},
    {"query_categories": CASE_CONTAINS("lower(query_text)", rules.QUERY_CATEGORIES, rules.QUERY_CATEGORY_DEFAULT)}) + "\nUNION ALL "
    + _bundle("e", "timeline", {"Timeline Events": ("count(*)", "events"), "Missing Dates": ("count(*) FILTER (event_date IS NULL)", "events"),
                                "Timeline Completeness": ("max(100)", "%")}, {"event_categories": "event_type"}))
def a10(spark, folder):
    events = load_table(spark, folder, "events").select("event_type", F.col("ts").alias("event_date"))
    return stores.flatten_bundles([metrics.retrieval_metrics(st.rows(spark, folder, st.RETRIEVAL_LOG)), metrics.timeline_metrics(events)])


_VEC = "SELECT vec_id, embedding, label, vec_id AS doc_id, CAST(label AS INT) AS chunk_index, vec_id % 3 > 0 AS is_synced, concat('v', vec_id % 2) AS embedding_version FROM {embeddings}"
_CHUNK = "SELECT concat(doc_id, '/', doc_id % 10) AS chunk_id, doc_id, CAST(doc_id % 10 AS INT) AS chunk_index, CAST(2 + doc_id % 5 AS INT) AS page_start, concat('Part ', lang) AS section FROM {documents}"


@query("a11_vector_payload", f"""WITH v AS ({D(_VEC)}), c AS ({D(_CHUNK)}), f AS ({D(st.FILES)})
SELECT vec_id, v.doc_id, coalesce(c.chunk_index, 0) AS chunk_index, coalesce(page_start, 1) AS page, coalesce(section, '') AS section, case_id, title, chunk_id, owner_id, filename, mime_type AS document_type, user_tags AS tags,
  strftime(created_at, '%Y-%m-%d') AS created_at, embedding_version
FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.chunk_index = v.chunk_index JOIN f ON f.doc_id = v.doc_id WHERE NOT is_synced""")
def a11(spark, folder):
    return stores.vector_payload(st.rows(spark, folder, _VEC), st.rows(spark, folder, _CHUNK), st.rows(spark, folder, st.FILES)).select("vec_id", "payload.*").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("a12_delete_document_vectors", f"""WITH v AS ({D(_VEC)}) SELECT vec_id, doc_id, is_synced FROM v WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def a12(spark, folder):
    gone = load_table(spark, folder, "labels").filter("toxic = 1")
    return stores.delete_document_vectors(st.rows(spark, folder, _VEC), gone).select("vec_id", "doc_id", "is_synced")


@query("a12_reset_sync", f"""WITH v AS ({D(_VEC)}) SELECT vec_id, is_synced AND doc_id NOT IN (SELECT doc_id FROM labels) AS is_synced FROM v""")
def a12b(spark, folder):
    return stores.reset_sync(st.rows(spark, folder, _VEC), load_table(spark, folder, "labels")).select("vec_id", "is_synced")


@query("a13_pending_documents", f"SELECT DISTINCT doc_id FROM ({D(_VEC)}) WHERE NOT is_synced")
def a13(spark, folder):
    return stores.pending_documents(st.rows(spark, folder, _VEC))


@query("a13_resync_all", f"SELECT vec_id, false AS is_synced FROM ({D(_VEC)})")
def a13b(spark, folder):
    return stores.reset_sync(st.rows(spark, folder, _VEC)).select("vec_id", "is_synced")


@query("a14_assemble_pages", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, {NL})) AS t, generate_subscripts(string_split(text, {NL}), 1) AS page FROM documents)
SELECT doc_id, md5(string_agg(concat('--- Page ', page, ' ---', {NL}, {NL}, {S('t')}), {NL} || {NL} ORDER BY page)) AS digest FROM p GROUP BY doc_id""")
def a14(spark, folder):
    pages = st.documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page", F.col("i") + 1)
    return files.assemble_pages(pages).select("doc_id", F.md5("text").alias("digest"))


@query("a15_needs_ocr", f"""WITH p AS (SELECT doc_id, concat('--- Page 1 ---', {NL}, {NL}, CASE WHEN n_chars > 1000 THEN text ELSE lang END) AS text FROM documents)
SELECT doc_id, length({S("regexp_replace(text, '--- Page [0-9]+ ---', '', 'g')")}) < 100 AS needs_ocr FROM p""")
def a15(spark, folder):
    text = "concat('--- Page 1 ---', chr(10), chr(10), CASE WHEN n_chars > 1000 THEN text ELSE lang END)"
    return st.documents(spark, folder, text).select("doc_id", files.needs_ocr("text").alias("needs_ocr"))


_WORDS = "SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE l_returnflag END AS word, l_quantity * 3 - 20 AS conf FROM {lineitem}"


@query("a16_ocr_confidence", f"""WITH p AS (SELECT doc_id, page, least(greatest(coalesce(avg(conf) FILTER ({S('word')} <> '' AND conf >= 0), 100) / 100, 0), 1) AS c
  FROM ({D(_WORDS)}) GROUP BY doc_id, page) SELECT doc_id, round(avg(c), 6) AS confidence FROM p GROUP BY doc_id""")
def a16(spark, folder):
    return files.ocr_confidence(st.rows(spark, folder, _WORDS)).withColumn("confidence", rounded("confidence", 6))
