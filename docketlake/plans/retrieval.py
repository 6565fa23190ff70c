"""Queries over embedding, vector search and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators import vector_index as vi
from ..operators import vectors as op
from ..operators.chunking import chunk_sliding
from ..sources.tables import load_table
from . import standins as st
from .chunking import _SLIDING_SQL
from .metrics import _SECS
from .registry import query
from .sqltext import NL, S, WC

D = st.duck


@query("e1_embed_chunks", _SLIDING_SQL + """
SELECT concat(doc_id, '/', chunk_index) AS chunk_id, 26 AS dim, array_to_string(list_transform(range(97, 123), lambda c: length(lower(text)) - length(replace(lower(text), chr(c::INT), ''))), ' ') AS letters FROM t""")
def e1(spark, folder):
    """Sliding chunks of all documents through a model that SQL can compute."""
    chunks = chunk_sliding(st.documents(spark, folder)).withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_index"))
    out = op.embed_chunks(chunks, op.letter_counts, 26, id="chunk_id")
    return out.select("chunk_id", F.size("embedding").alias("dim"), F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("letters"))


_MIXED = "SELECT vec_id, CASE label WHEN 3 THEN slice(embedding, 1, 32) ELSE embedding END AS embedding FROM {embeddings}"


@query("e2_validate_dimension", "SELECT vec_id, 32 AS dim FROM embeddings WHERE label = 3")
def e2(spark, folder):
    """One label carries vectors of half the length."""
    return op.validate_dimension(st.rows(spark, folder, _MIXED), 64).select("vec_id", F.size("embedding").alias("dim"))


def _centroids(spark, folder):
    """One query per label: the mean vector of the label."""
    parts = load_table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")).select(
        F.col("label").cast("long").alias("query_id"), "embedding")


_CENTROID_SQL = """WITH q AS (SELECT label AS query_id, list(x ORDER BY i) AS e FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT query_id, vec_id, label, list_cosine_similarity(e, embedding::DOUBLE[]) AS score FROM q, embeddings)"""


@query("e3_vector_search", _CENTROID_SQL + """
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
  AS rank FROM s WHERE score >= 0.05 AND label IN (0, 1, 2, 3, 4, 5, 6)) WHERE rank <= 10""")
def e3(spark, folder):
    out = op.vector_search(_centroids(spark, folder), load_table(spark, folder, "embeddings"), 10, threshold=0.05,
                           filters={"label": [0, 1, 2, 3, 4, 5, 6], "source": ""})
    return out.withColumn("score", rounded("score", 6))


@query("e3_nearest_neighbours", """
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a, embeddings b) WHERE rank <= 3""")
def e3_all(spark, folder):
    """Every vector is a query: the way that works in blocks."""
    v = load_table(spark, folder, "embeddings")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    return op.vector_search(q, v, 3, query_cells=0).withColumn("score", rounded("score", 6))


_HUNDREDTH = """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10"""


def _index_search(spark, folder, whole):
    """Each hundredth vector against all of them."""
    index = vi.build_index(load_table(spark, folder, "embeddings"))
    asked = load_table(spark, folder, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vi.search_index(index, asked, 10, probes=index.cells if whole else None).withColumn("score", rounded("score", 6))


@query("e3_index_search")
def e3_index(spark, folder):
    """With as many cells as the calibration asks for; tests hold it against exact search."""
    return _index_search(spark, folder, False)


@query("e3_index_all_cells", _HUNDREDTH)
def e3_index_all(spark, folder):
    """Every cell probed: the index gives what exact search gives."""
    return _index_search(spark, folder, True)


@query("e1_embed_hashed")
def e1_hashed(spark, folder):
    """All sliding chunks through the model of 64 hashed features; a test computes it by hand."""
    chunks = chunk_sliding(st.documents(spark, folder)).withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_index"))
    out = op.embed_chunks(chunks, op.hashed_features(), 64, id="chunk_id")
    return out.select("chunk_id", "embedding")


_CH = """SELECT doc_id AS chunk_id, doc_id - doc_id % 4 AS doc_id, CAST(doc_id % 4 AS INT) AS chunk_index, CASE doc_id % 5 WHEN 0 THEN 'Final Order' WHEN 1 THEN
  'Case Summary' WHEN 2 THEN NULL ELSE 'Facts' END AS section, CAST(1 + doc_id % 6 AS INT) AS page_start, text FROM {documents}"""
_CH_DUCK = D(_CH)
_DOC = "SELECT doc_id, concat('Doc ', doc_id) AS title, source AS case_id FROM {documents}"
_VE = "SELECT vec_id, embedding, label, vec_id AS chunk_id FROM {embeddings}"

_RETRIEVE_SQL = _CENTROID_SQL + f""",
c AS ({_CH_DUCK}), d AS ({D(_DOC)}),
n AS (SELECT query_id, vec_id, vec_id AS chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20),
o AS (SELECT query_id, chunk_id, max(score) AS score FROM n GROUP BY query_id, chunk_id),
f AS (SELECT CAST(query_id AS BIGINT) AS query_id, c.*, d.title, least(greatest((score + 1) / 2, 0), 1) AS similarity FROM o JOIN c USING (chunk_id) JOIN d USING (doc_id)),
g AS (SELECT *, least(greatest(similarity + CASE WHEN regexp_matches(lower(coalesce(section, '')), 'summary|conclusion|holding|order') THEN 0.05::DOUBLE ELSE 0 END
  - (page_start - 1) * 0.01::DOUBLE, 0), 1) AS ranking_score FROM f),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ranking_score DESC, chunk_id) AS INTEGER) AS rank FROM g)"""


def _retrieved(spark, folder, k=10):
    return op.retrieve(_centroids(spark, folder), st.rows(spark, folder, _VE), st.rows(spark, folder, _CH), st.rows(spark, folder, _DOC), k)


@query("e4_retrieve", _RETRIEVE_SQL + " SELECT query_id, chunk_id, doc_id, rank, round(similarity, 6) AS similarity, round(ranking_score, 6) AS ranking_score FROM h WHERE rank <= 10")
def e4(spark, folder):
    return _retrieved(spark, folder).select("query_id", "chunk_id", "doc_id", "rank", rounded("similarity", 6).alias("similarity"),
                                            rounded("ranking_score", 6).alias("ranking_score"))


_PLANNED = "SELECT vec_id AS query_id, embedding, label AS owner_id, CAST(1 + vec_id % 3 AS INT) AS k, CAST(vec_id % 4 AS DOUBLE) / 20 AS least FROM {embeddings} WHERE vec_id % 100 = 0"


@query("e4_search_by_plan", f"""WITH p AS ({D(_PLANNED)}), s AS (SELECT query_id, k, vec_id, list_cosine_similarity(p.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, least FROM p JOIN embeddings e ON e.label = p.owner_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= k AND score >= least""")
def e4_plan(spark, folder):
    """Each hundredth vector asks with its own k and threshold, among the vectors of its owner (here the label)."""
    vectors = load_table(spark, folder, "embeddings").withColumnRenamed("label", "owner_id")
    return op.vector_search(st.rows(spark, folder, _PLANNED), vectors, "k", "least", owner="owner_id").withColumn("score", rounded("score", 6))


@query("e4_retrieval_log", _RETRIEVE_SQL + " SELECT query_id, count(*) AS chunks_returned, round(arg_min(similarity, rank), 6) AS top_score FROM h WHERE rank <= 10 GROUP BY query_id")
def e4_log(spark, folder):
    return op.retrieval_log(_retrieved(spark, folder)).select("query_id", "chunks_returned", rounded("top_score", 6).alias("top_score"))


@query("e5_rank_chunks", f"""WITH c AS ({_CH_DUCK}) SELECT chunk_id, round(least(greatest((chunk_id % 100) / 100.0::DOUBLE + CASE WHEN regexp_matches(lower(coalesce(section, '')),
  'summary|conclusion|holding|order') THEN 0.05::DOUBLE ELSE 0 END - (page_start - 1) * 0.01::DOUBLE, 0), 1), 6) AS ranking_score FROM c""")
def e5(spark, folder):
    df = st.rows(spark, folder, _CH).withColumn("similarity", (F.col("chunk_id") % 100) / 100.0)
    return op.rank_chunks(df).select("chunk_id", rounded("ranking_score", 6).alias("ranking_score"))


@query("e6_merge_adjacent", _RETRIEVE_SQL + f""", i AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS isl FROM h WHERE rank <= 10)
SELECT query_id, doc_id, min(chunk_index) AS start_index, max(chunk_index) AS end_index, md5(string_agg(text, {NL} ORDER BY chunk_index)) AS digest FROM i GROUP BY query_id, doc_id, isl""")
def e6(spark, folder):
    return op.merge_adjacent(_retrieved(spark, folder)).select(
        "query_id", "doc_id", "start_index", "end_index", F.md5("text").alias("digest"))


_CONTEXT_SQL = f""", i AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS isl FROM h WHERE rank <= 10),
m AS (SELECT query_id, doc_id, min(chunk_index) AS s, any_value(title) AS title, list(section ORDER BY chunk_index)[1] AS section, list(page_start ORDER BY chunk_index)[1] AS page, string_agg(text, {NL} ORDER BY chunk_index) AS text
  FROM i GROUP BY query_id, doc_id, isl), dr AS (SELECT query_id, doc_id, min(rank) AS dr FROM i GROUP BY 1, 2),
ob AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dr, s) AS k, concat('--- SOURCE DOCUMENT: ', title, ' ---', {NL}) AS head, concat('[Section: ', coalesce(section, 'None'), ', Page ', page, ']', {NL}, text, {NL}, {NL}) AS block
  FROM m JOIN dr USING (query_id, doc_id)), cb AS (SELECT *, {WC('head')} * 1.3::DOUBLE AS hc, {WC('block')} * 1.3::DOUBLE AS bc FROM ob),
r AS (SELECT query_id, 0::BIGINT AS k, '' AS text, 0::DOUBLE AS used, -1::BIGINT AS doc, false AS closed FROM cb GROUP BY query_id UNION ALL
  SELECT query_id, k, concat(t, CASE WHEN nd THEN head ELSE '' END, CASE WHEN cl THEN '' WHEN u + bc <= 2000 THEN block WHEN 2000 - u > 50 THEN concat(array_to_string(regexp_extract_all(block, '\\S+')[1:CAST(trunc((2000 - u) / 1.3::DOUBLE) AS INT)], ' '),
    '... [Truncated due to token limit]', {NL}, {NL}) ELSE '' END), u + CASE WHEN NOT cl AND u + bc <= 2000 THEN bc ELSE 0 END, doc_id, cl OR u + bc > 2000
  FROM (SELECT r.query_id, c.k, r.text AS t, c.head, c.block, c.bc, c.doc_id, c.doc_id <> r.doc AS nd, r.used + CASE WHEN c.doc_id <> r.doc THEN c.hc ELSE 0 END AS u, c.doc_id = r.doc AND r.closed AS cl
    FROM r JOIN cb c ON c.query_id = r.query_id AND c.k = r.k + 1) WHERE u <= 2000)"""


@query("e6_build_context", _RETRIEVE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _CONTEXT_SQL + " SELECT query_id, arg_max(text, k) AS context FROM r GROUP BY query_id")
def e6_context(spark, folder):
    return op.build_context(_retrieved(spark, folder), 2000)


@query("e7_compress_chunks", f"""WITH c AS (SELECT source, doc_id, {S('text')} AS t FROM documents WHERE {S('text')} <> ''),
o AS (SELECT source, md5(trim(regexp_replace(lower(t), '\\s+', ' ', 'g'))) AS same, min(doc_id) AS doc_id, arg_min(CAST(trunc({WC('t')} * 1.3::DOUBLE) AS INTEGER), doc_id) AS est_tokens FROM c GROUP BY 1, 2),
u AS (SELECT *, CAST(sum(est_tokens) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used_tokens FROM o)
SELECT source, doc_id, est_tokens, used_tokens FROM u WHERE used_tokens <= 15000""")
def e7(spark, folder):
    docs = load_table(spark, folder, "documents").select("source", "doc_id", "text")
    return op.compress_chunks(docs, 15000, by="source", order="doc_id").select("source", "doc_id", "est_tokens", "used_tokens")


@query("e8_retrieval_stats", f"""WITH l AS ({D(st.RETRIEVAL_LOG)}), d AS (SELECT unnest(from_json(CAST(retrieved_documents_json AS JSON), '["JSON"]'))->>'$.document_name' AS n FROM l
  WHERE json_valid(retrieved_documents_json))
SELECT 'figure' AS kind, 'total_requests' AS label, count(*)::DOUBLE AS value FROM l UNION ALL SELECT 'figure', 'average_latency_ms', round(avg(latency_ms), 2) FROM l
UNION ALL SELECT 'figure', 'average_similarity_score', round(avg(top_score), 4) FROM l
UNION ALL SELECT * FROM (SELECT 'document', n, count(*)::DOUBLE AS c FROM d GROUP BY n ORDER BY c DESC, n LIMIT 5)""")
def e8(spark, folder):
    return op.retrieval_stats(st.rows(spark, folder, st.RETRIEVAL_LOG))


_CHUNK_ROWS = "SELECT doc_id, n_chars FROM {documents} UNION ALL SELECT doc_id, n_chars FROM {documents} WHERE n_chars > 3000"
_VEC_ROWS = "SELECT vec_id AS doc_id, vec_id, vec_id % 3 > 0 AS is_synced FROM {embeddings} UNION ALL SELECT doc_id, doc_id, quality = 1 FROM {labels}"
_SOME_JOBS = f"SELECT * FROM ({st.JOBS}) q"
_LATEST = f"""(SELECT document_id AS doc_id, arg_max(status, o) AS job_status, arg_max(progress, o) AS progress FROM (SELECT *, (coalesce(epoch_us(started_at), -1), job_id) AS o
  FROM ({D(_SOME_JOBS)})) GROUP BY document_id)"""


@query("e9_embedding_status", f"""WITH c AS (SELECT doc_id, count(*) AS n FROM ({D(_CHUNK_ROWS)}) GROUP BY 1), v AS (SELECT doc_id, count(*) AS m FROM ({D(_VEC_ROWS)}) GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(n, 0) AS total_chunks, coalesce(m, 0) AS embedded_chunks, coalesce(job_status, CASE WHEN coalesce(m, 0) = 0 THEN 'never_embedded' ELSE 'completed' END) AS s,
  coalesce(progress, CASE WHEN coalesce(m, 0) > 0 THEN 100 ELSE 0 END) AS progress FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN {_LATEST} j USING (doc_id))
SELECT doc_id, total_chunks, embedded_chunks, CASE WHEN s = 'completed' AND embedded_chunks < total_chunks THEN 'pending' ELSE s END AS status, progress FROM a""")
def e9(spark, folder):
    return op.embedding_status(load_table(spark, folder, "documents"), st.rows(spark, folder, _CHUNK_ROWS), st.rows(spark, folder, _VEC_ROWS),
                               st.rows(spark, folder, _SOME_JOBS))


@query("e10_embedding_stats", f"""WITH v AS ({D(_VEC_ROWS)}), j AS ({D(st.JOBS)}), done AS (SELECT DISTINCT document_id FROM j WHERE status = 'completed')
SELECT count(DISTINCT doc_id) AS total_embedded_documents, count(*) AS total_embedded_chunks, any_value(q.embedding_queue_size) AS embedding_queue_size,
  any_value(q.failed_embeddings) AS failed_embeddings, any_value(q.active_embeddings) AS active_embeddings, any_value(q.retry_count) AS retry_count,
  any_value(round(q.a, 4)) AS average_embedding_time_seconds, round(count(*) FILTER (doc_id IN (SELECT document_id FROM done)) / any_value(q.s), 4) AS chunks_per_second
FROM v, (SELECT count(*) FILTER (status IN ('pending', 'queued')) AS embedding_queue_size, count(*) FILTER (status = 'failed') AS failed_embeddings,
  count(*) FILTER (status IN ('pending', 'queued', 'starting', 'running')) AS active_embeddings, CAST(sum(retry_count) AS BIGINT) AS retry_count,
  avg({_SECS}) FILTER (status = 'completed') AS a, sum({_SECS}) FILTER (status = 'completed') AS s FROM j) q""")
def e10(spark, folder):
    return op.embedding_stats(st.rows(spark, folder, _VEC_ROWS), st.rows(spark, folder, st.JOBS))


@query("e11_sync_stats", f"""SELECT * FROM (SELECT count(*) AS total_vectors, count(*) FILTER (is_synced) AS synced_vectors, count(*) FILTER (NOT is_synced) AS pending_vectors FROM ({D(_VEC_ROWS)})),
  (SELECT count(*) FILTER (job_type = 'embeddings' AND status IN ('queued', 'running')) AS embedding_queue_size, count(*) FILTER (job_type = 'vector_sync' AND status IN
  ('queued', 'running')) AS sync_queue_size, count(*) FILTER (job_type = 'vector_sync' AND status = 'failed') AS failed_syncs FROM ({D(st.JOBS)}))""")
def e11(spark, folder):
    return op.sync_stats(st.rows(spark, folder, _VEC_ROWS), st.rows(spark, folder, st.JOBS))


@query("e11_sync_status", f"""WITH v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (is_synced) AS s FROM ({D(_VEC_ROWS)}) GROUP BY 1)
SELECT d.doc_id, CASE WHEN job_status IN ('completed', 'failed', 'cancelled') THEN job_status WHEN job_status IN ('pending', 'queued') THEN 'pending' WHEN job_status IN
  ('starting', 'running') THEN 'running' WHEN n > 0 AND s = n THEN 'completed' WHEN n > 0 THEN 'failed' ELSE 'never_synced' END AS status, coalesce(progress, 0) AS progress,
  coalesce(n, 0) AS embeddings_count, coalesce(s, 0) AS synced_count FROM documents d LEFT JOIN v USING (doc_id) LEFT JOIN {_LATEST} j USING (doc_id)""")
def e11_status(spark, folder):
    return op.sync_status(load_table(spark, folder, "documents"), st.rows(spark, folder, _VEC_ROWS), st.rows(spark, folder, _SOME_JOBS))


@query("e12_missing_embeddings", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({D(_VEC_ROWS)}))")
def e12(spark, folder):
    return op.missing_embeddings(st.rows(spark, folder, _CHUNK_ROWS), st.rows(spark, folder, _VEC_ROWS))
