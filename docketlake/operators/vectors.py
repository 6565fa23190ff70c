"""Embedding, exact vector search, ranking and context building."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import bind, clamp, contains_any, rounded, squeeze, strip
from ..session import bound_batches
from .scale import first_by, last_by, running_sum, top_per_key

# ---- embedding --------------------------------------------------------------------------------


def hashed_features(dim: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """A deterministic stand-in model: signed word hashing, unit length."""

    def embed(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode("utf-8"))
                out[i, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1.0)

    return embed


def letter_counts(texts: pd.Series) -> np.ndarray:
    """A model simple enough for SQL to compute: how often each letter occurs."""
    return np.array([[(t or "").lower().count(chr(c)) for c in range(97, 123)] for t in texts], float).reshape(-1, 26)


def embed_chunks(df: DataFrame, model: Callable[[pd.Series], np.ndarray], dim: int, id: str = "doc_id",
                 text: str = "text", batch: int = 16) -> DataFrame:
    """Run any batch model over the texts; a wrong vector length fails the task."""
    bound_batches(df.sparkSession)
    id_type = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [np.asarray(model(pdf[text].iloc[i:i + batch])) for i in range(0, len(pdf), batch)]
            if not parts:
                continue
            m = np.vstack(parts)
            if m.shape[1] != dim:
                raise ValueError(f"model gave {m.shape[1]} dimensions, expected {dim}")
            yield pd.DataFrame({id: pdf[id].to_numpy(), "embedding": list(m.astype(np.float32))})

    return df.select(id, text).mapInPandas(run, f"{id} {id_type}, embedding array<float>")


def validate_dimension(vectors: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Vectors whose length is not the configured one."""
    return vectors.filter(F.coalesce(F.size(vec), F.lit(-1)) != dim)


# ---- search ---------------------------------------------------------------------------------------

# Doubles of the query matrix each task may hold (64 MB); beyond it the search runs in blocks.
QUERY_CELLS = 8_000_000
QUERY_BLOCK = 2_048
VECTOR_BLOCK = 16_384


def must(filters: dict | None) -> Column:
    """Payload filter: a list means any of, a single value means equal, empty means no filter."""
    conds = [
        F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v)
        for c, v in (filters or {}).items()
        if v not in (None, "", [], ())
    ]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _unit_rows(values) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in values])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1.0)


def _best(qids, qm, qown, vids, vm, vown, k, threshold) -> tuple[list, list, list]:
    """The k best vectors per query among these, ties by smaller id; with owners only those of the query's owner."""
    order = np.argsort(vids, kind="stable")
    vids, vm = vids[order], vm[order]
    scores = qm @ vm.T
    if qown is not None:
        scores = np.where(np.asarray(qown, object)[:, None] == np.asarray(vown, object)[order][None, :], scores, -np.inf)
    out_q, out_v, out_s = [], [], []
    for i in range(len(qids)):
        s = scores[i]
        near = np.nonzero(s >= np.partition(s, -k)[-k])[0] if len(s) > k else np.arange(len(s))
        top = near[np.argsort(-s[near], kind="stable")][:k]
        top = top[s[top] > -np.inf]
        if threshold is not None:
            top = top[s[top] >= threshold]
        out_q.extend([qids[i]] * len(top))
        out_v.extend(vids[top])
        out_s.extend(scores[i][top])
    return out_q, out_v, out_s


def vector_search(queries: DataFrame, vectors: DataFrame, k: int | str, threshold: float | str | None = None, filters: dict | None = None,
                  qid: str = "query_id", vid: str = "vec_id", vec: str = "embedding", query_cells: int = QUERY_CELLS, owner: str | None = None) -> DataFrame:
    """Exact cosine top-k per query: rows (query, vector, score, rank).

    ``k`` and ``threshold`` are values for all queries, or the names of columns of ``queries``.
    ``owner`` names a column of both tables; a query then finds vectors of its own owner only.

    The query set is measured first.  A small one is sent to every task, which keeps only
    its k best per query, so the vectors are never shuffled.  A larger one is cut into
    blocks and met with blocks of vectors; each pair of blocks is one matrix product.
    Neither way writes out the pairs that are not among a task's k best.
    """
    bound_batches(vectors.sparkSession)
    plan = queries
    own = [owner] if owner else []
    vectors = vectors.filter(must(filters)).select(vid, vec, *own)
    queries = queries.select(qid, vec, *own)
    most = k if isinstance(k, int) else (plan.agg(F.max(k)).first()[0] or 0)
    least = None if isinstance(threshold, str) else threshold
    schema = (f"{qid} {queries.schema[qid].dataType.simpleString()}, {vid} {vectors.schema[vid].dataType.simpleString()}, score double")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")).first()
    near = (_search_small if size["n"] * max(size["d"], 1) <= query_cells else _search_blocks)(
        queries, vectors, size["n"], most, least, qid, vid, vec, schema, owner)
    found = top_per_key(near, [qid], [F.desc("score"), F.asc(vid)], most)
    if isinstance(k, str) or isinstance(threshold, str):
        limits = plan.select(qid, (F.col(k) if isinstance(k, str) else F.lit(k)).alias("_k"), (F.col(threshold) if isinstance(threshold, str) else F.lit(None).cast("double")).alias("_least"))
        found = found.join(limits, qid).filter((F.col("rank") <= F.col("_k")) & (F.col("_least").isNull() | (F.col("score") >= F.col("_least")))).drop("_k", "_least")
    return found


def _search_small(queries, vectors, n, k, threshold, qid, vid, vec, schema, owner=None):
    rows = queries.collect()  # bounded by the check above
    shared = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], _unit_rows([r[1] for r in rows]) if rows else None, [r[2] for r in rows] if owner else None))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm, qown = shared.value
        best = None
        for pdf in batches:
            if not len(pdf) or not qids:
                continue
            q, v, s = _best(qids, qm, qown, pdf[vid].to_numpy(), _unit_rows(pdf[vec]), pdf[owner] if owner else None, k, threshold)
            found = pd.DataFrame({qid: q, vid: v, "score": s})
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["score", vid], ascending=[False, True]).groupby(qid, sort=False).head(k)
        if best is not None:
            yield best

    return vectors.mapInPandas(scan, schema)


def _search_blocks(queries, vectors, n, k, threshold, qid, vid, vec, schema, owner=None):
    nq = max(1, -(-n // QUERY_BLOCK))
    nv = max(1, -(-vectors.count() // VECTOR_BLOCK))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = queries.withColumn("_q", block(qid, nq)).withColumn("_v", every(nv))
    v = vectors.withColumn("_v", block(vid, nv)).withColumn("_q", every(nq))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({qid: [], vid: [], "score": []})
        x, y, s = _best(a[qid].to_numpy(), _unit_rows(a[vec]), a[owner] if owner else None, b[vid].to_numpy(), _unit_rows(b[vec]), b[owner] if owner else None, k, threshold)
        return pd.DataFrame({qid: x, vid: y, "score": s})

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInPandas(product, schema)


def ranking_score(score: Column, section: Column, page: Column, weights: dict = rules.RANK_WEIGHTS) -> Column:
    """Score plus a bonus for summary-like sections, minus a little per page."""
    bonus = F.when(contains_any(F.lower(F.coalesce(section, F.lit(""))), rules.BOOSTED_SECTIONS), weights["section_bonus"]).otherwise(0.0)
    depth = F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)) - 1
    return clamp(score + bonus - depth * weights["page_penalty"])


def rank_chunks(hits: DataFrame, weights: dict = rules.RANK_WEIGHTS) -> DataFrame:
    return hits.withColumn("ranking_score", ranking_score(F.col("similarity"), F.col("section"), F.col("page_start"), weights))


def retrieve(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, docs: DataFrame, k: int | str = 5, threshold: float | str | None = None,
             filters: dict | None = None, qid: str = "query_id", owner: str | None = None) -> DataFrame:
    """Search twice as many as asked, attach chunk and document, rank again, keep k.

    ``vectors`` carries ``chunk_id``; hits without chunk or document drop out.  ``k``,
    ``threshold`` and ``owner`` as in ``vector_search``, so that each question runs with its own
    plan and never leaves its owner's documents.
    """
    asked = queries.withColumn("_wide", 2 * F.col(k)) if isinstance(k, str) else queries
    hits = vector_search(asked, vectors, "_wide" if isinstance(k, str) else 2 * k, threshold, filters, qid=qid, owner=owner).drop("rank")
    hits = hits.join(vectors.select("vec_id", "chunk_id"), "vec_id")
    once = hits.groupBy(qid, "chunk_id").agg(F.max("score").alias("score"))
    full = once.join(chunks, "chunk_id").join(docs.select("doc_id", "title", "case_id"), "doc_id")
    ranked = rank_chunks(full.withColumn("similarity", clamp((F.col("score") + 1.0) / 2.0)))
    order = [F.desc("ranking_score"), F.asc("chunk_id")]
    if isinstance(k, int):
        return top_per_key(ranked, [qid], order, k)
    most = queries.agg(F.max(k)).first()[0] or 0
    return top_per_key(ranked, [qid], order, most).join(queries.select(qid, F.col(k).alias("_k")), qid).filter("rank <= _k").drop("_k")


def retrieval_log(results: DataFrame, qid: str = "query_id") -> DataFrame:
    """One log row per query (k results at most, so the list is bounded)."""
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "similarity"))),
                       lambda r: F.struct(r["doc_id"].alias("document_id"), r["title"].alias("document_name"), r["similarity"].alias("score")))
    return results.groupBy(qid).agg(
        F.to_json(docs).alias("retrieved_documents_json"), F.min_by("similarity", "rank").alias("top_score"),
        F.count("*").alias("chunks_returned"))


# ---- context -------------------------------------------------------------------------------------------

def merge_adjacent(hits: DataFrame, qid: str = "query_id") -> DataFrame:
    """Join chunks with adjacent indices of a document.  A query has k hits at most."""
    w = W.partitionBy(qid, "doc_id").orderBy("chunk_index")
    first_seen = F.min("rank").over(W.partitionBy(qid, "doc_id"))
    islands = hits.withColumn("_island", F.col("chunk_index") - F.row_number().over(w)).withColumn("doc_rank", first_seen)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return islands.groupBy(qid, "doc_id", "title", "doc_rank", "_island").agg(
        F.min("chunk_index").alias("start_index"), F.max("chunk_index").alias("end_index"),
        F.min_by("page_start", "chunk_index").alias("page_start"), F.min_by("section", "chunk_index").alias("section"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")).drop("_island")


def build_context(hits: DataFrame, max_tokens: int = 4000, qid: str = "query_id") -> DataFrame:
    """Context text per query under a token budget; one small group (k hits) per query.

    A block that does not fit is cut when enough tokens are left, and ends its document; a
    header that does not fit ends the text.  A fold over the blocks of a query.
    """
    fields = ["doc_rank", "start_index", "doc_id", "title", "section", "page_start", "text"]
    ordered = merge_adjacent(hits, qid).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_blocks"))
    cost = lambda text: F.regexp_count(text, F.lit(r"\S+")) * F.lit(rules.TOKENS_PER_WORD)
    shape = "struct<text:string,used:double,doc:string,closed:boolean,ended:boolean>"
    begin = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("used"), F.lit(None).alias("doc"), F.lit(False).alias("closed"), F.lit(False).alias("ended")).cast(shape)

    def add(acc: Column, b: Column) -> Column:
        other = ~acc["doc"].eqNullSafe(b["doc_id"].cast("string"))
        head = F.when(other, F.concat(F.lit(rules.CONTEXT_HEAD), b["title"], F.lit(rules.CONTEXT_HEAD_END))).otherwise("")
        block = F.format_string(rules.CONTEXT_BLOCK, F.coalesce(b["section"], F.lit("None")), b["page_start"], b["text"])
        parts = F.struct(head.alias("head"), (acc["used"] + cost(head)).alias("used"), block.alias("block"), cost(block).alias("cost"), (~other & acc["closed"]).alias("closed"))

        def put(p: Column) -> Column:
            left = F.lit(float(max_tokens)) - p["used"]
            fits = p["cost"] <= left
            start = F.array_join(F.slice(F.regexp_extract_all(p["block"], F.lit(r"(\S+)"), F.lit(1)), F.lit(1), F.floor(F.greatest(left, F.lit(0.0)) / rules.TOKENS_PER_WORD).cast("int")), " ")
            piece = F.when(p["closed"], "").when(fits, p["block"]).when(left > rules.CONTEXT_LEAST_TOKENS, F.concat(start, F.lit(rules.CONTEXT_CUT))).otherwise("")
            grown = F.struct(F.concat(acc["text"], p["head"], piece).alias("text"), (p["used"] + F.when(~p["closed"] & fits, p["cost"]).otherwise(0.0)).alias("used"),
                             b["doc_id"].cast("string").alias("doc"), (p["closed"] | ~fits).alias("closed"), F.lit(False).alias("ended"))
            over = F.struct(acc["text"].alias("text"), acc["used"].alias("used"), acc["doc"].alias("doc"), acc["closed"].alias("closed"), F.lit(True).alias("ended"))
            return F.when(acc["ended"] | (left < 0), over).otherwise(grown).cast(shape)

        return bind(parts, put)

    return ordered.select(qid, F.aggregate("_blocks", begin, add)["text"].alias("context"))


def compress_chunks(chunks: DataFrame, max_tokens: int = 4000, by: str = "query_id", order: str = "rank") -> DataFrame:
    """Drop blank and repeated texts, then keep the prefix that fits the budget.

    Token sums only grow, so stopping at the first chunk over budget is a comparison with
    the running sum, which works for groups of any size.
    """
    filled = chunks.withColumn("_t", strip("text")).filter("_t <> ''")
    filled = filled.withColumn("_same", F.sha2(squeeze("_t"), 256)).withColumn("est_tokens", (F.regexp_count("_t", F.lit(r"\S+")) * F.lit(1.3)).cast("int"))
    slim = filled.select(by, "_same", order, "est_tokens")
    once = first_by(slim, [by, "_same"], [order])
    kept = running_sum(once, [by], [order], F.col("est_tokens"), "used_tokens").filter(F.col("used_tokens") <= max_tokens)
    return chunks.join(kept.select(by, order, "est_tokens", "used_tokens"), [by, order])


# ---- status and figures --------------------------------------------------------------------------------

def retrieval_stats(log: DataFrame, top: int = 5) -> DataFrame:
    """Request figures, and the documents found most often as further rows."""
    one = log.agg(F.count("*").cast("double").alias("total_requests"), rounded(F.avg("latency_ms"), 2).alias("average_latency_ms"),
                  rounded(F.avg("top_score"), 4).alias("average_similarity_score"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit("figure").alias("kind"), F.lit(c).alias("label"), F.col(c).alias("value"))
                                         for c in one.columns])))
    names = log.select(F.explode(F.from_json("retrieved_documents_json", "array<struct<document_name string>>")).alias("d")).select(
        F.col("d.document_name").alias("label")).filter("coalesce(label, '') <> ''")
    found = names.groupBy("label").agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "label").limit(top)
    return rows.unionByName(found.select(F.lit("document").alias("kind"), "label", "value"))


def latest_job(jobs: DataFrame, key: str = "document_id") -> DataFrame:
    """The job started last per document; jobs that never started come before all others."""
    order = jobs.withColumn("_started", F.coalesce(F.unix_micros("started_at"), F.lit(-1)))
    return last_by(order, [key], ["_started", "job_id"], ["job_id", "status", "progress"])


def embedding_status(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per document: chunks, embedded chunks and the status derived from the latest job."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    j = latest_job(jobs).withColumnRenamed("document_id", "doc_id").withColumnRenamed("status", "job_status")
    total, done = F.coalesce("total_chunks", F.lit(0)), F.coalesce("embedded_chunks", F.lit(0))
    status = F.coalesce("job_status", F.when(done == 0, "never_embedded").otherwise("completed"))
    return (
        docs.select("doc_id").join(n(chunks, "total_chunks"), "doc_id", "left").join(n(vectors, "embedded_chunks"), "doc_id", "left")
        .join(j, "doc_id", "left")
        .select("doc_id", total.alias("total_chunks"), done.alias("embedded_chunks"),
                F.when((status == "completed") & (done < total), "pending").otherwise(status).alias("status"),
                F.coalesce("progress", F.when(done > 0, 100).otherwise(0)).alias("progress"))
    )


def embedding_stats(vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of totals; throughput is chunks of finished documents per second of finished jobs."""
    s = F.col("status")
    secs = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    v = vectors.agg(F.countDistinct("doc_id").alias("total_embedded_documents"), F.count("*").alias("total_embedded_chunks"))
    j = jobs.agg(
        F.count_if(s.isin("pending", "queued")).alias("embedding_queue_size"), F.count_if(s == "failed").alias("failed_embeddings"),
        F.count_if(s.isin(rules.ACTIVE_STATUSES)).alias("active_embeddings"), F.sum("retry_count").alias("retry_count"),
        rounded(F.avg(F.when(s == "completed", secs)), 4).alias("average_embedding_time_seconds"),
        F.sum(F.when(s == "completed", secs)).alias("_seconds"))
    finished = jobs.filter(s == "completed").select(F.col("document_id").alias("doc_id")).distinct()
    c = vectors.join(finished, "doc_id", "left_semi").agg(F.count("*").alias("_chunks"))
    rate = F.when(F.col("_seconds") > 0, rounded(F.col("_chunks") / F.col("_seconds"), 4))
    return v.crossJoin(j).crossJoin(c).withColumn("chunks_per_second", rate).drop("_seconds", "_chunks")  # one row each


def sync_stats(vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    busy = F.col("status").isin("queued", "running")
    v = vectors.agg(F.count("*").alias("total_vectors"), F.count_if(F.col("is_synced")).alias("synced_vectors"),
                    F.count_if(~F.col("is_synced")).alias("pending_vectors"))
    j = jobs.agg(F.count_if((F.col("job_type") == "embeddings") & busy).alias("embedding_queue_size"),
                 F.count_if((F.col("job_type") == "vector_sync") & busy).alias("sync_queue_size"),
                 F.count_if((F.col("job_type") == "vector_sync") & (F.col("status") == "failed")).alias("failed_syncs"))
    return v.crossJoin(j)  # one row each


def sync_status(docs: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per document: from the latest sync job, else from the counts."""
    n = vectors.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_synced")).alias("s"))
    j = latest_job(jobs).withColumnRenamed("document_id", "doc_id").withColumnRenamed("status", "job_status")
    job = F.col("job_status")
    status = (
        F.when(job.isin("completed", "failed", "cancelled"), job).when(job.isin("pending", "queued"), "pending")
        .when(job.isin("starting", "running"), "running").when((F.col("n") > 0) & (F.col("s") == F.col("n")), "completed")
        .when(F.col("n") > 0, "failed").otherwise("never_synced")
    )
    return docs.select("doc_id").join(n, "doc_id", "left").join(j, "doc_id", "left").select(
        "doc_id", status.alias("status"), F.coalesce("progress", F.lit(0)).alias("progress"),
        F.coalesce("n", F.lit(0)).alias("embeddings_count"), F.coalesce("s", F.lit(0)).alias("synced_count"))


def missing_embeddings(chunks: DataFrame, vectors: DataFrame, again: bool = False) -> DataFrame:
    """Documents with chunks and no vectors; with ``again`` every document with chunks."""
    docs = chunks.select("doc_id").distinct()
    return docs if again else docs.join(vectors.select("doc_id").distinct(), "doc_id", "left_anti")
