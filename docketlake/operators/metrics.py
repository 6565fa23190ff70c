"""Metric bundles as long rows ``(category, section, label, value, unit)``.

A bundle is one scan and one aggregate: the distributions are grouping sets, and the single
figures sit on the empty grouping set.  With ``by`` every figure is also split by those
columns in the same pass.  Partial aggregation happens before the shuffle, so a label that
holds most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_match, or_default, rounded, title_case
from .scale import top_per_key

Cards = dict[str, tuple[Column, str]]
Groups = dict[str, Column | tuple[Column, Column, str]]


def bundle(df: DataFrame, category: str, cards: Cards | None = None, groups: Groups | None = None,
           by: list[str] | None = None) -> DataFrame:
    """``cards``: name -> (aggregate, unit).  ``groups``: section -> label, or (label, aggregate, unit)."""
    by, cards, groups = by or [], cards or {}, groups or {}
    labels = []
    for i, (_, g) in enumerate(groups.items()):
        label = g[0] if isinstance(g, tuple) else g
        df = df.withColumn(f"_g{i}", label.cast("string"))
        labels.append(f"_g{i}")
    aggs = [agg.cast("double").alias(f"_c{i}") for i, (agg, _) in enumerate(cards.values())]
    for i, g in enumerate(groups.values()):
        agg = g[1] if isinstance(g, tuple) else F.count("*")
        aggs.append(agg.cast("double").alias(f"_v{i}"))
    entry = lambda section, label, value, unit: F.struct(
        F.lit(section).alias("section"), label.alias("label"), value.alias("value"), F.lit(unit).alias("unit"))
    card_rows = F.array(*[entry("metrics", F.lit(name), F.col(f"_c{i}"), unit) for i, (name, (_, unit)) in enumerate(cards.items())])
    if not labels:
        agg = df.groupBy(*by).agg(*aggs)
        rows = card_rows
    else:
        sets = [[*by, g] for g in labels] + [by]
        agg = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, *labels]]).agg(
            F.grouping_id().alias("_gid"), *aggs)
        full, n = 2 ** len(labels) - 1, len(labels)
        rows = F.when(F.col("_gid") == full, card_rows) if cards else None
        for i, (section, g) in enumerate(groups.items()):
            unit = g[2] if isinstance(g, tuple) else "count"
            row = F.array(entry(section, F.col(f"_g{i}"), F.col(f"_v{i}"), unit))
            cond = F.col("_gid") == full - (1 << (n - 1 - i))
            rows = F.when(cond, row) if rows is None else rows.when(cond, row)
    return agg.select(*by, F.lit(category).alias("category"), F.inline(rows))


def share(part: Column, whole: Column, empty: float = 100.0, digits: int = 1) -> Column:
    """Percentage, or ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, rounded(part / whole * 100.0, digits)).otherwise(F.lit(empty))


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def case_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    status = F.col("status")
    return bundle(
        cases, "cases",
        cards={
            "Total Cases": (F.count("*"), "cases"),
            "Open Cases": (n_if(status == "open"), "cases"),
            "Closed Cases": (n_if(status == "closed"), "cases"),
            "Archived Cases": (n_if(status == "archived"), "cases"),
            "Completion Rate": (share(n_if(status == "closed"), F.count("*"), 0.0, 4), "%"),
        },
        groups={
            "cases_by_status": status,
            "cases_by_court": or_default("court_name", "Unknown Court"),
            "cases_by_jurisdiction": or_default("jurisdiction", "Unknown Jurisdiction"),
            "cases_by_category": first_match(F.lower(F.coalesce("description", F.lit(""))), rules.CASE_CATEGORIES,
                                             rules.CASE_CATEGORY_DEFAULT),
            "cases_by_advocate": or_default("client_name", "Unknown Advocate"),
            "cases_by_judge": or_default("judge_name", "Unknown Judge"),
            "case_growth_trend": F.date_format("created_at", "yyyy-MM"),
        },
        by=by,
    )


def document_metrics(docs: DataFrame, by: list[str] | None = None, largest: int = 5) -> DataFrame:
    """The largest documents come from a bounded top-k, not from a sort of the table."""
    mb = 1024 * 1024
    size = F.col("file_size")
    sizes = (F.when(size < mb, "< 1MB").when(size <= 5 * mb, "1MB - 5MB").when(size <= 10 * mb, "5MB - 10MB").otherwise("> 10MB"))
    rows = bundle(
        docs, "documents",
        cards={
            "Total Documents": (F.count("*"), "files"),
            "Storage Used": (rounded(F.sum(size) / mb, 2), "MB"),
            "Success Rate": (share(n_if(F.col("status") == "processed"), F.count("*")), "%"),
        },
        groups={
            "documents_by_case": or_default("case_id", "Unassigned"),
            "documents_by_type": or_default("mime_type", "unknown"),
            "file_size_distribution": sizes,
            "processing_success_rates": F.col("status"),
            "upload_trends": F.date_format("created_at", "yyyy-MM"),
        },
        by=by,
    )
    if by:
        top = top_per_key(docs, by, [F.desc("file_size"), F.asc("doc_id")], largest)
    else:
        top = docs.orderBy(F.desc("file_size"), "doc_id").limit(largest)
    top = top.select(
        *(by or []), F.lit("documents").alias("category"), F.lit("largest_documents").alias("section"), F.col("filename").alias("label"),
        rounded(size / mb, 2).alias("value"), F.lit("MB").alias("unit"))
    return rows.unionByName(top)


def processing_metrics(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Job counts and the mean of each stage metric; a stage without data has no value."""
    status = F.col("status")
    done, failed = n_if(status == "completed"), n_if(status == "failed")
    stages = {"extraction_duration": "Extraction", "cleaning_duration": "Cleaning", "chunking_duration": "Chunking",
              "total_processing_duration": "Total Run"}
    counts = bundle(jobs, "processing", cards={
        "Total Jobs Run": (F.count("*"), "jobs"), "Completed Jobs": (done, "jobs"), "Failed Jobs": (failed, "jobs"),
        "Success Rate": (share(done, F.count("*")), "%")})
    durations = (
        records.filter(F.col("category") == "document_processing").groupBy().agg(
            *[rounded(F.avg(F.when(F.col("metric_name") == m, F.col("metric_value"))), 2).alias(m) for m in stages])
        .select(F.inline(F.array(*[
            F.struct(F.lit("processing").alias("category"), F.lit("stage_durations").alias("section"), F.lit(label).alias("label"),
                     F.col(m).alias("value"), F.lit("s").alias("unit")) for m, label in stages.items()]))))
    return counts.unionByName(durations)


def embedding_metrics(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    a = bundle(vectors, "embeddings", cards={
        "Vectors": (F.count("*"), "vectors"), "Dimension": (F.max(F.size("embedding")), "dims")})
    b = bundle(runs.filter("status = 'completed'"), "embeddings", cards={
        "Avg Latency": (rounded(F.avg(seconds("started_at", "completed_at")), 2), "s")})
    return a.unionByName(b)


def vector_index_metrics(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    status = F.col("status")
    a = bundle(runs, "vector_index", cards={
        "Sync Jobs": (F.count("*"), "jobs"), "Successful Syncs": (n_if(status == "completed"), "jobs"),
        "Failed Syncs": (n_if(status == "failed"), "jobs")})
    b = bundle(vectors, "vector_index", cards={
        "Total Vectors": (F.count("*"), "vectors"), "Synced Vectors": (n_if(F.col("is_synced")), "vectors")})
    return a.unionByName(b)


def retrieval_metrics(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return bundle(
        log, "retrieval",
        cards={
            "Search Queries": (F.count("*"), "searches"),
            "Avg Latency": (rounded(F.avg("latency_ms"), 1), "ms"),
            "Avg Chunks": (rounded(F.avg("chunks_returned"), 1), "chunks"),
            "Avg Relevance": (rounded(F.avg("top_score") * 100.0, 1), "%"),
        },
        groups={"query_categories": first_match(F.lower("query_text"), rules.QUERY_CATEGORIES, rules.QUERY_CATEGORY_DEFAULT)},
        by=by,
    )


def conversation_metrics(messages: DataFrame, first: int | None = None) -> DataFrame:
    """``first`` cuts the distribution to so many sessions, in order of their id."""
    per_session = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    cards = bundle(per_session, "conversations", cards={
        "Sessions": (F.count("*"), "sessions"), "Messages": (F.sum("n"), "msgs"),
        "Avg Messages": (rounded(F.sum("n") / F.count("*"), 1), "msgs")})
    shown = per_session.orderBy("session_id").limit(first) if first else per_session
    shown = shown.select(
        F.lit("conversations").alias("category"), F.lit("messages_per_session").alias("section"),
        F.concat(F.lit("Session "), F.col("session_id")).alias("label"), F.col("n").cast("double").alias("value"), F.lit("msgs").alias("unit"))
    return cards.unionByName(shown)


USAGE = "prompt_tokens long, completion_tokens long, estimated_cost double, model_used string"


def with_usage(messages: DataFrame) -> DataFrame:
    """Assistant messages with their parsed token usage; broken JSON counts as missing."""
    usage = F.from_json("token_usage_json", USAGE)
    usable = F.col("token_usage_json").isNotNull() & F.get_json_object("token_usage_json", "$.prompt_tokens").isNotNull()
    return messages.filter(F.col("role") == "assistant").withColumn("usage", F.when(usable, usage)).withColumn(
        "model", F.coalesce("usage.model_used", F.lit("mock")))


def model_metrics(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    df = with_usage(messages)
    return bundle(df, "models", cards={
        "Total Requests": (F.count("*"), "reqs"),
        "Avg Latency": (rounded(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 1), "ms")},
        groups={"requests_by_model": F.col("model")}, by=by)


def token_metrics(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    df = with_usage(messages).filter("usage is not null")
    pt, ct = F.coalesce("usage.prompt_tokens", F.lit(0)), F.coalesce("usage.completion_tokens", F.lit(0))
    return bundle(df, "tokens", cards={
        "Prompt Tokens": (F.sum(pt), "tokens"), "Completion Tokens": (F.sum(ct), "tokens"), "Total Tokens": (F.sum(pt + ct), "tokens")},
        groups={"tokens_by_model": (F.col("model"), F.sum(pt + ct), "tokens")}, by=by)


def cost_metrics(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    df = with_usage(messages)
    cost = F.sum(F.coalesce("usage.estimated_cost", F.lit(0.0)))
    model = F.when(F.col("usage").isNotNull(), F.col("model")).otherwise("(no usage)")
    return bundle(df, "cost", cards={
        "Total Spend": (rounded(cost, 4), "USD"), "Avg Cost / Req": (rounded(cost / F.count("*"), 4), "USD"),
        "Projected Monthly": (rounded(cost * 30.0, 2), "USD")},
        groups={"cost_by_model": (model, rounded(cost, 4), "USD")}, by=by)


def citation_metrics(messages: DataFrame) -> DataFrame:
    df = messages.filter(F.col("role") == "assistant").withColumn(
        "cites", F.coalesce(F.from_json("citations_json", "array<struct<document_title string>>"), F.array()))
    total = F.sum(F.size("cites"))
    cards = bundle(df, "citations", cards={
        "Citations Logged": (total, "cites"), "Avg Citations / Chat": (rounded(total / F.count("*"), 1), "cites")})
    by_doc = bundle(df.select(F.explode("cites").alias("c")), "citations", groups={
        "citations_by_document": F.coalesce("c.document_title", F.lit("Unknown Source"))})
    return cards.unionByName(by_doc)


def timeline_metrics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    missing = n_if(F.col("event_date").isNull())
    return bundle(events, "timeline", cards={
        "Timeline Events": (F.count("*"), "events"), "Missing Dates": (missing, "events"),
        "Timeline Completeness": (share(F.count("*") - missing, F.count("*")), "%")},
        groups={"event_categories": or_default("event_type", "General Event")}, by=by)


def intelligence_metrics(kinds: DataFrame, evidence: DataFrame) -> DataFrame:
    """``kinds`` has one row per extracted item with its kind; evidence carries ``strength``."""
    a = bundle(kinds, "intelligence", groups={"extracted_items": F.col("kind")})
    s = F.col("strength")
    level = F.when(s >= 0.8, "Strong Evidence (>80%)").when(s >= 0.5, "Medium Strength (50-80%)").otherwise("Weak/Unverified")
    return a.unionByName(bundle(evidence, "intelligence", groups={"evidence_strength_distribution": level}))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by_type = bundle(edges, "graph", cards={"Total Relation Edges": (F.count("*"), "edges")},
                     groups={"relationship_types_distribution": title_case("type")})
    totals = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("e")))  # one row each
    density = F.when(F.col("n") > 0, rounded(F.col("e") / F.col("n"), 2)).otherwise(0.0)
    row = lambda label, value, unit: F.struct(
        F.lit("graph").alias("category"), F.lit("metrics").alias("section"), F.lit(label).alias("label"), value.cast("double").alias("value"),
        F.lit(unit).alias("unit"))
    cards = totals.select(F.inline(F.array(row("Total Graph Nodes", F.col("n"), "nodes"), row("Graph Density", density, "density"))))
    return by_type.unionByName(cards)


def quality_metrics(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = F.col("confidence")
    level = F.when(c >= 0.9, "High (> 90%)").when(c >= 0.7, "Medium (70-90%)").otherwise("Low (< 70%)")
    return bundle(items, "quality", cards={
        "Extraction Quality": (rounded(F.coalesce(F.avg(c), F.lit(0.95)) * 100.0, 1), "%")},
        groups={"confidence_distribution": level}, by=by)


def overview(cases: DataFrame, documents: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """First card of four bundles and the two charts of the cases bundle."""
    charts = case_metrics(cases).filter(F.col("section").isin("cases_by_status", "case_growth_trend"))
    card = lambda df, label, unit: bundle(df, "overview", cards={label: (F.count("*"), unit)})
    chats = messages.select("session_id").distinct()
    return (
        card(cases, "Total Cases", "cases").unionByName(card(documents, "Total Documents", "files"))
        .unionByName(card(events, "Timeline Events", "events")).unionByName(card(chats, "Sessions", "sessions"))
        .unionByName(charts.withColumn("category", F.lit("overview")))
    )


def dashboard(cases: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of counters (three one-row aggregates side by side)."""
    live = ~F.col("archived")
    c = cases.agg(
        n_if(live).alias("total_cases"), n_if(live & (F.col("status") == "open")).alias("open_cases"),
        n_if(live & (F.col("status") == "closed")).alias("closed_cases"), n_if(~live).alias("archived_cases"),
        n_if(live & (F.col("priority") == "urgent")).alias("urgent_cases"))
    d = documents.agg(F.count("*").alias("documents"), n_if(F.col("is_favorite")).alias("favorites"))
    s = F.col("status")
    j = jobs.agg(n_if(s.isin("pending", "queued")).alias("queued_jobs"), n_if(s.isin("starting", "running")).alias("running_jobs"),
                 n_if(s == "failed").alias("failed_jobs"))
    return c.crossJoin(d).crossJoin(j)


# ---- jobs ------------------------------------------------------------------------------------

def seconds(a: str, b: str) -> Column:
    """Seconds from column a to column b, with fractions."""
    return (F.unix_micros(F.col(b)) - F.unix_micros(F.col(a))) / 1e6


def job_stats(jobs: DataFrame, as_of, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Counts per status; ``as_of`` says which day is today."""
    s = F.col("status")
    today = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    return jobs.groupBy(*(by or [])).agg(
        n_if(s == "pending").alias("pending"), n_if(s == "queued").alias("queued"),
        n_if(s.isin("running", "starting")).alias("running"), n_if(s == "completed").alias("completed"),
        n_if(s == "failed").alias("failed"), n_if(s == "cancelled").alias("cancelled"),
        n_if((s == "completed") & (F.col("completed_at") >= today)).alias("completed_today"),
        rounded(F.avg(F.when(s == "completed", seconds("started_at", "completed_at"))), digits).alias("average_duration_seconds"))


def job_dashboard(jobs: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Totals and averages; a missing metric falls back to the timestamps of the jobs."""
    s, m = F.col("status"), F.col("metric_name")
    j = jobs.groupBy(*by).agg(
        F.count("*").alias("total_jobs"), n_if(s.isin("queued", "pending")).alias("queued"),
        n_if(s.isin("running", "starting")).alias("running"), n_if(s == "completed").alias("completed"),
        n_if(s == "failed").alias("failed"), n_if(s == "cancelled").alias("cancelled"),
        F.avg(F.when(s == "completed", seconds("started_at", "completed_at"))).alias("_run"),
        F.avg(seconds("created_at", "started_at")).alias("_wait"))
    r = records.groupBy(*by).agg(
        F.avg(F.when(m == "total_processing_duration", F.col("metric_value"))).alias("_m_run"),
        F.avg(F.when(m == "queue_wait_time", F.col("metric_value"))).alias("_m_wait"))
    ended = F.col("completed") + F.col("failed") + F.col("cancelled")
    return j.join(r, by, "left").select(
        *by, "total_jobs", "queued", "running", "completed", "failed", "cancelled",
        share(F.col("completed"), ended, 100.0, 2).alias("success_rate"),
        F.coalesce(rounded(F.coalesce("_m_run", "_run"), 2), F.lit(0.0)).alias("average_processing_time"),
        F.coalesce(rounded(F.coalesce("_m_wait", "_wait"), 2), F.lit(0.0)).alias("average_queue_time"))


def queue_health(jobs: DataFrame, records: DataFrame) -> DataFrame:
    s, m = F.col("status"), F.col("metric_name")
    j = jobs.agg(n_if(s.isin("pending", "queued")).alias("waiting_jobs"), n_if(s.isin("starting", "running")).alias("running_jobs"),
                 F.sum("retry_count").alias("retry_count"), n_if(s == "failed").alias("failed_jobs"))
    r = records.agg(
        rounded(F.avg(F.when(m == "queue_wait_time", F.col("metric_value"))), 2).alias("average_wait_time"),
        rounded(F.avg(F.when(m == "worker_execution_time", F.col("metric_value"))), 2).alias("average_processing_duration"))
    return j.crossJoin(r)  # one row each


def daily_trend(jobs: DataFrame, records: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Zero-filled days: jobs created, completed, failed, and mean processing time."""
    spark = jobs.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    inside = lambda c: F.to_date(c).between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    per_day = lambda df, c, *aggs: df.filter(inside(c)).groupBy(F.to_date(c).alias("day")).agg(*aggs)
    s = F.col("status")
    created = per_day(jobs, "created_at", F.count("*").alias("total_jobs"))
    ended = per_day(jobs, "completed_at", n_if(s == "completed").alias("success_count"), n_if(s == "failed").alias("failure_count"))
    spent = per_day(records.filter("metric_name = 'total_processing_duration'"), "recorded_at",
                    rounded(F.avg("metric_value"), 2).alias("avg_processing_time"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return days.join(created, "day", "left").join(ended, "day", "left").join(spent, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), zero("total_jobs"), zero("success_count"), zero("failure_count"),
        F.coalesce("avg_processing_time", F.lit(0.0)).alias("avg_processing_time"))


def performance_report(jobs: DataFrame, records: DataFrame, texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: stage means, rates, text sizes, pages and chunks per chunked document."""
    s, m = F.col("status"), F.col("metric_name")
    mean = lambda name: F.coalesce(rounded(F.avg(F.when(m == name, F.col("metric_value"))), 2), F.lit(0.0))
    r = records.agg(mean("total_processing_duration").alias("average_processing_time"),
                    mean("extraction_duration").alias("average_extraction_time"),
                    mean("cleaning_duration").alias("average_cleaning_time"),
                    mean("chunking_duration").alias("average_chunking_time"))
    j = jobs.agg(share(n_if(s == "completed"), F.count("*"), 100.0, 2).alias("success_rate"),
                 share(n_if(F.col("retry_count") > 0), F.count("*"), 0.0, 2).alias("retry_rate"),
                 share(n_if(s == "failed"), F.count("*"), 0.0, 2).alias("failure_rate"))
    t = texts.agg(F.max(F.length("text")).alias("largest_processed_document_size"),
                  F.min(F.length("text")).alias("smallest_processed_document_size"),
                  rounded(F.avg("page_count"), 2).alias("average_pages_processed"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).agg(rounded(F.avg("n"), 2).alias("average_chunks_generated"))
    return r.crossJoin(j).crossJoin(t).crossJoin(c)  # one row each
