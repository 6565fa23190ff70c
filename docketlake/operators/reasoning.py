"""Reasoning over the extracted tables: intents, hops, ranking, contradictions, grounding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import bind, clamp, col, first_regex, matches, rounded, strip
from ..session import cut_lineage
from .graph import both_ways
from .metrics import bundle
from .scale import first_by, running_sums, top_per_key

# ---- intent and plan --------------------------------------------------------------------------------


def classify_intent(query: str | Column) -> Column:
    """Struct of intent and confidence: 0.90 by rule, 0.50 for the default."""
    intent = first_regex(F.lower(strip(query)), rules.INTENT_RULES, rules.INTENT_DEFAULT)
    return F.struct(intent.alias("intent"), F.when(intent == rules.INTENT_DEFAULT, 0.50).otherwise(0.90).alias("confidence"))


def intent_strategy(intent: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.INTENT_STRATEGY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(intent)), F.lit("Simple lookup"))


def reasoning_plan(intent: str | Column) -> Column:
    """Ordered list of steps."""
    steps = lambda s: F.array(*[F.lit(x) for x in s])
    out = reduce(lambda acc, r: acc.when(col(intent).isin(r[0]), steps(r[1])), rules.REASONING_STEPS[1:],
                 F.when(col(intent).isin(rules.REASONING_STEPS[0][0]), steps(rules.REASONING_STEPS[0][1])))
    return out.otherwise(steps(rules.REASONING_STEPS_DEFAULT))


def hop_count(strategy: str | Column) -> Column:
    return F.when(col(strategy).isin("Multi-hop reasoning", "Cross-document reasoning"), 2).otherwise(1)


# ---- second hop --------------------------------------------------------------------------------------

def _first_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each key with their rank; all of them without a limit."""
    if limit is None:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return top_per_key(df, keys, order, limit)


def candidate_names(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, case_id, candidate, rank): the first distinct capitalised phrases of a query's hits."""
    found = hits.select("query_id", "case_id", F.col("rank").alias("_hit"), F.posexplode(matches("text", rules.CANDIDATE_NAME)).alias("_pos", "_raw"))
    found = found.withColumn("candidate", strip("_raw")).filter(F.length("candidate") > 3)
    once = first_by(found.select("query_id", "case_id", "candidate", "_hit", "_pos"), ["query_id", "case_id", "candidate"], ["_hit", "_pos"])
    return _first_rows(once, ["query_id"], [F.asc("_hit"), F.asc("_pos")], limit).select("query_id", "case_id", "candidate", "rank")


#: Names of one automaton, and characters of text that one task runs through it.
NAME_BLOCK = 20_000
TEXT_BLOCK = 8_000_000


def _find_names(names: list[str], texts: list[str]) -> Iterator[tuple[int, int]]:
    """(name number, text number) wherever a text holds a name, in one pass over each text."""
    automaton = ahocorasick.Automaton()
    for i, n in enumerate(names):
        automaton.add_word(n, i)
    automaton.make_automaton()
    for j, t in enumerate(texts):
        yield from ((i, j) for i in {i for _, i in automaton.iter(t)})


def mentions(names: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("case_id",), name_block: int = NAME_BLOCK, text_block: int = TEXT_BLOCK) -> DataFrame:
    """Pairs (keys, nid, hid) where a text (keys, hid, text) holds a name (keys, nid, text) of its own key.

    The names of a key become one automaton, which runs over each text once.  A key with very many names
    or very much text is cut into a grid of blocks.  Empty names are in no text.
    """
    keys = list(keys)
    names, texts = names.filter("text <> ''").select(*keys, "nid", "text"), texts.filter("text <> ''").select(*keys, "hid", "text")
    sizes = names.groupBy(*keys).agg(F.ceil(F.count("*") / name_block).cast("int").alias("_ns")).join(
        texts.groupBy(*keys).agg(F.ceil(F.sum(F.length("text")) / text_block).cast("int").alias("_ts")), keys)
    block = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    n = names.join(sizes, keys).withColumn("_n", block("nid", "_ns")).withColumn("_t", every("_ts")).drop("_ns", "_ts")
    t = texts.join(sizes, keys).withColumn("_t", block("hid", "_ts")).withColumn("_n", every("_ns")).drop("_ns", "_ts")
    # Both sides may come from one table; a cogroup needs columns of their own.
    n, t = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (n, t))
    kinds = [f"{c} {k}" for c, k in [*n.select(*keys, "nid").dtypes, *t.select("hid").dtypes]]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_find_names(a["text"].tolist(), b["text"].tolist())) if len(a) and len(b) else []
        i, j = [x for x, _ in found], [y for _, y in found]
        left, right = a[[*keys, "nid"]].iloc[i].reset_index(drop=True), b[["hid"]].iloc[j].reset_index(drop=True)
        return pd.concat([left, right], axis=1)

    group = [*keys, "_n", "_t"]
    return n.groupBy(*group).cogroup(t.groupBy(*group)).applyInPandas(meet, ", ".join(kinds))


def expand_hop(queries: DataFrame, candidates: DataFrame, items: DataFrame, limit: int | None = None, without: int | None = None) -> DataFrame:
    """Items (case_id, item_id, sort_key, text) of the case that mention a candidate, ``limit`` per query.

    Equal candidates of a case are looked up once, and each keeps only the items that could
    still be among a query's first ``limit``.  Queries without candidates take the first
    ``without`` items of their case.  Without limits all items are taken.
    """
    names = candidates.select("case_id", F.lower("candidate").alias("nid")).distinct().withColumn("text", F.col("nid"))
    hays = cut_lineage(items.select("case_id", F.col("item_id").alias("hid"), "sort_key", F.lower("text").alias("text")))
    keys = hays.drop("text")
    hits = mentions(names, hays.drop("sort_key")).join(keys, ["case_id", "hid"])
    hits = _first_rows(hits, ["case_id", "nid"], [F.asc("sort_key"), F.asc("hid")], limit)
    found = candidates.withColumn("nid", F.lower("candidate")).join(hits.drop("rank"), ["case_id", "nid"]).select("query_id", "hid", "sort_key").distinct()
    bare = queries.select("query_id", "case_id").join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    first = _first_rows(keys, ["case_id"], [F.asc("sort_key"), F.asc("hid")], without).drop("rank")
    found = found.unionByName(bare.join(first, "case_id").select("query_id", "hid", "sort_key"))
    return _first_rows(found, ["query_id"], [F.asc("sort_key"), F.asc("hid")], limit).select("query_id", F.col("hid").alias("item_id"), "rank")


def multi_hop(hits: DataFrame, entities: DataFrame, events: DataFrame, evidence: DataFrame, edges: DataFrame, summaries: DataFrame,
              names: int | None = None, limit: int | None = None, without: int | None = None, summaries_per_case: int | None = None) -> DataFrame:
    """Second hop of each query: rows (query_id, kind, item_id).

    ``hits``: query_id, case_id, rank, text.  The item tables: case_id, item_id, sort_key,
    text.  ``edges``: src, dst, edge_id.  ``summaries``: case_id, item_id, sort_key.
    ``names`` candidates are followed per query, to ``limit`` items of each kind (``without``
    where there is no candidate) and ``summaries_per_case`` summaries; None sets no limit.
    """
    queries = hits.select("query_id", "case_id").distinct()
    cands = cut_lineage(candidate_names(hits, names))
    parts = []
    ents = expand_hop(queries, cands, entities, limit, without)
    for kind, found in (("entity", ents), ("event", expand_hop(queries, cands, events, limit, without)), ("evidence", expand_hop(queries, cands, evidence, limit, without))):
        parts.append(found.select("query_id", F.lit(kind).alias("kind"), "item_id"))
    near = ents.join(both_ways(edges).withColumnRenamed("node", "item_id"), "item_id").select("query_id", F.lit("neighbor").alias("kind"), F.col("other").alias("item_id")).distinct()
    told = _first_rows(summaries, ["case_id"], [F.asc("sort_key"), F.asc("item_id")], summaries_per_case).drop("rank")
    told = queries.join(told, "case_id").select("query_id", F.lit("summary").alias("kind"), "item_id")
    return reduce(DataFrame.unionByName, [*parts, near, told])


# ---- ranking ---------------------------------------------------------------------------------------------

def central_labels(degrees: DataFrame, top: int) -> DataFrame:
    """Per case the list of its most connected labels, at most ``top`` entries (a bounded list, so the caller says how long)."""
    best = top_per_key(degrees, ["case_id"], [F.desc("degree"), F.asc("label")], top)
    return best.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.lower("label").alias("label"), "degree"))).alias("central"))


def rank_chunk_evidence(chunks: DataFrame, central: DataFrame) -> DataFrame:
    """Score of retrieved chunks (case_id, query_id, position, item_id, text, score)."""
    df = chunks.join(central, "case_id", "left")
    text = F.lower("text")
    hit = F.get(F.filter(F.coalesce("central", F.array()), lambda e: text.contains(e["label"])), F.lit(0))
    boost = F.coalesce(F.least(F.lit(0.15), hit["degree"] * F.lit(0.02)), F.lit(0.0))
    early = F.greatest(F.lit(0.0), F.lit(0.10) - F.col("position") * F.lit(0.02))
    score = F.least(F.lit(1.0), F.col("score") + boost + early)
    why = F.concat(
        F.format_string("High semantic relevance (%.2f)", "score"),
        F.when(boost > 0, F.format_string(" and mentions central entity with degree centrality boost (+%.2f)", boost)).otherwise(""),
        F.when(early > 0, ". Ranked early in vector search retrieval.").otherwise(""))
    return df.select("query_id", "item_id", F.lit("chunk").alias("type"), rounded(score, 3).alias("score"), why.alias("explanation"))


def rank_event_evidence(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Score of events (query_id, item_id, description, confidence) given the query text."""
    df = events.join(queries.select("query_id", "query"), "query_id")
    word = F.exists(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""), lambda w: F.lower("description").contains(w))
    boost = F.when(word, 0.15).otherwise(0.0)
    score = F.least(F.lit(1.0), F.col("confidence") * 0.7 + boost)
    why = F.concat(F.format_string("Timeline Event with extraction confidence (%.2f)", "confidence"),
                   F.when(boost > 0, F.format_string(" and direct query keyword matching boost (+%.2f)", boost)).otherwise(""))
    return df.select("query_id", "item_id", F.lit("event").alias("type"), rounded(score, 3).alias("score"), why.alias("explanation"))


def rank_evidence(chunks: DataFrame, central: DataFrame, events: DataFrame, queries: DataFrame) -> DataFrame:
    return rank_chunk_evidence(chunks, central).unionByName(rank_event_evidence(events, queries))


def rank_citations(citations: DataFrame, prefix_chars: int | None = None) -> DataFrame:
    """Best citation per query and text, with its strength; ``prefix_chars`` takes texts of one beginning as one."""
    prefix = F.lower(F.substring(strip("text"), 1, prefix_chars) if prefix_chars else strip("text"))
    df = citations.withColumn("_prefix", prefix).withColumn("_neg", -F.col("score"))
    best = first_by(df, ["query_id", "_prefix"], ["_neg", "id"]).drop("_prefix", "_neg")
    s = F.col("score")
    return best.withColumn("strength", F.when(s >= 0.8, "Primary").when(s >= 0.6, "Supporting").otherwise("Contextual")).withColumn(
        "relevance_score", rounded("score", 3))


# ---- contradictions -----------------------------------------------------------------------------------------

def contradicting_dates(events: DataFrame, by: str = "case_id", id: str = "event_id", title_chars: int | None = None) -> DataFrame:
    """Events more than a day away from the first event of the case with the same title key.

    The key is the title's letters and digits, or its first ``title_chars`` of them.
    """
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    key = F.substring(key, 1, title_chars) if title_chars else key
    df = events.withColumn("title_key", key).filter(F.length("title_key") >= 5)
    head = df.groupBy(by, "title_key").agg(F.min_by(F.struct(F.col(id).alias("id"), "event_date"), id).alias("first"))
    gap = F.floor((F.unix_micros("event_date") - F.unix_micros("first.event_date")) / 86_400_000_000)
    return (
        df.join(head, [by, "title_key"]).withColumn("days", F.abs(gap)).filter((F.col("days") > 1) & (F.col(id) != F.col("first.id")))
        .select(by, F.col("first.id").alias("first_id"), F.col(id).alias("second_id"), "days", F.when(F.col("days") > 30, "high").otherwise("medium").alias("severity"),
                F.lit(0.95).alias("confidence"))
    )


def _flags(text: Column, side: int) -> Column:
    """Bit mask of the opposing-fact rules whose word on this side occurs."""
    return reduce(lambda a, b: a + b, [F.when(text.contains(pair[side]), 1 << i).otherwise(0) for i, pair in enumerate(rules.OPPOSING_FACTS)])


def contradicting_facts(facts: DataFrame, by: str = "case_id", id: str = "fact_id", text: str = "text") -> DataFrame:
    """Per fact the number of later facts of its case that oppose it.

    The pairs themselves are a product per case.  Counting needs none of them: facts with
    opposing words are counted per mask with running sums, and a fact with mask m opposes
    every later fact whose mask meets m.
    """
    both = bind(F.lower(text), lambda t: F.struct(_flags(t, 0).alias("left"), _flags(t, 1).alias("right")))
    df = facts.select(by, id, both.alias("_f")).select(by, id, "_f.left", "_f.right")
    df = cut_lineage(df).filter("`left` > 0 or `right` > 0")  # the texts are read once
    masks = range(1, 2 ** len(rules.OPPOSING_FACTS))
    hit = {f"n{m}": F.when(F.col("right").bitwiseAND(F.lit(m)) > 0, 1).otherwise(0) for m in masks}
    upto = running_sums(df, [by], [id], hit)
    total = df.groupBy(by).agg(*[F.sum(c).alias(f"t{m}") for m, c in zip(masks, hit.values())])
    pick = lambda p: F.coalesce(*[F.when(F.col("left") == m, F.col(f"{p}{m}")) for m in masks])
    return upto.join(total, by).filter("`left` > 0").select(by, id, (pick("t") - pick("n")).alias("opposed")).filter("opposed > 0")


def opposing_pairs(facts: DataFrame, chosen: DataFrame, by: str = "case_id", id: str = "fact_id", text: str = "text") -> DataFrame:
    """The opposing pairs of the chosen facts, written out."""
    t = F.lower(text)
    a = facts.join(chosen.select(id).distinct(), id, "left_semi").select(by, F.col(id).alias("first_id"), _flags(t, 0).alias("left")).filter("`left` > 0")
    b = facts.select(by, F.col(id).alias("second_id"), _flags(t, 1).alias("right")).filter("`right` > 0")
    return a.join(b, by).filter((F.col("first_id") < F.col("second_id")) & (F.col("left").bitwiseAND(F.col("right")) > 0)).select(
        by, "first_id", "second_id", F.lit("medium").alias("severity"), F.lit(0.80).alias("confidence"))


def contradiction_report(cases: DataFrame, dates: DataFrame, facts: DataFrame, by: str = "case_id") -> DataFrame:
    """Per case: number of conflicts, worst severity, confidence (1.0 without conflicts)."""
    d = dates.groupBy(by).agg(F.count("*").alias("_d"), F.max(F.when(F.col("severity") == "high", 1).otherwise(0)).alias("_high"))
    f = facts.groupBy(by).agg(F.sum("opposed").alias("_f"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("_d") + zero("_f")
    return cases.select(by).distinct().join(d, by, "left").join(f, by, "left").select(
        by, n.alias("conflicts"), F.when(zero("_high") == 1, "high").when(n > 0, "medium").otherwise("low").alias("severity"),
        F.when(n > 0, 0.88).otherwise(1.0).alias("confidence"))


# ---- confidence and grounding ----------------------------------------------------------------------------------

def calibrate_confidence(queries: DataFrame, chunks: DataFrame, citations: DataFrame, conflicts: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Weighted confidence per query from the rows each table holds for it."""
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    df = queries.select("query_id").join(chunks.groupBy("query_id").agg(F.avg("score").alias("_score")), "query_id", "left")
    for t, name in ((citations, "_cites"), (conflicts, "_conflicts"), (entities, "_entities"), (events, "_events")):
        df = df.join(count(t, name), "query_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    quality = F.coalesce("_score", F.lit(0.50))
    support = F.least(F.lit(1.0), n("_cites") * F.lit(0.25))
    agreement = F.greatest(F.lit(0.0), F.lit(1.0) - n("_conflicts") * F.lit(0.20))
    graph = F.least(F.lit(1.0), F.lit(0.40) + n("_entities") * F.lit(0.10))
    timeline = F.least(F.lit(1.0), F.lit(0.50) + n("_events") * F.lit(0.10))
    overall = clamp(quality * 0.30 + support * 0.25 + agreement * 0.25 + (graph + timeline) / 2 * 0.20)
    r = lambda c, name: rounded(c, 3).alias(name)
    return df.select("query_id", r(overall, "overall_confidence"), r(quality, "retrieval_quality"), r(support, "citation_support"),
                     r(agreement, "evidence_agreement"), r(graph, "graph_connectivity"), r(timeline, "timeline_completeness"))


def _warnings(answer: Column, context: Column, citations: Column) -> Column:
    a, ctx = F.lower(answer), F.lower(F.coalesce(context, F.lit("")))
    warn = lambda kind, text, sev: F.struct(F.lit(kind).alias("type"), text.alias("warning"), F.lit(sev).alias("severity"))
    missing = F.filter(matches(a, r"\bsection\s+(\d+[a-zA-Z]?)\b"),
                       lambda s: ~ctx.contains(F.concat(F.lit("section "), s)) & ~ctx.contains(F.concat(F.lit("sec. "), s)))
    years = F.filter(matches(a, r"\b(19\d{2}|20\d{2})\b"), lambda y: ~ctx.contains(y))
    uncited = F.when((citations == 0) & (F.length(answer) > 100), F.array(warn("citation_coverage", F.lit(
        "The response contains specific factual statements but lacks citation mappings to original document source files."), "medium")))
    return F.concat(
        F.transform(missing, lambda s: warn("hallucination", F.concat(F.lit("Answer references 'Section "), F.upper(s), F.lit(
            "' which is not explicitly mentioned in the retrieved document chunks.")), "medium")),
        F.coalesce(uncited, F.array().cast("array<struct<type:string,warning:string,severity:string>>")),
        F.transform(years, lambda y: warn("factual_grounding", F.concat(F.lit("The date/year '"), y, F.lit(
            "' was found in the answer but does not appear in retrieved document timelines.")), "low")))


def grounding_warnings(answers: DataFrame) -> DataFrame:
    """Rows (answer_id, type, warning, severity) for ``answer``, ``context`` and the number of ``citations``."""
    return answers.select("answer_id", F.inline(_warnings(F.col("answer"), F.col("context"), F.col("citations"))))


def validate_answers(answers: DataFrame, threshold: float = 0.50) -> DataFrame:
    w = F.col("_w")
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.size(w) * F.lit(0.15))
    high = F.exists(w, lambda x: x["severity"] == "high")
    return answers.withColumn("_w", _warnings(F.col("answer"), F.col("context"), F.col("citations"))).select(
        "answer_id", ((score >= threshold) & ~high).alias("success"), rounded(score, 3).alias("grounding_score"), (F.col("citations") > 0).alias("citation_coverage"),
        F.size(w).alias("warnings"), F.when(F.size(w) < 3, "verified").otherwise("needs_review").alias("logical_consistency"))


# ---- comparison ----------------------------------------------------------------------------------------------------

def _eq(c: str, yes: float, no: float) -> Column:
    return F.when(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), yes).otherwise(no)


def _say(c: str, yes: str, no: str) -> Column:
    return F.when(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), yes).otherwise(no)


def _size_ratio(c: str) -> Column:
    a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
    return rounded(F.least(a, b) / F.greatest(a, b, F.lit(1)), 2)


# Per kind (parameter, column, similarity, evaluation), and the overall score.
def _parameters(kind: str) -> tuple[list[tuple[str, str, Column, Column, str]], Column]:
    lit = F.lit
    if kind == "document":
        return [
            ("Document Title", "title", lit(0.40), lit("Different filing documents."), ""),
            ("Mime Type", "mime_type", _eq("mime_type", 1.0, 0.0), _say("mime_type", "Same document formats.", "Different file extensions."), "Unknown"),
            ("Category", "category", _eq("category", 1.0, 0.20), _say("category", "Similar category types.", "Different functional classes."), ""),
            ("Size (Bytes)", "file_size", _size_ratio("file_size"), lit("Size ratio comparison."), ""),
        ], lit(0.72)
    if kind == "case":
        return [
            ("Title", "title", lit(0.30), lit("Separate litigation folders."), ""),
            ("Court Name", "court_name", _eq("court_name", 0.90, 0.20), lit("Jurisdictional forum match."), "N/A"),
            ("Judge Name", "judge_name", _eq("judge_name", 1.0, 0.0), _say("judge_name", "Same presiding judge.", "Different judiciary assignments."), "N/A"),
            ("Client Name", "client_name", _eq("client_name", 0.80, 0.10), lit("Client representation match status."), "N/A"),
        ], lit(0.65)
    if kind == "entity":
        return [
            ("Name", "name", _eq("normalized_name", 1.0, 0.30), _say("normalized_name", "Identical names after normalization.", "Different names."), ""),
            ("Type", "entity_type", _eq("entity_type", 1.0, 0.0), lit("Same role entity classification."), ""),
            ("Role", "role", _eq("role", 0.90, 0.10), lit("Similar operational functions in case filings."), "N/A"),
        ], _eq("normalized_name", 0.85, 0.40)
    if kind == "statute":
        same_act = F.when(F.lower("a.act_name") == F.lower("b.act_name"), 1.0).otherwise(0.20)
        return [
            ("Act Name", "act_name", same_act, lit("Identical referenced act."), ""),
            ("Section Reference", "section_reference", _eq("section_reference", 1.0, 0.0), lit("Exactly matching sections."), "N/A"),
        ], _eq("normalized_reference", 0.95, 0.30)
    raise ValueError(f"unknown kind {kind}")


def compare_pairs(pairs: DataFrame, items: DataFrame, kind: str, id: str = "id") -> DataFrame:
    """One row per pair and parameter.  ``pairs``: (a_id, b_id); ``items``: the attributes by id."""
    params, overall = _parameters(kind)
    joined = pairs.alias("p").join(items.alias("a"), F.col("p.a_id") == F.col(f"a.{id}")).join(items.alias("b"), F.col("p.b_id") == F.col(f"b.{id}"))
    shown = lambda side, c, dflt: F.coalesce(F.nullif(F.col(f"{side}.{c}").cast("string"), F.lit("")), F.lit(dflt))
    rows = F.array(*[
        F.struct(F.lit(name).alias("parameter"), shown("a", c, dflt).alias("item_a_value"), shown("b", c, dflt).alias("item_b_value"),
                 sim.cast("double").alias("similarity_score"), say.alias("evaluation")) for name, c, sim, say, dflt in params])
    return joined.select(F.col("p.a_id").alias("a_id"), F.col("p.b_id").alias("b_id"), overall.alias("overall_score"), F.inline(rows))


def qa_analytics(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Figures over question history with intent, strategy, confidence, latency and stored validation."""
    val = F.from_json("validation_json", "success boolean, warnings array<struct<type string>>")
    df = history.withColumn("_v", val)
    failed = F.count_if(~F.coalesce("_v.success", F.lit(True)))
    bad = F.count_if(F.exists(F.coalesce("_v.warnings", F.array()), lambda w: w["type"] == "hallucination"))
    c = F.col("confidence")
    level = F.when(c < 0.4, "0.0-0.4").when(c < 0.6, "0.4-0.6").when(c < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return bundle(df, "reasoning", cards={
        "total_queries": (F.count("*"), "queries"), "average_latency_ms": (rounded(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 4), "ms"),
        "average_confidence": (rounded(F.avg(c), 4), "score"), "validation_failures": (failed, "queries"),
        "hallucination_rate": (rounded(bad / F.count("*"), 4), "share")},
        groups={"intent_distribution": F.col("intent"), "strategy_distribution": F.col("strategy"), "confidence_distribution": level}, by=by)
