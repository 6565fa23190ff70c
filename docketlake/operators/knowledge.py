"""Extraction of parties, statutes, claims and other items from legal prose.

Every extractor is a column: text -> array of items with one common shape.  A whole
extraction is therefore one pass over the chunks and one ``inline``, whatever the number
of kinds asked for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import bind, col, contains_any, matches, rounded, sentences, strip
from ..session import cut_lineage


def combine_confidence(**parts: Column) -> Column:
    """Weighted mean of the parts that are present, 3 digits, within 0..1.

    Names: extractor, embedding, review, normalization, relationship, strength.
    """
    num, den = F.lit(0.0), F.lit(0.0)
    for name, weight in rules.CONFIDENCE_WEIGHTS:
        if name in parts:
            num = num + F.coalesce(parts[name] * weight, F.lit(0.0))
            den = den + F.when(parts[name].isNotNull(), weight).otherwise(0.0)
    return F.when(den > 0, F.least(F.greatest(rounded(num / den, 3), F.lit(0.0)), F.lit(1.0))).otherwise(parts.get("extractor", F.lit(None)))


_TEXT_FIELDS = ("kind", "type", "text", "role", "category", "labels", "reference", "aliases")


def _item(confidence: Column, strength: Column | None = None, importance: Column | None = None, **fields: Column) -> Column:
    return F.struct(
        *[fields.get(f, F.lit(None)).cast("string").alias(f) for f in _TEXT_FIELDS],
        (F.lit(None) if strength is None else strength).cast("double").alias("strength"),
        (F.lit(None) if importance is None else importance).cast("double").alias("importance"),
        confidence.cast("double").alias("confidence"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return matches(text, rules.FOR_JAVA.get(pattern, pattern), group)


def _gated(searched: Column, text: Column, pattern: str) -> Column:
    """Matches of a rule that is only tried where its words occur: looking for a word is far cheaper than a search for the pattern."""
    needed = [contains_any(searched, words) for words in rules.NEEDED_WORDS.get(pattern, [])]
    found = _found(text, pattern)
    return F.when(reduce(lambda a, b: a & b, needed), found).otherwise(F.array().cast("array<string>")) if needed else found


def _groups(text: Column, pattern: str, *groups: int) -> Column:
    """Array of structs g1, g2, … with the given capture groups of each match; the text is searched once, the groups are taken from the matches."""
    return F.transform(_found(text, pattern, 0), lambda m: F.struct(*[F.regexp_extract(m, rules.FOR_JAVA.get(pattern, pattern), g).alias(f"g{g}") for g in groups]))


def _entity(kind: str, name: Column, role: Column) -> Column:
    return _item(F.lit(rules.ENTITY_CONFIDENCE[kind]), kind=F.lit("entity"), type=F.lit(kind), text=strip(name), role=role)


def parties(text: Column) -> Column:
    roles = ["plaintiff", "defendant", "accused", "petitioner", "respondent", "complainant", "appellant"]
    role_first = F.transform(_groups(text, rules.PARTY_ROLE_FIRST, 1, 2), lambda m: _entity("party", m["g2"], F.lower(m["g1"])))

    def named(m: Column) -> Column:
        # A capitalised role in front is taken as the role, whatever follows as the name.
        is_role = F.lower(m["g1"]).isin(roles)
        return _entity("party", F.when(is_role, m["g2"]).otherwise(m["g1"]), F.lower(F.when(is_role, m["g1"]).otherwise(m["g3"])))

    return F.concat(role_first, F.transform(_groups(text, rules.PARTY_NAME_FIRST, 1, 2, 3), named))


def judges(text: Column) -> Column:
    return F.concat(*[F.transform(_gated(text, text, p), lambda n: _entity("judge", n, F.lit("judge"))) for p in rules.JUDGE_PATTERNS])


def courts(text: Column) -> Column:
    return F.transform(_found(text, rules.COURT_PATTERN), lambda n: _entity("court", n, F.lit("court")))


def witnesses(text: Column) -> Column:
    return F.transform(_found(text, rules.WITNESS_PATTERN), lambda n: _entity("witness", n, F.lit("witness")))


def issue_labels(issue: str | Column) -> Column:
    """All categories with a keyword in the text, in table order; one fallback label."""

    def labels(t: Column) -> Column:
        hits = F.array(*[F.when(contains_any(t, kws), name) for name, kws in rules.ISSUE_KEYWORDS])
        fallback = F.when(contains_any(t, ["procedure", "jurisdiction"]), "Procedural").otherwise("Civil")
        found = F.filter(hits, lambda x: x.isNotNull())
        return bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(fallback)))

    return bind(F.lower(col(issue)), labels)


def issue_confidence(labels: Column) -> Column:
    return rounded(F.least(F.lit(0.75) + F.size(labels) * F.lit(0.05), F.lit(0.98)), 3)


def issues(text: Column) -> Column:
    def one(m: Column) -> Column:
        full = F.concat(F.lit("Whether "), strip(m))
        return bind(issue_labels(full), lambda labels: _item(
            issue_confidence(labels), kind=F.lit("issue"), type=F.lit("issue"), text=full, category=F.get(labels, F.lit(0)),
            labels=F.array_join(labels, ",")))

    return F.transform(matches(text, rules.ISSUE_PATTERN), one)


def claims(text: Column) -> Column:
    sought = F.transform(matches(text, rules.CLAIM_PATTERN), lambda m: _item(
        F.lit(rules.CLAIM_CONFIDENCE), kind=F.lit("claim"), type=F.lit("claim_primary"), text=F.concat(F.lit("Sought "), strip(m))))
    disputed = F.transform(matches(text, rules.DEFENSE_PATTERN), lambda m: _item(
        F.lit(rules.DEFENSE_CONFIDENCE), kind=F.lit("claim"), type=F.lit("defense"), text=F.concat(F.lit("Disputed/Rebutted "), strip(m))))
    return F.concat(sought, disputed)


def arguments(text: Column, table=rules.ARGUMENT_RULES) -> Column:
    def typed(name: str, conf: float):
        return lambda m: _item(F.lit(conf), kind=F.lit("claim"), type=F.lit(name), text=strip(m))

    found = bind(F.lower(text), lambda low: F.concat(*[F.transform(_gated(low, text, p), typed(name, conf)) for name, conf, p in table]))
    return F.filter(found, lambda x: x["text"] != "")


def evidence_strength(description: str | Column) -> Column:
    return bind(F.lower(col(description)), lambda t: F.when(contains_any(t, rules.STRONG_EVIDENCE), 0.90).when(
        contains_any(t, rules.WEAK_EVIDENCE), 0.25).otherwise(0.50))


def evidence(text: Column) -> Column:
    def one(m: Column) -> Column:
        t = strip(m)
        kind = F.when(F.lower(t).contains("testified"), "witness_testimony").when(F.lower(t).contains("forensic"), "forensic").otherwise("exhibit")
        return bind(evidence_strength(t), lambda s: _item(
            combine_confidence(extractor=F.lit(rules.EVIDENCE_CONFIDENCE), strength=s), strength=s, kind=F.lit("evidence"), type=kind, text=t))

    return bind(F.lower(text), lambda low: F.concat(*[F.transform(_gated(low, text, p), one) for p in rules.EVIDENCE_PATTERNS]))


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_statute(act: str | Column, section: str | Column) -> Column:
    """Struct of canonical act, section number, normalized reference, offence category, aliases."""
    raw = strip(act)
    canonical = F.coalesce(F.try_element_at(_literal_map(rules.ACT_ALIASES), F.lower(raw)), raw)
    number = strip(F.regexp_replace(strip(F.coalesce(col(section), F.lit(""))), r"(?i)^(?:Sec\.|Section|Sec)\s*", ""))
    offence = F.when(canonical == rules.PENAL_CODE, F.coalesce(F.try_element_at(_literal_map(rules.OFFENCES), number), F.lit(rules.PENAL_DEFAULT))).otherwise(
        rules.OFFENCE_DEFAULT)
    return F.struct(
        canonical.alias("act"), F.nullif(number, F.lit("")).alias("section"),
        F.when(number != "", F.concat(canonical, F.lit(", Section "), number)).otherwise(canonical).alias("reference"),
        offence.alias("offence"), F.concat(col(act), F.lit(", "), F.upper(col(act))).alias("aliases"))


def statutes(text: Column) -> Column:
    def one(m: Column) -> Column:
        return bind(normalize_statute(m["g3"], F.concat(m["g1"], F.lit(" "), m["g2"])), lambda n: _item(
            combine_confidence(extractor=F.lit(rules.STATUTE_CONFIDENCE), normalization=F.lit(0.95)), kind=F.lit("statute"), type=F.lit("statute"),
            text=n["act"], role=n["section"], category=n["offence"], reference=n["reference"], aliases=n["aliases"]))

    return F.transform(_groups(text, rules.STATUTE_PATTERN, 1, 2, 3), one)


def facts(text: Column, page: Column | None = None) -> Column:
    hit = F.filter(sentences(text), lambda s: bind(F.lower(s), lambda t: contains_any(t, rules.FACT_TRIGGERS)))

    def one(s: Column) -> Column:
        return bind(bind(F.lower(s), lambda t: contains_any(t, rules.PROCEDURAL_FACTS)), lambda procedural: _item(
            F.lit(rules.FACT_CONFIDENCE), kind=F.lit("fact"), type=F.lit("fact"), text=s,
            category=F.when(procedural, "Procedural Facts").otherwise("Factual Findings"),
            importance=F.when(procedural, 0.5).otherwise(0.8),
            reference=F.concat(F.lit("Page "), page) if page is not None else F.lit(None)))

    return F.transform(hit, one)


EXTRACTORS = {
    "facts": facts, "parties": parties, "judges": judges, "courts": courts, "witnesses": witnesses, "issues": issues, "claims": claims,
    "arguments": arguments, "evidence": evidence, "statutes": statutes,
}


def extract(chunks: DataFrame, kinds: list[str] | None = None, text: str = "text") -> DataFrame:
    """Items of the given kinds (all by default), with the chunk they come from.

    ``item_id`` is chunk, kind and position: stable across runs and partitionings.
    """
    arrays = []
    for k in kinds or list(EXTRACTORS):
        page = F.col("page_start") if k == "facts" and "page_start" in chunks.columns else None
        arrays.append(EXTRACTORS[k](F.col(text), page) if page is not None else EXTRACTORS[k](F.col(text)))
    keep = [c for c in ("case_id", "doc_id", "chunk_id", "page_start") if c in chunks.columns]
    items = chunks.select(*keep, F.posexplode(F.concat(*arrays)).alias("position", "_i")).select(*keep, "position", "_i.*")
    return items.withColumn("item_id", F.concat_ws("/", "chunk_id", "kind", F.lpad(F.col("position").cast("string"), 6, "0")))


def extraction_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """Items per kind, next to each other."""
    names = {"fact": "facts", "entity": "entities", "issue": "issues", "claim": "claims", "evidence": "evidence", "statute": "statutes"}
    return items.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in names.items()])


def knowledge_stats(items: DataFrame, by: list[str]) -> DataFrame:
    """The six counts without merged entities (``status`` from entity resolution)."""
    return extraction_counts(items.filter(F.coalesce("status", F.lit("")) != "merged"), by)


# ---- names ------------------------------------------------------------------------------------------

def normalize_entity_name(name: str | Column) -> Column:
    """Lower case, titles cut out, dots and commas to blanks, blanks squeezed."""
    c = reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit("")), rules.NAME_TITLES, F.lower(col(name)))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[.,]", " "), r"\s+", " "))


def name_tokens(clean: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(col(clean), " "), lambda t: t != "")))


def name_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays; 0 when one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# ---- relations ------------------------------------------------------------------------------------------

def rewrite_references(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Point both ends of each edge at the canonical entity.  ``merged``: (entity_id, canonical_id)."""
    for end in ("source_id", "target_id"):
        m = merged.filter("canonical_id is not null").select(F.col("entity_id").alias(end), F.col("canonical_id").alias("_new"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges


# Fixed values: (relation, source role, target role, confidence).
RELATIONS = [
    ("REPRESENTS", "advocate", "party", 0.90),
    ("HEARD_BY", "judge", "court", 0.95),
    ("REFUTES", "refuting", "claim", 0.80),
    ("SUPPORTS", "supporting", "claim", 0.85),
    ("RELIES_ON", "claim", "statute", 0.88),
    ("REFERENCES", "fact", "statute", 0.85),
]


def relation_sides(items: DataFrame) -> DataFrame:
    """Who takes part in which relation of a case, and on which side.

    All sources of a relation in a case are linked to all its targets, so the edges of a
    case are complete two-sided blocks.  A block is kept as its two node lists, whose size
    is the number of nodes; the edges themselves are a product and are only written out
    for chosen nodes (``edges_of``).  ``partners`` is the degree of the node in the block.
    """
    k, t, text = F.col("kind"), F.col("type"), F.lower("text")
    refuting = contains_any(text, rules.REFUTING_WORDS)
    roles = {
        "advocate": (k == "entity") & ((t == "advocate") | F.coalesce(F.lower("role").contains("counsel"), F.lit(False))),
        "party": (k == "entity") & (t == "party"),
        "judge": (k == "entity") & (t == "judge"),
        "court": (k == "entity") & (t == "court"),
        "refuting": (k == "evidence") & refuting,
        "supporting": (k == "evidence") & ~refuting,
        "claim": k == "claim",
        "statute": k == "statute",
        "fact": k == "fact",
    }
    slots = F.filter(F.array(*[
        F.when(roles[role], F.struct(F.lit(rel).alias("relation"), F.lit(side).alias("side"), F.lit(conf).alias("confidence")))
        for rel, source, target, conf in RELATIONS for side, role in (("source", source), ("target", target))]), lambda x: x.isNotNull())
    sides = items.select("case_id", "item_id", "kind", "text", "doc_id", F.inline(slots))
    other = sides.groupBy("case_id", "relation", "side").agg(F.count("*").alias("partners")).withColumn(
        "side", F.when(F.col("side") == "source", "target").otherwise("source"))
    return sides.join(other, ["case_id", "relation", "side"])


#: Edges that one cell of a block writes out, and targets of a cell.
EDGES_AT_ONCE, TARGETS_AT_ONCE = 1 << 20, 256

#: Tasks at most; with more cells a task writes several.
MOST_TASKS = 4096


def edges_of(sides: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is one of the given nodes (``item_id``), written out with their reason.

    The nodes are few and the edges their product, so tasks are dealt by edges and not by the size of
    the nodes: a block is cut into a grid of cells, each of about EDGES_AT_ONCE edges to at most about
    TARGETS_AT_ONCE targets.  A node travels once per cell of its row or column, which is a small share of
    the edges, and the targets of a cell are few enough to stay in memory and to compress where they repeat.
    """
    block, cell = ["case_id", "relation"], ["case_id", "relation", "_row", "_column"]
    chosen = cut_lineage(sides.filter("side = 'source'").join(nodes.select("item_id").distinct(), "item_id", "left_semi"))
    wide = min(TARGETS_AT_ONCE, math.isqrt(EDGES_AT_ONCE))
    grid = chosen.groupBy(*block).agg(F.ceil(F.count("*") / (EDGES_AT_ONCE // wide)).alias("_rows"), F.ceil(F.max("partners") / wide).alias("_columns"), F.sum("partners").alias("_edges"))
    # The number is given, so that it isn't set by the bytes of the nodes.
    tasks = min(MOST_TASKS, -(-int(grid.agg(F.sum("_edges")).first()[0] or 1) // EDGES_AT_ONCE))
    place, every = lambda id, n: F.pmod(F.xxhash64(id), n), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    grid = grid.drop("_edges")
    chosen = chosen.join(grid, block).withColumn("_row", place("item_id", "_rows")).withColumn("_column", every("_columns")).drop("_rows", "_columns").repartition(tasks, *cell)
    targets = sides.filter("side = 'target'").select(*block, F.col("item_id").alias("target_id"), F.col("text").alias("target_text"),
                                                    F.col("kind").alias("target_type"))
    targets = targets.join(grid, block).withColumn("_column", place("target_id", "_columns")).withColumn("_row", every("_rows")).drop("_rows", "_columns").repartition(tasks, *cell)
    reason = (
        F.when(F.col("relation") == "REPRESENTS", F.concat(F.lit("Advocate "), "text", F.lit(" represents party "), "target_text", F.lit(" in case litigation.")))
        .when(F.col("relation") == "HEARD_BY", F.concat(F.lit("Judge "), "text", F.lit(" hears arguments presiding over bench at "), "target_text", F.lit(".")))
        .when(F.col("relation").isin("SUPPORTS", "REFUTES"),
              F.concat(F.lit("Evidence item description connects to claim statement with relation '"), "relation", F.lit("'.")))
        .when(F.col("relation") == "RELIES_ON", F.concat(F.lit("Claim arguments rely on "), "target_text", F.lit(".")))
        .otherwise(F.concat(F.lit("Factual finding references statutory provisions of "), "target_text", F.lit(".")))
    )
    return chosen.join(targets, cell).select(
        "case_id", F.col("item_id").alias("source_id"), F.col("kind").alias("source_type"), "target_id", "target_type", "relation", "confidence",
        reason.alias("reasoning"), "doc_id")


def graph_nodes(items: DataFrame) -> DataFrame:
    """Nodes for display: entities that were not merged, claims, evidence, statutes."""
    k = F.col("kind")
    shown = items.filter(k.isin("entity", "claim", "evidence", "statute") & (F.coalesce("status", F.lit("")) != "merged"))
    label = (
        F.when(k == "statute", F.col("reference")).when(k == "entity", F.col("text"))
        .otherwise(F.concat(F.substring("text", 1, 40), F.lit("...")))
    )
    kind = F.when(k.isin("entity", "claim"), F.col("type")).otherwise(k)
    return shown.select("case_id", F.col("item_id").alias("id"), kind.alias("type"), label.alias("label"))


def graph_links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation").alias("type"), "confidence")
