"""Conversation memory, query rewriting, prompts and citations."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import col, contains_any, ellipsis, matches, rounded, strip
from .metrics import with_usage
from .scale import first_by, previous_value, top_per_key

# ---- memory ------------------------------------------------------------------------------------------


def recent_messages(messages: DataFrame, turns: int = 5) -> DataFrame:
    """The last 2·turns messages of each session (a bounded rank, cut before the shuffle)."""
    return top_per_key(messages, ["session_id"], [F.desc("turn")], 2 * turns, "_back")


def conversation_memory(messages: DataFrame, turns: int = 5, topics_shown: int | None = None, topic_chars: int | None = None) -> DataFrame:
    """Per session: recent turns, cited documents, organisations, turn count and topics.

    The lists come from at most 2·turns messages of a session.  ``topics_shown`` and
    ``topic_chars`` cut the summary to so many topics of so many characters.
    """
    total = messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    recent = recent_messages(messages, turns)
    cites = F.when(F.col("role") == "assistant", F.from_json("citations_json", "array<struct<document_name string, page_number long>>"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content", cites.alias("cites"))))
    per = recent.groupBy("session_id").agg(rows.alias("m"))
    users = F.transform(F.filter("m", lambda x: x["role"] == "user"), lambda x: x["content"])
    names = F.flatten(F.transform("m", lambda x: F.coalesce(F.transform(x["cites"], lambda c: c["document_name"]), F.array().cast("array<string>"))))
    orgs = F.flatten(F.transform("m", lambda x: F.transform(matches(x["content"], rules.ORGANISATION), strip)))
    topics = F.slice(users, 1, topics_shown) if topics_shown else users
    topics = F.array_join(F.transform(topics, lambda q: ellipsis(q, topic_chars)) if topic_chars else topics, ", ")
    return per.join(total, "session_id").select(
        "session_id", F.floor(F.col("_n") / 2).alias("turn_count"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("recent_turns"),
        F.array_distinct(names).alias("referenced_documents"), F.array_sort(F.array_distinct(orgs)).alias("referenced_entities"),
        F.when((F.col("_n") > 2 * turns) & (F.size(users) > 0), F.concat(
            F.lit("Discussion centered around legal queries concerning: "), topics, F.lit("."))).otherwise("").alias("summary"))


# ---- follow-up questions ---------------------------------------------------------------------------------

def _resolved(query: Column, last: Column) -> Column:
    q = strip(query)
    subject = F.coalesce(F.nullif(F.regexp_extract(last, rules.FOLLOWUP_SUBJECT, 1), F.lit("")), F.lit("document"))
    thing = F.regexp_replace(q, F.lit(r"(?i)\b(it|this|that)\b"), F.concat(F.lit("the "), subject))
    entity = F.regexp_extract(last, rules.FOLLOWUP_ENTITY, 1)
    person = F.when((entity != "") & F.lower(q).rlike(r"\b(they|them|he|she)\b"),
                    F.regexp_replace(thing, F.lit(r"(?i)\b(they|them|he|she)\b"), entity)).otherwise(thing)
    return F.when(F.coalesce(last, F.lit("")) == "", q).otherwise(F.regexp_replace(person, rules.FOLLOWUP_FILLER, ""))


def resolve_followup(messages: DataFrame) -> DataFrame:
    """User messages with ``last_question`` and the question with its pronouns replaced."""
    user = F.col("role") == "user"
    seen = previous_value(messages.select("session_id", "turn", "role", "text"), ["session_id"], ["turn"], F.when(user, F.col("text")), "last_question")
    return seen.filter(user).withColumn("resolved", _resolved(F.col("text"), F.col("last_question")))


def rewrite_query(messages: DataFrame) -> DataFrame:
    """Standalone question per user message, and whether the session asked it before."""
    df = resolve_followup(messages).withColumn("rewritten", strip(F.regexp_replace("resolved", r"[?.]+$", "")))
    asked = messages.filter("role = 'user'").groupBy("session_id", F.lower("text").alias("_asked")).agg(F.min("turn").alias("_first"))
    return (
        df.withColumn("_asked", F.lower("rewritten")).join(asked, ["session_id", "_asked"], "left")
        .withColumn("asked_before", F.coalesce(F.col("_first") < F.col("turn"), F.lit(False))).drop("_asked", "_first")
    )


def plan_retrieval(query: str | Column) -> Column:
    """Struct of strategy, top_k, threshold and the extra switch."""
    q = F.lower(col(query))
    plan = lambda s, k, t, extra: F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("top_k"), F.lit(t).alias("threshold"), F.lit(extra).cast("string").alias("extra"))
    out = None
    for s, needles, k, t, extra in rules.PLAN_RULES:
        cond = contains_any(q, needles)
        out = F.when(cond, plan(s, k, t, extra)) if out is None else out.when(cond, plan(s, k, t, extra))
    return out.otherwise(plan(*rules.PLAN_DEFAULT, None))


def flag_unsafe_queries(query: str | Column) -> Column:
    """Struct of safe, code and reason; leakage is tested before injection."""
    q = F.lower(col(query))
    verdict = lambda safe, code, reason: F.struct(F.lit(safe).alias("safe"), F.lit(code).cast("string").alias("code"), F.lit(reason).alias("reason"))
    return (
        F.when(contains_any(q, rules.LEAKAGE_PHRASES), verdict(False, "prompt_leakage", rules.LEAKAGE_REASON))
        .when(contains_any(q, rules.INJECTION_PHRASES), verdict(False, "prompt_injection", rules.INJECTION_REASON))
        .otherwise(verdict(True, None, rules.SAFE_REASON))
    )


# ---- citations -----------------------------------------------------------------------------------------------

def unknown_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, unknown): how many different marks of an answer name none of the chunks retrieved for it.

    ``retrieved`` holds (answer_id, chunk_id), or chunk_id alone when every answer had the same
    chunks.  Marks meet chunks in a join, so neither side is gathered.
    """
    keys = ["answer_id", "chunk_id"] if "answer_id" in retrieved.columns else ["chunk_id"]
    marks = answers.select("answer_id", F.explode(F.array_distinct(matches("content", rules.CITATION_MARK))).alias("chunk_id"))
    return marks.join(retrieved.select(*keys).distinct(), keys, "left_anti").groupBy("answer_id").agg(F.count("*").alias("unknown"))


def validate_responses(content: str | Column, unknown: str | Column) -> Column:
    """Struct of success and code, given the answer and the number of its unknown citations (null: none)."""
    c = col(content)
    cited = matches(c, rules.CITATION_MARK)
    out = lambda ok, code: F.struct(F.lit(ok).alias("success"), F.lit(code).cast("string").alias("code"))
    return (
        F.when(contains_any(c, rules.FALLBACK_PHRASES), out(True, "fallback"))
        .when(F.coalesce(col(unknown), F.lit(0)) > 0, out(False, "hallucinated_citations"))
        .when((F.regexp_count(c, F.lit(r"\S+")) > 30) & (F.size(cited) == 0), out(False, "missing_citations"))
        .otherwise(out(True, None))
    )


def resolve_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct marks of an answer in order, joined to the chunk they name."""
    marks = answers.select("answer_id", F.posexplode(F.array_distinct(matches("content", rules.CITATION_MARK))).alias("position", "chunk_id"))
    return marks.join(chunks, "chunk_id")


def strip_citation_marks(content: str | Column) -> Column:
    return strip(F.regexp_replace(col(content), rules.CITATION_MARK, ""))


def parse_typed_citations(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed marks of a text with title and text of what they name.

    ``nodes``: (type, id, title, text) over all kinds.  A mark without a node keeps the
    default title.
    """
    kinds, ids = matches("content", rules.TYPED_CITATION, 1), matches("content", rules.TYPED_CITATION, 2)
    marks = texts.select("text_id", F.posexplode(F.arrays_zip(kinds.alias("k"), ids.alias("i"))).alias("position", "m")).select(
        "text_id", "position", F.lower("m.k").alias("type"), F.lower("m.i").alias("id"))
    return marks.join(nodes, ["type", "id"], "left").select(
        "text_id", "position", "type", "id", F.coalesce("title", F.lit("Reference Source")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def typed_nodes(items: DataFrame, events: DataFrame) -> DataFrame:
    """(type, id, title, text) of extracted items and timeline events, as citations show them."""
    k = F.col("kind")
    title = (
        F.when(k == "fact", "Legal Fact").when(k == "entity", F.col("text")).when(k == "statute", F.col("reference")).when(k == "claim", "Claim Statement")
        .when(k == "evidence", F.concat(F.lit("Evidence Exhibit: "), "type"))
    )
    text = (
        F.when(k == "entity", F.concat(F.lit("Entity role: "), F.coalesce("role", F.lit("N/A")))).when(k == "statute", "").otherwise(F.col("text"))
    )
    a = items.filter(title.isNotNull()).select(k.alias("type"), F.col("item_id").alias("id"), title.alias("title"), text.alias("text"))
    b = events.select(F.lit("timelineevent").alias("type"), F.col("event_id").alias("id"), "title", F.coalesce("description", F.lit("")).alias("text"))
    return a.unionByName(b)


# ---- prompts, cost, summaries ------------------------------------------------------------------------------------

def estimate_cost(provider: Column, model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    (first, in1, out1), (second, in2, out2) = rules.PRICES_PER_1K
    p, m = F.lower(F.coalesce(provider, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    price = lambda i, o: prompt_tokens / 1000.0 * i + completion_tokens / 1000.0 * o
    return F.when(p.contains(first) | m.contains("gpt"), price(in1, out1)).when(p.contains(second), price(in2, out2)).otherwise(0.0)


def build_prompts(query: Column, context: Column, template: Column | None = None) -> Column:
    """A template with {query} and {context}, else the fixed frame around fenced-off context."""
    safe = F.replace(context, F.lit("```"), F.lit("'''"))
    framed = F.concat(F.lit(rules.PROMPT_HEAD), safe, F.lit(rules.PROMPT_MIDDLE), strip(query), F.lit(rules.PROMPT_TAIL))
    if template is None:
        return framed
    filled = F.replace(F.replace(template, F.lit("{query}"), query), F.lit("{context}"), context)
    return F.when(F.coalesce(template, F.lit("")) != "", filled).otherwise(framed)


def summary_lines(cases: DataFrame, items: DataFrame, events: DataFrame, summary_type: str, facts: int | None = None, claims: int | None = None) -> DataFrame:
    """Context of a case summary as lines (case_id, part, sort_key, line).

    Lines stay rows, because a case may hold any number of them; the order is part, then
    sort_key.  ``facts`` and ``claims`` cut the facts, and the claims of an executive summary,
    to the first ones of each case.
    """
    tag = lambda name, idc: F.concat(F.lit(f" [{name}: "), idc, F.lit("]"))
    na = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    header = cases.select("case_id", F.lit(0).alias("part"), F.lit("").alias("sort_key"), F.concat(
        F.lit("CASE TITLE: "), "title", F.lit("\nCOURT: "), na("court_name"), F.lit("\nJURISDICTION: "), na("jurisdiction"), F.lit("\nJUDGE: "), na("judge_name"),
        F.lit("\n")).alias("line"))
    titled = lambda part, t: cases.select("case_id", F.lit(part).alias("part"), F.lit("").alias("sort_key"), F.lit(t).alias("line"))

    def lines(df: DataFrame, part: int, text: Column, key: str = "item_id", n: int | None = None) -> DataFrame:
        if n:
            df = top_per_key(df, ["case_id"], [F.asc(key)], n)
        return df.select("case_id", F.lit(part).alias("part"), F.col(key).alias("sort_key"), F.concat(F.lit("- "), text).alias("line"))

    of = lambda k: items.filter(F.col("kind") == k)
    fact = F.concat("text", tag("Fact", F.col("item_id")))
    t = summary_type.lower()
    if t == "executive":
        claim = F.concat("text", F.lit(" (Type: "), "type", F.lit(")"), tag("Claim", F.col("item_id")))
        parts = [titled(1, "KEY FACTS:"), lines(of("fact"), 2, fact, n=facts), titled(3, "\nPRIMARY CLAIMS/DEFENSES:"), lines(of("claim"), 4, claim, n=claims)]
    elif t in ("chronological", "timeline"):
        day = F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("Unknown Date"))
        line = F.concat(F.lit("["), day, F.lit("] "), "title", F.lit(": "), F.coalesce("description", F.lit("")), tag("TimelineEvent", F.col("event_id")))
        dated = events.withColumn("_key", F.concat(F.coalesce(F.date_format("event_date", "yyyy-MM-dd HH:mm:ss"), F.lit("9999")), F.lit("/"), F.col("event_id")))
        parts = [titled(1, "CHRONOLOGICAL CASE EVENTS:"), lines(dated, 2, line, key="_key")]
    elif t in ("legal", "statutes"):
        parts = [titled(1, "APPLICABLE ACTS & STATUTES:"),
                 lines(of("statute"), 2, F.concat("reference", F.lit(" (Act: "), "text", F.lit(")"), tag("Statute", F.col("item_id"))))]
    elif t == "parties":
        parts = [titled(1, "INVOLVED PARTIES:"), lines(of("entity").filter("type = 'party'"), 2, F.concat(
            F.lit("Name: "), "text", F.lit(" (Role: "), na("role"), F.lit(")"), tag("Entity", F.col("item_id"))))]
    elif t == "evidence":
        parts = [titled(1, "CASE EVIDENCE LOGS:"), lines(of("evidence"), 2, F.concat(
            "text", F.lit(" (Type: "), "type", F.lit(", Strength: "), F.bround(F.col("strength") * 100).cast("int"), F.lit("%)"), tag("Evidence", F.col("item_id"))))]
    elif t == "arguments":
        parts = [titled(1, "LEGAL PLEADINGS & CONTENTIONS:"), lines(of("claim"), 2, F.concat("text", tag("Claim", F.col("item_id"))))]
    else:
        parts = [titled(1, "CASE FACTS SUMMARY:"), lines(of("fact"), 2, fact, n=facts)]
    return reduce(DataFrame.unionByName, [header, *parts])


def inputs_hash(cases: DataFrame, facts: DataFrame, events: DataFrame, entities: DataFrame, types: list[str]) -> DataFrame:
    """(case_id, summary_type, inputs_hash) over the number of facts, events and entities."""
    df = cases.select("case_id").distinct()
    for t, name in ((facts, "facts"), (events, "events"), (entities, "entities")):
        df = df.join(t.groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
    df = df.select("case_id", F.explode(F.array(*[F.lit(t) for t in types])).alias("summary_type"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("facts", "events", "entities")])
    sig = F.concat(F.lit("case:"), "case_id", F.lit("|type:"), "summary_type", F.lit("|facts:"), "facts", F.lit("|events:"), "events", F.lit("|entities:"), "entities")
    return df.select("case_id", "summary_type", F.sha2(sig, 256).alias("inputs_hash"))


def stale_summaries(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored summaries whose inputs have changed since."""
    return stored.join(current.select("case_id", "summary_type", "inputs_hash"), ["case_id", "summary_type", "inputs_hash"], "left_anti")


def version_line_diff(old: DataFrame, new: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines only one of two versions has, counted as often as they are missing in the other."""
    lines = lambda df, sign: df.select(id, F.explode(F.split(text, "\n")).alias("line"), F.lit(sign).alias("n"))
    n = lines(old, -1).unionByName(lines(new, 1)).groupBy(id, "line").agg(F.sum("n").alias("n")).filter("n <> 0")
    return n.select(id, "line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("times"))


_CHANGES = "change string, old_line int, new_line int, line string"


#: Lines of several documents travel together: a table of its own for each document costs more than its diff.
DIFF_ROWS = 10_000


def ordered_diff(old: DataFrame, new: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The way from one version to the other, line by line: (id, step, change, old_line, new_line, line).

    ``equal`` lines stand in both versions, ``removed`` ones in the old, ``added`` ones in the new; line
    numbers count from 1.  The lines that are not added, in order of ``step``, are the old version, those
    not removed the new one.  A version that is missing or null has no lines; the two sides meet by id.
    """
    both = old.select(id, F.col(text).alias("_old")).join(new.select(id, F.col(text).alias("_new")), id, "full_outer")
    id_type = old.schema[id].dataType.simpleString()

    return both.mapInPandas(lambda batches: _diff_tables(batches, id), f"{id} {id_type}, step int, {_CHANGES}")


def _diff_tables(batches: Iterator[pd.DataFrame], id: str) -> Iterator[pd.DataFrame]:
    """The diffs of the documents, in tables of about ``DIFF_ROWS`` lines."""
    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[id, "step", "change", "old_line", "new_line", "line"]).astype({"old_line": "Int32", "new_line": "Int32"})

    for pdf in batches:
        rows = []
        for key, a, b in zip(pdf[id], pdf["_old"], pdf["_new"], strict=True):
            rows += [(key, step, *row) for step, row in enumerate(diff_lines(*(t.split("\n") if isinstance(t, str) else [] for t in (a, b))))]
            if len(rows) >= DIFF_ROWS:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)


def diff_lines(old: list[str], new: list[str]) -> Iterator[tuple[str, int | None, int | None, str]]:
    """Changes in order.  Common ends are equal; between them the lines that occur once in both versions and keep their order part the rest into gaps, which are treated alike."""
    todo = [(0, len(old), 0, len(new))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and old[a] == new[b]:
            yield "equal", a + 1, b + 1, old[a]
            a, b = a + 1, b + 1
        tail = 0
        while a < a_end - tail and b < b_end - tail and old[a_end - 1 - tail] == new[b_end - 1 - tail]:
            tail += 1
        a_mid, b_mid = a_end - tail, b_end - tail
        anchors = _common_order(old, new, a, a_mid, b, b_mid)
        if tail:
            todo.append((a_mid, a_end, b_mid, b_end))
        if anchors:
            ends = [*anchors[1:], (a_mid, b_mid)]
            todo += [(x, x_end, y, y_end) for (x, y), (x_end, y_end) in zip(anchors, ends, strict=True)][::-1]
            todo.append((a, anchors[0][0], b, anchors[0][1]))
            continue
        yield from (("removed", i + 1, None, old[i]) for i in range(a, a_mid))
        yield from (("added", None, i + 1, new[i]) for i in range(b, b_mid))


def _common_order(old: list[str], new: list[str], a: int, a_end: int, b: int, b_end: int) -> list[tuple[int, int]]:
    """The longest run of lines, each found once on either side, that stand in the same order in both."""
    times = Counter(old[a:a_end]), Counter(new[b:b_end])
    place = {line: i for i, line in enumerate(new[b:b_end], b) if times[1][line] == 1 and times[0][line] == 1}
    pairs = [(i, place[line]) for i, line in enumerate(old[a:a_end], a) if line in place]
    # Longest increasing subsequence of the places in ``new``: the smallest last place of each length, and who came before.
    last, at, before = [], [], []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(last, y)
        before.append(at[n - 1] if n else None)
        last[n:n + 1], at[n:n + 1] = [y], [k]
    out, k = [], at[-1] if at else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def unified_diff(changes: DataFrame, id: str = "doc_id", context: int = 3) -> DataFrame:
    """(id, diff_text): the changed lines with ``context`` lines around them, in hunks; documents without a change have no row.

    Which lines are shown and where hunks begin are windows over the lines of one document.
    """
    w = W.partitionBy(id).orderBy("step")
    changed = F.col("change") != "equal"
    near = F.max(changed.cast("int")).over(w.rowsBetween(-context, context)) == 1
    # The line numbers reached so far, also on lines that only one version has.
    marked = changes.withColumn("_near", near).withColumn("_a", F.count("old_line").over(w)).withColumn("_b", F.count("new_line").over(w))
    shown = marked.filter("_near").withColumn("_first", F.coalesce(F.col("step") != F.lag("step").over(w) + 1, F.lit(True)))
    hunks = shown.withColumn("_hunk", F.sum(F.col("_first").cast("int")).over(w))
    sign = F.when(F.col("change") == "equal", " ").when(F.col("change") == "added", "+").otherwise("-")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("step", F.concat(sign, "line").alias("l")))), lambda x: x["l"])
    parts = hunks.groupBy(id, "_hunk").agg(lines.alias("_lines"), F.count("old_line").alias("_na"), F.count("new_line").alias("_nb"), F.max("_a").alias("_ea"), F.max("_b").alias("_eb"))

    def span(end: str, n: str) -> Column:
        """Where a hunk lies in a version: its first line and, unless it is one, the number of lines; the line before it when it has none there."""
        first = F.when(F.col(n) == 0, F.col(end)).otherwise(F.col(end) - F.col(n) + 1)
        return F.when(F.col(n) == 1, first.cast("string")).otherwise(F.concat_ws(",", first.cast("string"), F.col(n).cast("string")))

    head = F.concat(F.lit("@@ -"), span("_ea", "_na"), F.lit(" +"), span("_eb", "_nb"), F.lit(" @@"))
    body = parts.select(id, "_hunk", F.concat_ws("\n", head, F.array_join("_lines", "\n")).alias("_t"))
    return body.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_hunk", "_t"))), lambda x: x["_t"]), "\n").alias("diff_text"))


# ---- figures ---------------------------------------------------------------------------------------------------------

def chat_stats(messages: DataFrame, by: list[str]) -> DataFrame:
    """Assistant messages per key: count, latency, tokens, cost."""
    df = with_usage(messages)
    return df.groupBy(*by).agg(
        F.count("*").alias("total_chats"), rounded(F.avg("latency_ms"), 2).alias("average_latency_ms"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens_used"),
        rounded(F.coalesce(F.sum("usage.estimated_cost"), F.lit(0.0)), 5).alias("total_estimated_cost"))


def model_usage(messages: DataFrame, by: list[str]) -> DataFrame:
    df = with_usage(messages).filter("usage is not null")
    return df.groupBy(*by, F.coalesce("usage.model_used", F.lit("default")).alias("model")).agg(F.count("*").alias("messages"))


def session_titles(messages: DataFrame) -> DataFrame:
    first = first_by(messages.filter("role = 'user'"), ["session_id"], ["turn"], ["turn", "content"])
    return first.select("session_id", ellipsis("content", 40).alias("title"))


def unique_in_order(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Bookmarks or search history: an entry counts once, at its first position."""
    return first_by(entries, keys, order)
