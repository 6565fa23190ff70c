"""Queries over conversations, prompts and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..functions import rules
from ..operators import dialog as op
from ..operators import knowledge, timeline
from ..session import cut_lineage
from ..sources.tables import load_table
from . import standins as st
from .knowledge import _ARGS, _CLAIMS, _EVIDENCE, _PARTIES, _STATUTES, _W
from .metrics import _USAGE
from .reasoning import _USER, questions
from .registry import query
from .sqltext import LIKE_ANY, NL, S, SENT, q
from .timeline import _EVENTS_SQL, legal_chunks

D = st.duck
_MEMO = st.MESSAGES.replace("text AS content", "concat(CASE turn % 3 WHEN 0 THEN 'The Delhi High Court and Acme Holdings Ltd met. ' WHEN 1 THEN 'State Bank Corp. ' ELSE '' END, text) AS content")
_REC = f"""r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ({D(_MEMO)}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4)"""
_TOPICS = """us AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS k FROM r WHERE role = 'user'),
tp AS (SELECT session_id, string_agg(CASE WHEN length(content) > 30 THEN concat(left(content, 30), '...') ELSE content END, ', ' ORDER BY k) AS t FROM us WHERE k <= 3 GROUP BY 1)"""


@query("i1_conversation_memory", f"""WITH {_REC},
dn AS (SELECT session_id, turn, i, name, row_number() OVER (PARTITION BY session_id, name ORDER BY turn, i) AS f FROM (SELECT session_id, turn, unnest(from_json(CAST(citations_json AS JSON), '["JSON"]'))->>'$.document_name' AS name,
  generate_subscripts(from_json(CAST(citations_json AS JSON), '["JSON"]'), 1) AS i FROM r WHERE role = 'assistant' AND citations_json IS NOT NULL)),
dd AS (SELECT session_id, string_agg(name, '|' ORDER BY turn, i) AS docs FROM dn WHERE f = 1 GROUP BY 1),
oo AS (SELECT session_id, string_agg(o, '|' ORDER BY o) AS orgs FROM (SELECT DISTINCT session_id, unnest(regexp_extract_all(content, '{rules.ORGANISATION}', 1)) AS o FROM r) GROUP BY 1),
m AS (SELECT session_id, any_value(n) // 2 AS turn_count, count(*) AS recent FROM r GROUP BY 1)
SELECT session_id, turn_count, CAST(recent AS INTEGER) AS recent, coalesce(docs, '') AS docs, coalesce(orgs, '') AS orgs FROM m LEFT JOIN dd USING (session_id) LEFT JOIN oo USING (session_id)""")
def i1(spark, folder):
    return op.conversation_memory(st.rows(spark, folder, _MEMO), turns=2).select(
        "session_id", "turn_count", F.size("recent_turns").alias("recent"), F.array_join("referenced_documents", "|").alias("docs"),
        F.array_join("referenced_entities", "|").alias("orgs"))


@query("i2_conversation_topics", f"""WITH {_REC}, {_TOPICS} SELECT DISTINCT session_id, CASE WHEN n > 4 AND t IS NOT NULL THEN concat('Discussion centered around legal queries concerning: ', t, '.') ELSE '' END AS summary FROM r LEFT JOIN tp USING (session_id)""")
def i2(spark, folder):
    return op.conversation_memory(st.rows(spark, folder, _MEMO), turns=2, topics_shown=3, topic_chars=30).select("session_id", "summary")


_LAST = f"lq AS (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY turn) AS last FROM {_USER})"
_THING = rf"regexp_replace({S('text')}, '(?i)\b(it|this|that)\b', concat('the ', coalesce(nullif(regexp_extract(last, '{rules.FOLLOWUP_SUBJECT}', 1), ''), 'document')), 'g')"
_PERSON = rf"CASE WHEN ent <> '' AND regexp_matches(lower({S('text')}), '\b(they|them|he|she)\b') THEN regexp_replace(thing, '(?i)\b(they|them|he|she)\b', ent, 'g') ELSE thing END"
_RES = f"""{_LAST}, th AS (SELECT *, {_THING} AS thing, regexp_extract(last, '{rules.FOLLOWUP_ENTITY}', 1) AS ent FROM lq),
rs AS (SELECT session_id, turn, text, CASE WHEN coalesce(last, '') = '' THEN {S('text')} ELSE regexp_replace({_PERSON}, '{rules.FOLLOWUP_FILLER}', '') END AS resolved FROM th)"""


@query("i3_resolve_followup", f"WITH {_RES} SELECT session_id, turn, resolved FROM rs")
def i3(spark, folder):
    return op.resolve_followup(st.rows(spark, folder, st.QUESTIONS)).select("session_id", "turn", "resolved")


@query("i4_rewrite_query", f"""WITH {_RES}, w AS (SELECT *, {S("regexp_replace(resolved, '[?.]+$', '')")} AS rewritten FROM rs)
SELECT session_id, turn, rewritten, EXISTS (SELECT 1 FROM rs p WHERE p.session_id = w.session_id AND p.turn < w.turn AND lower(p.text) = lower(w.rewritten)) AS asked_before FROM w""")
def i4(spark, folder):
    return op.rewrite_query(st.rows(spark, folder, st.QUESTIONS)).select("session_id", "turn", "rewritten", "asked_before")


def _plan_sql(pick) -> str:
    whens = " ".join(f"WHEN {LIKE_ANY('lower(text)', r[1])} THEN {pick(r)}" for r in rules.PLAN_RULES)
    d = rules.PLAN_DEFAULT
    return f"CASE {whens} ELSE {pick((d[0], [], d[1], d[2], None))} END"


_QUOTED = lambda v: "NULL" if v is None else f"'{v}'"


@query("i5_plan_retrieval", f"""SELECT session_id, turn, {_plan_sql(lambda r: f"'{r[0]}'")} AS strategy, CAST({_plan_sql(lambda r: r[2])} AS INTEGER) AS top_k, CAST({_plan_sql(lambda r: r[3])} AS DOUBLE) AS threshold,
  {_plan_sql(lambda r: _QUOTED(r[4]))} AS extra FROM {_USER}""")
def i5(spark, folder):
    return questions(spark, folder).select("session_id", "turn", op.plan_retrieval("text").alias("p")).select("session_id", "turn", "p.*")


@query("i6_flag_unsafe_queries", f"""SELECT session_id, turn, NOT l AND NOT j AS safe, CASE WHEN l THEN 'prompt_leakage' WHEN j THEN 'prompt_injection' END AS code, CASE WHEN l THEN '{rules.LEAKAGE_REASON}' WHEN j THEN '{rules.INJECTION_REASON}' ELSE '{rules.SAFE_REASON}' END AS reason
FROM (SELECT *, {LIKE_ANY('lower(text)', rules.LEAKAGE_PHRASES)} AS l, {LIKE_ANY('lower(text)', rules.INJECTION_PHRASES)} AS j FROM {_USER})""")
def i6(spark, folder):
    return questions(spark, folder).select("session_id", "turn", op.flag_unsafe_queries("text").alias("v")).select("session_id", "turn", "v.*")


_ANS = """SELECT doc_id AS answer_id, concat(CASE doc_id % 5 WHEN 0 THEN 'I am sorry. ' WHEN 1 THEN concat('See [Citation: c-', doc_id * 2 - 400, '] and [Citation: c-', doc_id % 7, '] and again [Citation: c-', doc_id * 2 - 400, ']. ')
  WHEN 2 THEN 'As shown [Citation: zz-9]. ' ELSE '' END, text) AS content FROM {documents}"""
_KNOWN = "SELECT concat('c-', doc_id) AS chunk_id, doc_id, source AS case_id FROM {documents}"


@query("i7_validate_responses", f"""WITH a AS ({D(_ANS)}), k AS ({D(_KNOWN)}), c AS (SELECT *, regexp_extract_all(content, '{q(rules.CITATION_MARK)}', 1) AS cited FROM a),
u AS (SELECT answer_id, unnest(cited) AS m FROM c), z AS (SELECT DISTINCT answer_id FROM u WHERE m NOT IN (SELECT chunk_id FROM k)),
v AS (SELECT *, CASE WHEN {LIKE_ANY('content', rules.FALLBACK_PHRASES)} THEN 'fallback' WHEN answer_id IN (SELECT answer_id FROM z) THEN 'hallucinated_citations'
  WHEN len(regexp_extract_all(content, '\\S+')) > 30 AND len(cited) = 0 THEN 'missing_citations' END AS code FROM c)
SELECT answer_id, code IS NULL OR code = 'fallback' AS success, code FROM v""")
def i7(spark, folder):
    answers = st.rows(spark, folder, _ANS)
    df = answers.join(op.unknown_citations(answers, st.rows(spark, folder, _KNOWN)), "answer_id", "left")
    return df.select("answer_id", op.validate_responses("content", "unknown").alias("v")).select("answer_id", "v.*")


@query("i8_resolve_citations", f"""WITH a AS ({D(_ANS)}), k AS ({D(_KNOWN)}), m AS (SELECT answer_id, unnest(regexp_extract_all(content, '{q(rules.CITATION_MARK)}', 1)) AS c, generate_subscripts(regexp_extract_all(content, '{q(rules.CITATION_MARK)}', 1), 1) AS i FROM a),
f AS (SELECT answer_id, c, min(i) AS i FROM m GROUP BY 1, 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS INTEGER) AS position FROM f)
SELECT answer_id, position, chunk_id, doc_id, case_id FROM p JOIN k ON k.chunk_id = c""")
def i8(spark, folder):
    return op.resolve_citations(st.rows(spark, folder, _ANS), st.rows(spark, folder, _KNOWN))


@query("i8_strip_citation_marks", f"""SELECT answer_id, md5({S(f"regexp_replace(content, '{q(rules.CITATION_MARK)}', '', 'g')")}) AS digest FROM ({D(_ANS)})""")
def i8_strip(spark, folder):
    return st.rows(spark, folder, _ANS).select("answer_id", F.md5(op.strip_citation_marks("content")).alias("digest"))


_UUID = lambda m: f"concat(substr({m}, 1, 8), '-', substr({m}, 9, 4), '-', substr({m}, 13, 4), '-', substr({m}, 17, 4), '-', substr({m}, 21, 12))"
_TYPES = "CASE doc_id % 4 WHEN 0 THEN 'Fact' WHEN 1 THEN 'TimelineEvent' WHEN 2 THEN 'Entity' ELSE 'Chunk' END"
_TEXTS = "SELECT doc_id AS text_id, concat('Held [', " + _TYPES + ", ': ', " + _UUID("md5(CAST(doc_id AS STRING))") + ", '] and [CLAIM:', " + _UUID("md5(CAST(doc_id + 1 AS STRING))") + ", ']. ', text) AS content FROM {documents}"
_NODES = "SELECT lower(" + _TYPES + ") AS type, " + _UUID("md5(CAST(doc_id AS STRING))") + " AS id, concat('Title ', doc_id) AS title, source AS text FROM {documents} UNION ALL SELECT 'claim', " + _UUID("md5(CAST(doc_id AS STRING))") + ", 'Claim Statement', lang FROM {documents} WHERE n_chars > 2000"


@query("i9_parse_typed_citations", f"""WITH t AS ({D(_TEXTS)}), n AS ({D(_NODES)}), m AS (SELECT text_id, lower(unnest(regexp_extract_all(content, '{q(rules.TYPED_CITATION)}', 1))) AS type, lower(unnest(regexp_extract_all(content, '{q(rules.TYPED_CITATION)}', 2))) AS id,
  generate_subscripts(regexp_extract_all(content, '{q(rules.TYPED_CITATION)}', 1), 1) - 1 AS position FROM t)
SELECT text_id, position, m.type, m.id, coalesce(title, 'Reference Source') AS title, coalesce(n.text, '') AS text FROM m LEFT JOIN n ON n.type = m.type AND n.id = m.id""")
def i9(spark, folder):
    return op.parse_typed_citations(st.rows(spark, folder, _TEXTS), st.rows(spark, folder, _NODES))


_CALLS = "SELECT event_id, CASE event_type WHEN 'click' THEN 'OpenAI' WHEN 'view' THEN 'Google Gemini' WHEN 'error' THEN NULL ELSE 'local' END AS provider, CASE event_id % 10 WHEN 0 THEN 'GPT-4' ELSE 'base' END AS model, event_id % 4000 AS pt, event_id % 900 AS ct FROM {events}"


@query("i10_estimate_cost", f"""SELECT event_id, round(CASE WHEN contains(p, 'openai') OR contains(m, 'gpt') THEN pt / 1000.0::DOUBLE * 0.005::DOUBLE + ct / 1000.0::DOUBLE * 0.015::DOUBLE WHEN contains(p, 'gemini') THEN
  pt / 1000.0::DOUBLE * 0.000375::DOUBLE + ct / 1000.0::DOUBLE * 0.00115::DOUBLE ELSE 0 END, 12) AS cost FROM (SELECT *, lower(coalesce(provider, '')) AS p, lower(coalesce(model, '')) AS m FROM ({D(_CALLS)}))""")
def i10(spark, folder):
    return st.rows(spark, folder, _CALLS).select("event_id", rounded(op.estimate_cost(F.col("provider"), F.col("model"), F.col("pt"), F.col("ct")), 12).alias("cost"))


_TPL = "CASE WHEN turn % 2 = 0 THEN concat('Q ', chr(123), 'query', chr(125), ' C ', chr(123), 'context', chr(125)) END"


@query("i11_build_prompts", f"""SELECT session_id, turn, md5(CASE WHEN turn % 2 = 0 THEN concat('Q ', text, ' C ', ctx) ELSE concat('{rules.PROMPT_HEAD}', replace(ctx, '```', ''''''''), '{rules.PROMPT_MIDDLE}', {S('text')}, '{rules.PROMPT_TAIL}') END) AS digest
FROM (SELECT *, concat('```', turn, '``` ', text) AS ctx FROM {_USER})""")
def i11(spark, folder):
    ctx = F.concat(F.lit("```"), "turn", F.lit("``` "), "text")
    return questions(spark, folder).select("session_id", "turn", F.md5(op.build_prompts(F.col("text"), ctx, F.expr(_TPL))).alias("digest"))


_CASE_ROWS = "SELECT source AS case_id, concat('Case ', source) AS title, min(lang) AS court_name, CAST(NULL AS STRING) AS jurisdiction, '' AS judge_name FROM {documents} GROUP BY source"


def _known(spark, folder, *kinds):
    items = knowledge.extract(legal_chunks(spark, folder), list(kinds) or None)
    return items.withColumn("item_id", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 9, "0"), "kind", F.lpad(F.col("position").cast("string"), 4, "0")))


@query("i12_summary_lines", f"""WITH {_W}, u AS (SELECT doc_id, case_id, unnest({SENT('text')}) AS s, generate_subscripts({SENT('text')}, 1) AS i FROM w),
f AS (SELECT doc_id, case_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM u WHERE {LIKE_ANY('lower(s)', rules.FACT_TRIGGERS)}),
k AS (SELECT *, concat(lpad(CAST(doc_id AS VARCHAR), 9, '0'), '/fact/', lpad(CAST(p AS VARCHAR), 4, '0')) AS id FROM f),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id) <= 10), c AS ({D(_CASE_ROWS)})
SELECT case_id, 0 AS part, '' AS sort_key, concat('CASE TITLE: ', title, {NL}, 'COURT: ', court_name, {NL}, 'JURISDICTION: N/A', {NL}, 'JUDGE: N/A', {NL}) AS line FROM c
UNION ALL SELECT case_id, 1, '', 'CASE FACTS SUMMARY:' FROM c UNION ALL SELECT case_id, 2, id, concat('- ', s, ' [Fact: ', id, ']') FROM t""")
def i12(spark, folder):
    return op.summary_lines(st.rows(spark, folder, _CASE_ROWS), _known(spark, folder, "facts"), None, "general", facts=10)


# An item id has a fixed length: nine digits, the kind, four digits.
_ID = lambda kind: f"repeat('#', {15 + len(kind)})"
_OF = lambda src, line: f"SELECT case_id, {line} AS line FROM ({src})"
_CLAIM_SQL = f"{_CLAIMS} UNION ALL {_ARGS}"
_BY_TYPE = {
    "executive": ("KEY FACTS:|\nPRIMARY CLAIMS/DEFENSES:", "SELECT case_id, concat('- ', s, ' [Fact: ', id, ']') AS line FROM t UNION ALL "
                  + _OF(_CLAIM_SQL, f"concat('- ', text, ' (Type: ', type, ') [Claim: ', {_ID('claim')}, ']')")),
    "chronological": ("CHRONOLOGICAL CASE EVENTS:", "SELECT case_id, concat('- [', strftime(event_date, '%Y-%m-%d'), '] ', CASE WHEN len(ws) > 6 THEN concat(array_to_string(ws[1:6], ' '), '...') ELSE sentence END, ': ', sentence, "
                      "' [TimelineEvent: ', doc_id, '/', position, ']') AS line FROM x"),
    "legal": ("APPLICABLE ACTS & STATUTES:", _OF(_STATUTES, f"concat('- ', role, ' (Act: ', text, ') [Statute: ', {_ID('statute')}, ']')")),
    "parties": ("INVOLVED PARTIES:", _OF(_PARTIES, f"concat('- Name: ', text, ' (Role: ', coalesce(nullif(role, ''), 'N/A'), ') [Entity: ', {_ID('entity')}, ']')")),
    "evidence": ("CASE EVIDENCE LOGS:", _OF(_EVIDENCE, f"concat('- ', text, ' (Type: ', type, ', Strength: ', CAST(role::DOUBLE * 100 AS INT), '%) [Evidence: ', {_ID('evidence')}, ']')")),
    "arguments": ("LEGAL PLEADINGS & CONTENTIONS:", _OF(_CLAIM_SQL, f"concat('- ', text, ' [Claim: ', {_ID('claim')}, ']')")),
}


def _types_sql() -> str:
    head = f"SELECT case_id, concat('CASE TITLE: ', title, {NL}, 'COURT: ', court_name, {NL}, 'JURISDICTION: N/A', {NL}, 'JUDGE: N/A', {NL}) AS line FROM c"
    parts = []
    for kind, (titles, lines) in _BY_TYPE.items():
        named = " UNION ALL ".join(f"SELECT case_id, repeat('#', {len(t)}) FROM c" for t in titles.split("|"))
        parts.append(f"SELECT case_id, '{kind}' AS summary_type, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM ({head} UNION ALL {named} UNION ALL {lines}) GROUP BY case_id")
    return f"""WITH {_EVENTS_SQL}, u AS (SELECT doc_id, case_id, unnest({SENT('text')}) AS s, generate_subscripts({SENT('text')}, 1) AS i FROM w),
f AS (SELECT doc_id, case_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM u WHERE {LIKE_ANY('lower(s)', rules.FACT_TRIGGERS)}),
k AS (SELECT *, concat(lpad(CAST(doc_id AS VARCHAR), 9, '0'), '/fact/', lpad(CAST(p AS VARCHAR), 4, '0')) AS id FROM f),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id) <= 5), c AS ({D(_CASE_ROWS)})
""" + " UNION ALL ".join(parts)


@query("i12_summary_lines_by_type", _types_sql())
def i12_types(spark, folder):
    """Number and size of the lines of every summary type."""
    cases, items = st.rows(spark, folder, _CASE_ROWS), cut_lineage(_known(spark, folder))  # six readers
    events = timeline.extract_events(legal_chunks(spark, folder)).withColumn("event_id", F.concat_ws("/", "doc_id", "position"))
    out = None
    for t in ("executive", "chronological", "legal", "parties", "evidence", "arguments"):
        part = op.summary_lines(cases, items, events, t, facts=5).groupBy("case_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")).withColumn("summary_type", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


_HCASES = "SELECT DISTINCT o_custkey AS case_id FROM {orders}"
_N = lambda cond: f"(SELECT o_custkey AS case_id, count(*) AS n FROM orders WHERE {cond} GROUP BY 1)"
_HASH = f"""h AS (SELECT c.case_id, t AS summary_type, sha256(concat('case:', c.case_id, '|type:', t, '|facts:', coalesce(f.n, 0), '|events:', coalesce(e.n, 0), '|entities:', coalesce(x.n, 0))) AS inputs_hash FROM ({D(_HCASES)}) c
  CROSS JOIN (SELECT unnest(['executive', 'legal']) AS t) LEFT JOIN {_N("o_orderstatus = 'F'")} f USING (case_id) LEFT JOIN {_N("true")} e USING (case_id) LEFT JOIN {_N("o_orderpriority = '1-URGENT'")} x USING (case_id))"""


def _hashes(spark, folder, late=False):
    o = load_table(spark, folder, "orders").withColumn("case_id", F.col("o_custkey"))
    facts = o.filter("o_orderstatus = 'F'") if not late else o.filter("o_orderstatus = 'F' and year(o_orderdate) < 2001")
    return op.inputs_hash(o.select("case_id"), facts, o, o.filter("o_orderpriority = '1-URGENT'"), ["executive", "legal"])


@query("i13_inputs_hash", f"WITH {_HASH} SELECT * FROM h")
def i13(spark, folder):
    return _hashes(spark, folder)


@query("i13_stale_summaries", f"""WITH {_HASH} SELECT case_id, summary_type FROM h WHERE case_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 2001)""")
def i13_stale(spark, folder):
    """Summaries stored before 2001 against the facts known now."""
    return op.stale_summaries(_hashes(spark, folder, late=True), _hashes(spark, folder)).select("case_id", "summary_type")


_NEW = "concat(replace(text, '. ', concat('.', chr(10))), chr(10), 'Added line', chr(10), 'Added line')"


@query("i14_version_line_diff", f"""WITH o AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line, -1 AS n FROM documents), e AS (SELECT doc_id, unnest(string_split({_NEW}, {NL})) AS line, 1 AS n FROM documents),
s AS (SELECT doc_id, line, sum(n) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM e) GROUP BY 1, 2 HAVING sum(n) <> 0)
SELECT doc_id, md5(line) AS digest, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(n) AS BIGINT) AS times FROM s""")
def i14(spark, folder):
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    return op.version_line_diff(docs, docs.withColumn("text", F.expr(_NEW))).select("doc_id", F.md5("line").alias("digest"), "change", "times")


_CHANGED = "replace(replace(text, '. ', concat('.', chr(10))), concat(chr(10), 'b'), concat(chr(10), 'Changed b'))"


@query("i14_ordered_diff", f"""SELECT doc_id, md5(text) AS old_digest, md5({_CHANGED}) AS new_digest, len(string_split({_CHANGED}, {NL})) - len(string_split(text, {NL})) AS grown FROM documents""")
def i14_ordered(spark, folder):
    """The versions read back from the diff: lines that are not added are the old one, lines not removed the new one."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    diff = op.ordered_diff(docs, docs.withColumn("text", F.expr(_CHANGED)))
    side = lambda other: F.array_join(F.transform(F.filter("l", lambda x: x["change"] != other), lambda x: x["line"]), "\n")
    sign = F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)
    lines = diff.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", "change", "line"))).alias("l"), F.sum(sign).alias("grown"))
    return lines.select("doc_id", F.md5(side("added")).alias("old_digest"), F.md5(side("removed")).alias("new_digest"), "grown")


_STATS = "count(*) AS total_chats, round(avg(latency_ms), 2) AS average_latency_ms, CAST(sum(token_count) AS BIGINT) AS total_tokens_used, round(coalesce(sum(cost), 0), 5) AS total_estimated_cost"


@query("i15_chat_stats", f"SELECT user_id, {_STATS} FROM ({_USAGE}) GROUP BY user_id")
def i15(spark, folder):
    return op.chat_stats(st.rows(spark, folder, st.MESSAGES), ["user_id"])


@query("i15_conversation_stats", f"SELECT session_id, {_STATS} FROM ({_USAGE}) GROUP BY session_id")
def i15_session(spark, folder):
    return op.chat_stats(st.rows(spark, folder, st.MESSAGES), ["session_id"])


@query("i15_model_usage", f"SELECT user_id, model, count(*) AS messages FROM ({_USAGE}) WHERE ok GROUP BY ALL")
def i15_models(spark, folder):
    return op.model_usage(st.rows(spark, folder, st.MESSAGES), ["user_id"])


@query("i16_session_titles", """SELECT conv_id AS session_id, CASE WHEN length(t) > 40 THEN concat(left(t, 40), '...') ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1)""")
def i16(spark, folder):
    return op.session_titles(st.rows(spark, folder, st.MESSAGES))


_MARKS = "SELECT user_id AS session_id, event_type AS item, ts, event_id, value FROM {events}"


@query("i17_research_bookmarks", "SELECT user_id AS session_id, event_type AS item, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def i17(spark, folder):
    return op.unique_in_order(st.rows(spark, folder, _MARKS), ["session_id", "item"], ["ts", "event_id"]).select("session_id", "item", "event_id")


@query("i17_search_history", f"SELECT session_id, text AS query, min(turn) AS turn FROM {_USER} GROUP BY 1, 2")
def i17_history(spark, folder):
    df = questions(spark, folder).withColumnRenamed("text", "query")
    return op.unique_in_order(df, ["session_id", "query"], ["turn"]).select("session_id", "query", "turn")
