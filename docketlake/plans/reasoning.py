"""Queries over reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import knowledge
from ..operators import reasoning as op
from ..operators import timeline
from ..session import cut_lineage
from ..sources.tables import load_table
from . import standins as st
from .knowledge import _W, _map_case
from .metrics import _bundle
from .registry import query
from .sqltext import CASE_REGEX, S
from .timeline import _CE, _EVENTS_SQL, CASE_EVENTS, legal_chunks

D = st.duck
_USER = f"(SELECT session_id, turn, text FROM ({D(st.QUESTIONS)}) WHERE role = 'user')"
_INTENT = CASE_REGEX(f"lower({S('text')})", rules.INTENT_RULES, rules.INTENT_DEFAULT)


def questions(spark, folder):
    return st.rows(spark, folder, st.QUESTIONS).filter("role = 'user'")


@query("h1_classify_intent", f"SELECT session_id, turn, i AS intent, CASE WHEN i = '{rules.INTENT_DEFAULT}' THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT *, {_INTENT} AS i FROM {_USER})")
def h1(spark, folder):
    return questions(spark, folder).select("session_id", "turn", op.classify_intent("text").alias("c")).select("session_id", "turn", "c.*")


def _steps_sql() -> str:
    whens = " ".join(f"WHEN i IN ({', '.join(repr(x) for x in names)}) THEN '{' > '.join(steps)}'" for names, steps in rules.REASONING_STEPS)
    return f"CASE {whens} ELSE '{' > '.join(rules.REASONING_STEPS_DEFAULT)}' END"


_STRAT = _map_case("i", rules.INTENT_STRATEGY, "'Simple lookup'")


@query("h2_reasoning_plan", f"""SELECT session_id, turn, s AS strategy, {_steps_sql()} AS steps, CAST(CASE WHEN s IN ('Multi-hop reasoning', 'Cross-document reasoning') THEN 2 ELSE 1 END AS INTEGER) AS hops
FROM (SELECT *, {_STRAT} AS s FROM (SELECT *, {_INTENT} AS i FROM {_USER}))""")
def h2(spark, folder):
    df = questions(spark, folder).withColumn("i", op.classify_intent("text")["intent"]).withColumn("strategy", op.intent_strategy("i"))
    return df.select("session_id", "turn", "strategy", F.array_join(op.reasoning_plan("i"), " > ").alias("steps"), op.hop_count("strategy").alias("hops"))


_CAND = rules.CANDIDATE_NAME
# Hits are the sentences in front of each text; the rest of a text brings its own phrases later.
_CAND_SQL = f"""cn AS (SELECT doc_id AS query_id, case_id, unnest(regexp_extract_all(text, '{_CAND}', 1)) AS raw, generate_subscripts(regexp_extract_all(text, '{_CAND}', 1), 1) AS pos FROM w),
cd AS (SELECT query_id, case_id, {S('raw')} AS c, min(pos) AS pos FROM cn WHERE length({S('raw')}) > 3 GROUP BY 1, 2, 3),
ca AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 10)"""
_HITS_SQL = f"{_W}, {_CAND_SQL}"


def _hits(spark, folder):
    return legal_chunks(spark, folder).select(F.col("doc_id").alias("query_id"), "case_id", F.lit(1).alias("rank"), "text")


@query("h3_candidate_names", f"WITH {_HITS_SQL} SELECT query_id, c AS candidate FROM ca")
def h3_names(spark, folder):
    return op.candidate_names(_hits(spark, folder), 10).select("query_id", "candidate")


def _hop_items(spark, folder):
    items = knowledge.extract(legal_chunks(spark, folder), ["parties", "judges", "courts", "witnesses", "evidence"]).withColumn("sort_key", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    items = cut_lineage(items.select("case_id", "item_id", "kind", "sort_key", "text"))
    pick = lambda k: items.filter(F.col("kind") == k).select("case_id", "item_id", "sort_key", "text")
    return pick("entity"), pick("evidence")


def _hop_events(spark, folder):
    ev = timeline.extract_events(legal_chunks(spark, folder))
    return ev.select("case_id", F.concat_ws("/", "doc_id", "position").alias("item_id"), F.concat(
        F.date_format("event_date", "yyyy-MM-dd"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("sort_key"), F.col("description").alias("text"))


@query("h3_multi_hop")
def h3(spark, folder):
    """All kinds of the second hop; entities of a document are linked to its evidence."""
    entities, evidence = _hop_items(spark, folder)
    edges = entities.select("sort_key", F.col("item_id").alias("src")).join(evidence.select("sort_key", F.col("item_id").alias("dst")), "sort_key").select(
        "src", "dst", F.concat_ws("-", "src", "dst").alias("edge_id"))
    notes = load_table(spark, folder, "documents").select(F.col("source").alias("case_id"), F.concat(F.lit("summary/"), "lang").alias("item_id"), F.col("lang").alias("sort_key")).distinct()
    return op.multi_hop(_hits(spark, folder), entities, _hop_events(spark, folder), evidence, edges, notes, names=10, limit=10, without=5, summaries_per_case=3)


@query("h3_expand_events", f"""WITH {_EVENTS_SQL}, {_CAND_SQL},
m AS (SELECT DISTINCT ca.query_id, x.event_date, x.doc_id, x.position FROM ca JOIN x ON x.case_id = ca.case_id AND contains(lower(x.sentence), lower(ca.c))),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_date, doc_id, position) AS r FROM m)
SELECT query_id, CAST(r AS INTEGER) AS rank, concat(doc_id, '/', position) AS item_id FROM n WHERE r <= 10""")
def h3_expand(spark, folder):
    """Events that mention a candidate; the first ten per query by date."""
    hits = _hits(spark, folder)
    return op.expand_hop(hits.select("query_id", "case_id").distinct(), op.candidate_names(hits, 10), _hop_events(spark, folder), 10, 5).select("query_id", "rank", "item_id")


_DOC_EDGES = "SELECT concat('doc/', doc_id) AS src, concat('doc/', doc_id + 1) AS dst, doc_id AS edge_id FROM {documents}"
_NOTES = "SELECT DISTINCT source AS case_id, concat('summary/', lang) AS item_id, lang AS sort_key FROM {documents}"


@query("h3_multi_hop_of_texts", f"""WITH {_EVENTS_SQL}, {_CAND_SQL},
it AS (SELECT case_id, CASE WHEN doc_id % 2 = 0 THEN 'entity' ELSE 'evidence' END AS kind, concat('doc/', doc_id) AS item_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS sort_key, lower(text) AS text FROM w
  UNION ALL SELECT case_id, 'event', concat(doc_id, '/', position), concat(strftime(event_date, '%Y-%m-%d'), '/', lpad(CAST(doc_id AS VARCHAR), 9, '0')), lower(sentence) FROM x),
m AS (SELECT DISTINCT ca.query_id, kind, item_id, sort_key FROM ca JOIN it ON it.case_id = ca.case_id AND contains(it.text, lower(ca.c))),
fi AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY case_id, kind ORDER BY sort_key, item_id) <= 5),
b AS (SELECT w.doc_id AS query_id, kind, item_id, sort_key FROM w JOIN fi USING (case_id) WHERE w.doc_id NOT IN (SELECT query_id FROM ca)),
hop AS (SELECT query_id, kind, item_id FROM (SELECT * FROM m UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY sort_key, item_id) <= 10),
e AS ({D(_DOC_EDGES)}), l AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e),
nt AS (SELECT * FROM ({D(_NOTES)}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sort_key, item_id) <= 3)
SELECT query_id, kind, item_id FROM hop UNION ALL SELECT DISTINCT query_id, 'neighbor', other FROM hop JOIN l ON l.node = hop.item_id WHERE kind = 'entity'
UNION ALL SELECT w.doc_id, 'summary', item_id FROM w JOIN nt USING (case_id)""")
def h3_texts(spark, folder):
    """All kinds of the second hop over whole texts: those of even number stand in for entities, the others for evidence."""
    hits = cut_lineage(_hits(spark, folder))
    items = hits.select("case_id", F.concat(F.lit("doc/"), "query_id").alias("item_id"), F.lpad(F.col("query_id").cast("string"), 9, "0").alias("sort_key"), "text", (F.col("query_id") % 2).alias("odd"))
    pick = lambda odd: items.filter(F.col("odd") == odd).drop("odd")
    return op.multi_hop(hits, pick(0), _hop_events(spark, folder), pick(1), st.rows(spark, folder, _DOC_EDGES), st.rows(spark, folder, _NOTES), names=10, limit=10, without=5, summaries_per_case=3)


_DEG = "SELECT p_type AS case_id, p_name AS label, count(*) AS degree FROM {part} JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_type, p_name"
_EVCH = """SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS query_id, p_type AS case_id, CAST(l_linenumber - 1 AS INT) AS position, concat('about the ', upper(p_name), ' in ', l_returnflag) AS text,
  l_quantity / 100 + 0.25 AS score, l_suppkey FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"""


@query("h4_rank_chunk_evidence", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, label) AS r FROM ({D(_DEG)}) QUALIFY r <= 20), c AS ({D(_EVCH)}),
h AS (SELECT c.row_id, c.l_suppkey, arg_min(d.degree, d.r) AS degree FROM c JOIN d ON d.case_id = c.case_id AND contains(lower(c.text), lower(d.label)) GROUP BY c.row_id, c.l_suppkey)
SELECT query_id, round(least(1, score + coalesce(least(0.15::DOUBLE, degree * 0.02::DOUBLE), 0) + greatest(0, 0.1::DOUBLE - position * 0.02::DOUBLE)), 3) AS score, count(*) AS n
FROM c LEFT JOIN h ON h.row_id = c.row_id AND h.l_suppkey = c.l_suppkey GROUP BY 1, 2""")
def h4(spark, folder):
    central = op.central_labels(st.rows(spark, folder, _DEG), 20)
    chunks = st.rows(spark, folder, _EVCH).withColumn("item_id", F.concat_ws("/", "row_id", "l_suppkey")).withColumn("score", F.col("score").cast("double"))
    return op.rank_chunk_evidence(chunks, central).groupBy("query_id", "score").agg(F.count("*").alias("n"))


_QEV = "SELECT user_id AS query_id, event_id AS item_id, concat('The ', event_type, ' of ', CAST(event_id AS STRING)) AS description, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence FROM {events}"
_QQ = "SELECT DISTINCT user_id AS query_id, CASE user_id % 3 WHEN 0 THEN 'Which CLICK' WHEN 1 THEN 'purchase   history' ELSE 'none zz' END AS query FROM {events}"


@query("h4_rank_event_evidence", f"""WITH e AS ({D(_QEV)}), qq AS ({D(_QQ)}) SELECT e.query_id, e.item_id, 'event' AS type, round(least(1, confidence * 0.7::DOUBLE + CASE WHEN len(list_filter(regexp_split_to_array(lower(query), '\\s+'),
  lambda z: z <> '' AND contains(lower(description), z))) > 0 THEN 0.15::DOUBLE ELSE 0 END), 4) AS score FROM e JOIN qq USING (query_id)""".replace("), 4) AS score", "), 3) AS score"))
def h4_events(spark, folder):
    return op.rank_event_evidence(st.rows(spark, folder, _QEV), st.rows(spark, folder, _QQ)).select("query_id", "item_id", "type", "score")


_CITES = "SELECT conv_id AS query_id, turn AS id, text, CAST((conv_id * 7 + turn * 13) % 100 AS DOUBLE) / 100 AS score FROM {conversations} UNION ALL SELECT conv_id, turn + 100, concat('  ', lower(text)), 0.5 FROM {conversations}"


@query("h5_rank_citations", f"""WITH c AS ({D(_CITES)}) SELECT query_id, id, CASE WHEN score >= 0.8 THEN 'Primary' WHEN score >= 0.6 THEN 'Supporting' ELSE 'Contextual' END AS strength, round(score, 3) AS relevance_score FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, lower(left({S('text')}, 50)) ORDER BY score DESC, id) = 1""")
def h5(spark, folder):
    return op.rank_citations(st.rows(spark, folder, _CITES), 50).select("query_id", "id", "strength", "relevance_score")


_DATES_SQL = """k AS (SELECT *, left(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 20) AS key FROM ce WHERE event_date IS NOT NULL),
f AS (SELECT *, first_value(event_id) OVER v AS first_id, first_value(event_date) OVER v AS first_date FROM k WHERE length(key) >= 5 WINDOW v AS (PARTITION BY case_id, key ORDER BY event_id)),
dc AS (SELECT case_id, first_id, event_id AS second_id, abs(date_diff('day', first_date, event_date)) AS days FROM f WHERE event_id <> first_id AND abs(date_diff('day', first_date, event_date)) > 1)"""


@query("h6_contradicting_dates", f"WITH {_CE}, {_DATES_SQL} SELECT case_id, first_id, second_id, days, CASE WHEN days > 30 THEN 'high' ELSE 'medium' END AS severity FROM dc")
def h6(spark, folder):
    events = st.rows(spark, folder, CASE_EVENTS).filter("event_date is not null")
    return op.contradicting_dates(events, title_chars=20).select("case_id", "first_id", "second_id", "days", "severity")


_FACTS = """SELECT doc_id AS fact_id, source AS case_id, concat(CASE doc_id % 7 WHEN 0 THEN 'The tenant breached the lease. ' WHEN 1 THEN 'They comply and did not breach it. ' WHEN 2 THEN 'He denies it. ' WHEN 3 THEN 'She admits it. '
  WHEN 4 THEN 'They comply. ' WHEN 5 THEN 'He denies and admits a breach. ' ELSE '' END, text) AS text FROM {documents}"""
_PAIRS_SQL = f"""fa AS ({D(_FACTS)}), fp AS (SELECT a.case_id, a.fact_id AS first_id, b.fact_id AS second_id FROM fa a JOIN fa b ON a.case_id = b.case_id AND a.fact_id < b.fact_id WHERE
  (contains(lower(a.text), 'breach') AND contains(lower(b.text), 'comply')) OR (contains(lower(a.text), 'breached') AND contains(lower(b.text), 'not breach')) OR (contains(lower(a.text), 'denies') AND contains(lower(b.text), 'admits')))"""


@query("h7_contradicting_facts", f"WITH {_PAIRS_SQL} SELECT case_id, first_id AS fact_id, count(*) AS opposed FROM fp GROUP BY 1, 2")
def h7(spark, folder):
    return op.contradicting_facts(st.rows(spark, folder, _FACTS))


@query("h7_opposing_pairs", f"WITH {_PAIRS_SQL} SELECT case_id, first_id, second_id FROM fp WHERE first_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def h7_pairs(spark, folder):
    """Written out for the facts with a toxic label."""
    return op.opposing_pairs(st.rows(spark, folder, _FACTS), load_table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("fact_id"))).select(
        "case_id", "first_id", "second_id")


_FACTS_BY_NUMBER = _FACTS.replace("source AS case_id", "doc_id % 40 AS case_id")


@query("h8_contradiction_report", f"""WITH {_CE}, {_DATES_SQL}, {_PAIRS_SQL.replace(D(_FACTS), D(_FACTS_BY_NUMBER))},
d AS (SELECT case_id, count(*) AS n, max(CASE WHEN days > 30 THEN 1 ELSE 0 END) AS hi FROM dc GROUP BY 1), g AS (SELECT case_id, count(*) AS n FROM fp GROUP BY 1)
SELECT c.case_id, coalesce(d.n, 0) + coalesce(g.n, 0) AS conflicts, CASE WHEN coalesce(hi, 0) = 1 THEN 'high' WHEN coalesce(d.n, 0) + coalesce(g.n, 0) > 0 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN coalesce(d.n, 0) + coalesce(g.n, 0) > 0 THEN 0.88 ELSE 1 END::DOUBLE AS confidence FROM (SELECT DISTINCT case_id FROM ce UNION SELECT DISTINCT case_id FROM fa) c LEFT JOIN d USING (case_id) LEFT JOIN g USING (case_id)""")
def h8(spark, folder):
    events, facts = st.rows(spark, folder, CASE_EVENTS), st.rows(spark, folder, _FACTS_BY_NUMBER)
    cases = events.select("case_id").union(facts.select("case_id"))
    return op.contradiction_report(cases, op.contradicting_dates(events.filter("event_date is not null"), title_chars=20), op.contradicting_facts(facts))


@query("h9_calibrate_confidence", """WITH b AS (SELECT user_id AS query_id, avg(CAST(event_id % 100 AS DOUBLE) / 100) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS x,
  count(*) FILTER (event_type = 'signup') AS n, count(*) FILTER (event_type = 'purchase') AS e FROM events GROUP BY 1),
p AS (SELECT query_id, coalesce(s, 0.5) AS rq, least(1, c * 0.25::DOUBLE) AS cs, greatest(0, 1 - x * 0.2::DOUBLE) AS ag, least(1, 0.4::DOUBLE + n * 0.1::DOUBLE) AS g, least(1, 0.5::DOUBLE + e * 0.1::DOUBLE) AS t FROM b)
SELECT query_id, round(least(greatest(rq * 0.3::DOUBLE + cs * 0.25::DOUBLE + ag * 0.25::DOUBLE + (g + t) / 2 * 0.2::DOUBLE, 0), 1), 3) AS overall_confidence, round(rq, 3) AS retrieval_quality, round(cs, 3) AS citation_support, round(ag, 3) AS evidence_agreement,
  round(g, 3) AS graph_connectivity, round(t, 3) AS timeline_completeness FROM p""")
def h9(spark, folder):
    e = load_table(spark, folder, "events").withColumnRenamed("user_id", "query_id").withColumn("score", F.col("event_id") % 100 / 100.0)
    kind = lambda k: e.filter(F.col("event_type") == k)
    return op.calibrate_confidence(e.select("query_id").distinct(), e.filter("event_type = 'view'"), kind("click"), kind("error"), kind("signup"), kind("purchase"))


_ANSWERS = """SELECT doc_id AS answer_id, concat('Under Section ', 300 + doc_id % 4, ' and section 12A the deed of ', 1990 + doc_id % 40, ' is void. ', CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END) AS answer,
  concat('See Sec. ', 300 + doc_id % 3, ' and Section 12', CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE '' END, ' of ', 1990 + doc_id % 25, '. ', text) AS context, CAST(doc_id % 4 AS INT) AS citations FROM {documents}"""
_AW = f"""a AS (SELECT answer_id, answer, lower(answer) AS l, lower(context) AS c, citations FROM ({D(_ANSWERS)})),
wa AS (SELECT answer_id, 'hallucination' AS type, upper(s) AS what, 'medium' AS severity FROM (SELECT answer_id, c, unnest(regexp_extract_all(l, '\\bsection\\s+(\\d+[a-zA-Z]?)\\b', 1)) AS s FROM a) WHERE NOT contains(c, 'section ' || s) AND NOT contains(c, 'sec. ' || s)
UNION ALL SELECT answer_id, 'citation_coverage', '', 'medium' FROM a WHERE citations = 0 AND length(answer) > 100
UNION ALL SELECT answer_id, 'factual_grounding', y, 'low' FROM (SELECT answer_id, c, unnest(regexp_extract_all(l, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1)) AS y FROM a) WHERE NOT contains(c, y))"""


@query("h10_grounding_warnings", f"""WITH {_AW} SELECT answer_id, type, severity, CASE type WHEN 'hallucination' THEN concat('Answer references ''Section ', what, ''' which is not explicitly mentioned in the retrieved document chunks.')
  WHEN 'citation_coverage' THEN 'The response contains specific factual statements but lacks citation mappings to original document source files.'
  ELSE concat('The date/year ''', what, ''' was found in the answer but does not appear in retrieved document timelines.') END AS warning FROM wa""")
def h10(spark, folder):
    return op.grounding_warnings(st.rows(spark, folder, _ANSWERS))


@query("h11_validate_answers", f"""WITH {_AW}, n AS (SELECT answer_id, count(*) AS n FROM wa GROUP BY 1), s AS (SELECT a.answer_id, citations, coalesce(n, 0) AS n, greatest(0, 1 - coalesce(n, 0) * 0.15::DOUBLE) AS g FROM a LEFT JOIN n USING (answer_id))
SELECT answer_id, g >= 0.6 AS success, round(g, 3) AS grounding_score, citations > 0 AS citation_coverage, CAST(n AS INTEGER) AS warnings, CASE WHEN n < 3 THEN 'verified' ELSE 'needs_review' END AS logical_consistency FROM s""")
def h11(spark, folder):
    return op.validate_answers(st.rows(spark, folder, _ANSWERS), threshold=0.6)


_NEXT = "SELECT doc_id AS a_id, doc_id + 1 AS b_id FROM {documents}"
_ITEMS = f"SELECT doc_id AS id, title, mime_type, lang AS category, file_size FROM ({st.FILES}) f"


@query("h12_compare_documents", f"""WITH p AS ({D(_NEXT)}), i AS ({D(_ITEMS)}), j AS (SELECT a_id, b_id, a.title AS ta, b.title AS tb, a.mime_type AS am, b.mime_type AS bm, a.category AS ac, b.category AS bc, a.file_size AS asz, b.file_size AS bs FROM p JOIN i a ON a.id = a_id JOIN i b ON b.id = b_id)
SELECT a_id, b_id, 0.72::DOUBLE AS overall_score, 'Document Title' AS parameter, ta AS item_a_value, tb AS item_b_value, 0.4::DOUBLE AS similarity_score, 'Different filing documents.' AS evaluation FROM j
UNION ALL SELECT a_id, b_id, 0.72, 'Mime Type', coalesce(am, 'Unknown'), coalesce(bm, 'Unknown'), CASE WHEN am IS NOT DISTINCT FROM bm THEN 1 ELSE 0 END, CASE WHEN am IS NOT DISTINCT FROM bm THEN 'Same document formats.' ELSE 'Different file extensions.' END FROM j
UNION ALL SELECT a_id, b_id, 0.72, 'Category', ac, bc, CASE WHEN ac = bc THEN 1 ELSE 0.2 END, CASE WHEN ac = bc THEN 'Similar category types.' ELSE 'Different functional classes.' END FROM j
UNION ALL SELECT a_id, b_id, 0.72, 'Size (Bytes)', CAST(asz AS VARCHAR), CAST(bs AS VARCHAR), round(least(asz, bs) / greatest(asz, bs, 1)::DOUBLE, 2), 'Size ratio comparison.' FROM j""")
def h12(spark, folder):
    """Each document with the next one."""
    return op.compare_pairs(st.rows(spark, folder, _NEXT), st.rows(spark, folder, _ITEMS), "document")


_ENT = "SELECT p_partkey AS id, p_name AS name, split(p_name, ' ')[0] AS normalized_name, p_type AS entity_type, CASE WHEN p_size > 25 THEN p_brand END AS role FROM {part}"
_ENTP = "SELECT p_partkey AS a_id, p_partkey + 1 AS b_id FROM {part}"
_ENTD = D(_ENT).replace("split(p_name, ' ')[0]", "string_split(p_name, ' ')[1]")


@query("h12_compare_entities", f"""WITH p AS ({D(_ENTP)}), i AS ({_ENTD}), j AS (SELECT a_id, b_id, a.name AS an, b.name AS bn, a.normalized_name = b.normalized_name AS same, a.entity_type AS ta, b.entity_type AS tb, a.role AS ar, b.role AS br FROM p JOIN i a ON a.id = a_id JOIN i b ON b.id = b_id)
SELECT a_id, b_id, CASE WHEN same THEN 0.85 ELSE 0.4 END::DOUBLE AS overall_score, 'Name' AS parameter, an AS item_a_value, bn AS item_b_value, CASE WHEN same THEN 1 ELSE 0.3 END::DOUBLE AS similarity_score, CASE WHEN same THEN 'Identical names after normalization.' ELSE 'Different names.' END AS evaluation FROM j
UNION ALL SELECT a_id, b_id, CASE WHEN same THEN 0.85 ELSE 0.4 END, 'Type', ta, tb, CASE WHEN ta = tb THEN 1 ELSE 0 END, 'Same role entity classification.' FROM j
UNION ALL SELECT a_id, b_id, CASE WHEN same THEN 0.85 ELSE 0.4 END, 'Role', coalesce(ar, 'N/A'), coalesce(br, 'N/A'), CASE WHEN ar IS NOT DISTINCT FROM br THEN 0.9 ELSE 0.1 END, 'Similar operational functions in case filings.' FROM j""")
def h12_entities(spark, folder):
    return op.compare_pairs(st.rows(spark, folder, _ENTP), st.rows(spark, folder, _ENT), "entity")


_CASEP = "SELECT o_orderkey AS a_id, o_orderkey + 1 AS b_id FROM {orders}"


@query("h12_compare_cases", f"""WITH p AS ({D(_CASEP)}), i AS ({D(st.CASES)}), j AS (SELECT a_id, b_id, a.court_name AS ac, b.court_name AS bc, a.judge_name AS aj, b.judge_name AS bj, a.client_name AS al, b.client_name AS bl FROM p JOIN i a ON a.case_id = a_id JOIN i b ON b.case_id = b_id)
SELECT 'Title' AS parameter, 0.3::DOUBLE AS similarity_score, count(*) AS pairs FROM j GROUP BY 1, 2 UNION ALL SELECT 'Court Name', CASE WHEN ac IS NOT DISTINCT FROM bc THEN 0.9 ELSE 0.2 END, count(*) FROM j GROUP BY 1, 2
UNION ALL SELECT 'Judge Name', CASE WHEN aj IS NOT DISTINCT FROM bj THEN 1 ELSE 0 END, count(*) FROM j GROUP BY 1, 2 UNION ALL SELECT 'Client Name', CASE WHEN al IS NOT DISTINCT FROM bl THEN 0.8 ELSE 0.1 END, count(*) FROM j GROUP BY 1, 2""")
def h12_cases(spark, folder):
    return op.compare_pairs(st.rows(spark, folder, _CASEP), st.rows(spark, folder, st.CASES), "case", id="case_id").groupBy("parameter", "similarity_score").agg(F.count("*").alias("pairs"))


_STAT = "SELECT p_partkey AS id, p_type AS act_name, p_brand AS section_reference, concat(p_type, ', Section ', p_brand) AS normalized_reference FROM {part}"


@query("h12_compare_statutes", f"""WITH p AS ({D(_ENTP)}), i AS ({D(_STAT)}), j AS (SELECT a.normalized_reference = b.normalized_reference AS r, lower(a.act_name) = lower(b.act_name) AS c, a.section_reference = b.section_reference AS s FROM p JOIN i a ON a.id = a_id JOIN i b ON b.id = b_id)
SELECT 'Act Name' AS parameter, CASE WHEN r THEN 0.95 ELSE 0.3 END::DOUBLE AS overall_score, CASE WHEN c THEN 1 ELSE 0.2 END::DOUBLE AS similarity_score, count(*) AS pairs FROM j GROUP BY ALL
UNION ALL SELECT 'Section Reference', CASE WHEN r THEN 0.95 ELSE 0.3 END, CASE WHEN s THEN 1 ELSE 0 END, count(*) FROM j GROUP BY ALL""")
def h12_statutes(spark, folder):
    return op.compare_pairs(st.rows(spark, folder, _ENTP), st.rows(spark, folder, _STAT), "statute").groupBy("parameter", "overall_score", "similarity_score").agg(F.count("*").alias("pairs"))


_HISTORY = """SELECT event_id, CASE event_type WHEN 'click' THEN 'Fact Lookup' WHEN 'view' THEN 'Timeline Question' ELSE 'Legal Research' END AS intent, CASE event_type WHEN 'click' THEN 'Simple lookup' ELSE 'Graph reasoning' END AS strategy,
  CAST(event_id % 101 AS DOUBLE) / 101 AS confidence, value AS latency_ms, concat(chr(123), '"success": ', CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END, ', "warnings": [', CASE WHEN event_id % 5 = 0 THEN concat(chr(123), '"type": "hallucination"', chr(125)) ELSE '' END, ']', chr(125)) AS validation_json FROM {events}"""


@query("h13_qa_analytics", f"WITH h AS ({D(_HISTORY)})\n" + _bundle("h", "reasoning", {
    "total_queries": ("count(*)", "queries"), "average_latency_ms": ("round(avg(latency_ms), 4)", "ms"), "average_confidence": ("round(avg(confidence), 4)", "score"),
    "validation_failures": ("count(*) FILTER (event_id % 4 = 0)", "queries"), "hallucination_rate": ("round(count(*) FILTER (event_id % 5 = 0) / count(*)::DOUBLE, 4)", "share")},
    {"intent_distribution": "intent", "strategy_distribution": "strategy",
     "confidence_distribution": "CASE WHEN confidence < 0.4 THEN '0.0-0.4' WHEN confidence < 0.6 THEN '0.4-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"}))
def h13(spark, folder):
    return op.qa_analytics(st.rows(spark, folder, _HISTORY))
