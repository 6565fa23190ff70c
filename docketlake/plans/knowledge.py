"""Queries over extraction, entity resolution and the graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..functions import rules
from ..operators import entities as ent
from ..operators import graph as gr
from ..operators import knowledge as op
from ..operators import metrics
from ..operators.scale import spread
from ..session import cut_lineage
from ..sources.tables import load_table
from . import standins as st
from .registry import query
from .sqltext import LIKE_ANY, S, SENT, q
from .timeline import legal_chunks

D = st.duck
_W = f"w AS (SELECT doc_id, source AS case_id, {st.LEGAL_TEXT} AS text FROM documents)"


def _all(pattern: str, g: int = 1, text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{q(pattern)}', {g})"


def _un(cols: dict[str, str]) -> str:
    return f"(SELECT doc_id, case_id, {', '.join(f'unnest({e}) AS {n}' for n, e in cols.items())} FROM w)"


_ROLES = "('plaintiff', 'defendant', 'accused', 'petitioner', 'respondent', 'complainant', 'appellant')"
_PARTIES = f"""SELECT doc_id, case_id, 'entity' AS kind, 'party' AS type, {S('n')} AS text, lower(r) AS role, 0.9::DOUBLE AS confidence FROM {_un({'r': _all(rules.PARTY_ROLE_FIRST, 1), 'n': _all(rules.PARTY_ROLE_FIRST, 2)})}
UNION ALL SELECT doc_id, case_id, 'entity', 'party', {S(f'CASE WHEN lower(n) IN {_ROLES} THEN x ELSE n END')}, lower(CASE WHEN lower(n) IN {_ROLES} THEN n ELSE r END), 0.9 FROM {_un({'n': _all(rules.PARTY_NAME_FIRST, 1), 'x': _all(rules.PARTY_NAME_FIRST, 2), 'r': _all(rules.PARTY_NAME_FIRST, 3)})}"""
_JUDGES = " UNION ALL ".join(f"SELECT doc_id, case_id, 'entity' AS kind, 'judge' AS type, {S('n')} AS text, 'judge' AS role, 0.95::DOUBLE AS confidence FROM {_un({'n': _all(p)})}" for p in rules.JUDGE_PATTERNS)
_COURTS = f"SELECT doc_id, case_id, 'entity' AS kind, 'court' AS type, {S('n')} AS text, 'court' AS role, 0.95::DOUBLE AS confidence FROM {_un({'n': _all(rules.COURT_PATTERN)})}"
_WITNESSES = f"SELECT doc_id, case_id, 'entity' AS kind, 'witness' AS type, {S('n')} AS text, 'witness' AS role, 0.85::DOUBLE AS confidence FROM {_un({'n': _all(rules.WITNESS_PATTERN)})}"
_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {LIKE_ANY('lower(t)', kws)} THEN '{n}' END" for n, kws in rules.ISSUE_KEYWORDS) + "], lambda z: z IS NOT NULL)"
_ISSUES = f"""SELECT doc_id, case_id, 'issue' AS kind, 'issue' AS type, t AS text, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN contains(lower(t), 'procedure') OR contains(lower(t), 'jurisdiction')
  THEN 'Procedural' ELSE 'Civil' END AS role, round(least(0.75::DOUBLE + greatest(len(l), 1) * 0.05::DOUBLE, 0.98), 3) AS confidence FROM (SELECT *, {_LABELS} AS l FROM (SELECT doc_id, case_id,
  concat('Whether ', {S('m')}) AS t FROM {_un({'m': _all(rules.ISSUE_PATTERN)})}))"""
_CLAIMS = f"""SELECT doc_id, case_id, 'claim' AS kind, 'claim_primary' AS type, concat('Sought ', {S('m')}) AS text, NULL AS role, 0.88::DOUBLE AS confidence FROM {_un({'m': _all(rules.CLAIM_PATTERN)})}
UNION ALL SELECT doc_id, case_id, 'claim', 'defense', concat('Disputed/Rebutted ', {S('m')}), NULL, 0.82 FROM {_un({'m': _all(rules.DEFENSE_PATTERN)})}"""
_ARGS = " UNION ALL ".join(f"SELECT doc_id, case_id, 'claim' AS kind, '{n}' AS type, {S('m')} AS text, NULL AS role, {c}::DOUBLE AS confidence FROM {_un({'m': _all(p)})} WHERE {S('m')} <> ''"
                           for n, c, p in rules.ARGUMENT_RULES)
_STRENGTH = f"CASE WHEN {LIKE_ANY('lower(t)', rules.STRONG_EVIDENCE)} THEN 0.9::DOUBLE WHEN {LIKE_ANY('lower(t)', rules.WEAK_EVIDENCE)} THEN 0.25 ELSE 0.5 END"
_EVIDENCE = f"""SELECT doc_id, case_id, 'evidence' AS kind, CASE WHEN contains(lower(t), 'testified') THEN 'witness_testimony' WHEN contains(lower(t), 'forensic') THEN 'forensic' ELSE 'exhibit' END AS type,
  t AS text, CAST({_STRENGTH} AS VARCHAR) AS role, round((0.9::DOUBLE * 0.3 + {_STRENGTH} * 0.07) / 0.37::DOUBLE, 3) AS confidence FROM (""" + " UNION ALL ".join(
    f"SELECT doc_id, case_id, {S('m')} AS t FROM {_un({'m': _all(p)})}" for p in rules.EVIDENCE_PATTERNS) + ")"


def _map_case(x: str, d: dict, other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + f" ELSE {other} END"


def _statute_sql(src: str) -> str:
    """src gives doc_id, case_id, a (raw act), s (raw section)."""
    num = S(r"regexp_replace(s, '(?i)^(?:Sec\.|Section|Sec)\s*', '')")
    return f"""SELECT doc_id, case_id, act, num, CASE WHEN num <> '' THEN concat(act, ', Section ', num) ELSE act END AS reference,
  CASE WHEN act = '{rules.PENAL_CODE}' THEN {_map_case('num', rules.OFFENCES, f"'{rules.PENAL_DEFAULT}'")} ELSE '{rules.OFFENCE_DEFAULT}' END AS offence
  FROM (SELECT doc_id, case_id, {_map_case(f"lower({S('a')})", rules.ACT_ALIASES, S('a'))} AS act, {num} AS num FROM {src})"""


_STAT_SRC = f"""(SELECT doc_id, case_id, a, concat(t, ' ', n) AS s FROM {_un({'t': _all(rules.STATUTE_PATTERN, 1), 'n': _all(rules.STATUTE_PATTERN, 2), 'a': _all(rules.STATUTE_PATTERN, 3)})})"""
_STATUTES = f"SELECT doc_id, case_id, 'statute' AS kind, 'statute' AS type, act AS text, reference AS role, 0.95::DOUBLE AS confidence FROM ({_statute_sql(_STAT_SRC)})"
_PROC = LIKE_ANY("lower(s)", rules.PROCEDURAL_FACTS)
_FACTS = f"""SELECT doc_id, case_id, 'fact' AS kind, 'fact' AS type, s AS text, CASE WHEN {_PROC} THEN 'Procedural Facts' ELSE 'Factual Findings' END AS role, 0.85::DOUBLE AS confidence
  FROM {_un({'s': SENT('text')})} WHERE {LIKE_ANY('lower(s)', rules.FACT_TRIGGERS)}"""

_SHOW = "doc_id, type, md5(text) AS digest, role, round(confidence, 3) AS confidence"


def _items(spark, folder, *kinds, role="role"):
    return op.extract(legal_chunks(spark, folder), list(kinds)).select(
        "doc_id", "type", F.md5("text").alias("digest"), F.col(role).cast("string").alias("role"), rounded("confidence", 3).alias("confidence"))


def _extract_query(name, sql, kinds, role="role"):
    @query(name, f"WITH {_W} SELECT {_SHOW} FROM ({sql})")
    def run(spark, folder):
        return _items(spark, folder, *kinds, role=role)

    return run


_extract_query("g1_extract_parties", _PARTIES, ["parties"])
_extract_query("g2_extract_judges", _JUDGES, ["judges"])
_extract_query("g3_extract_courts", _COURTS, ["courts"])
_extract_query("g4_extract_witnesses", _WITNESSES, ["witnesses"])
_extract_query("g5_extract_issues", _ISSUES, ["issues"], role="labels")
_extract_query("g7_extract_claims", _CLAIMS, ["claims"])
_extract_query("g8_extract_arguments", _ARGS, ["arguments"])
_extract_query("g9_extract_evidence", _EVIDENCE, ["evidence"], role="strength")
_extract_query("g10_extract_statutes", _STATUTES, ["statutes"], role="reference")
_extract_query("g11_extract_facts", _FACTS, ["facts"], role="category")

_TOPIC = "concat(p_name, ' ', CASE p_size % 7 WHEN 0 THEN 'bail under article 21' WHEN 1 THEN 'breach of contract and damages' WHEN 2 THEN 'income tax delay' WHEN 3 THEN 'company board lease' WHEN 4 THEN 'jurisdictional procedur' WHEN 5 THEN 'custody of wife' ELSE 'nothing known' END)"


@query("g6_classify_issue", f"""SELECT p_partkey, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') WHEN contains(lower(t), 'procedure') OR contains(lower(t), 'jurisdiction') THEN 'Procedural' ELSE 'Civil' END AS labels,
  round(least(0.75::DOUBLE + greatest(len(l), 1) * 0.05::DOUBLE, 0.98), 3) AS confidence FROM (SELECT *, {_LABELS} AS l FROM (SELECT p_partkey, {_TOPIC} AS t FROM part))""")
def g6(spark, folder):
    labels = op.issue_labels(F.expr(_TOPIC))
    return load_table(spark, folder, "part").select("p_partkey", labels.alias("l")).select(
        "p_partkey", F.array_join("l", ",").alias("labels"), op.issue_confidence(F.col("l")).alias("confidence"))


_ACTS = "SELECT p_partkey AS doc_id, p_brand AS case_id, CASE p_size % 4 WHEN 0 THEN ' IPC ' WHEN 1 THEN 'CrPC' WHEN 2 THEN 'NDPS Act' ELSE p_type END AS a, CASE p_partkey % 5 WHEN 0 THEN 'Section 302' WHEN 1 THEN 'Sec. 498a' WHEN 2 THEN '' WHEN 3 THEN 'sec 12' ELSE '420' END AS s FROM {part}"


@query("g10_normalize_statute", f"SELECT doc_id, act, nullif(num, '') AS section, reference, offence FROM ({_statute_sql('(' + D(_ACTS) + ')')})")
def g10(spark, folder):
    return st.rows(spark, folder, _ACTS).select("doc_id", op.normalize_statute("a", "s").alias("n")).select(
        "doc_id", "n.act", "n.section", "n.reference", "n.offence")


_P = {"extractor": "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END", "embedding": "CASE WHEN l_linenumber % 3 > 0 THEN l_tax * 10 END",
      "strength": "CASE WHEN l_returnflag = 'A' THEN 0.9 END"}


@query("g12_combine_confidence", f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN d > 0 THEN least(greatest(round(n / d, 3), 0), 1) ELSE a END AS confidence FROM (SELECT *, coalesce(a * 0.3::DOUBLE, 0) + coalesce(b * 0.25::DOUBLE, 0) + coalesce(c * 0.07::DOUBLE, 0) AS n,
  CASE WHEN a IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.07::DOUBLE END AS d FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  {_P['extractor']} AS a, {_P['embedding']} AS b, CAST({_P['strength']} AS DOUBLE) AS c FROM lineitem))""")
def g12(spark, folder):
    parts = {k: F.expr(v).cast("double") for k, v in _P.items()}
    return load_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", op.combine_confidence(**parts).alias("confidence"))


_ITEMS_SQL = " UNION ALL ".join([_FACTS, _PARTIES, _JUDGES, _COURTS, _WITNESSES, _ISSUES, _CLAIMS, _ARGS, _EVIDENCE, _STATUTES])
_N = lambda k: f"count(*) FILTER (kind = '{k}')"
_COUNTS = f"{_N('fact')} AS facts, {_N('entity')} AS entities, {_N('issue')} AS issues, {_N('claim')} AS claims, {_N('evidence')} AS evidence, {_N('statute')} AS statutes"


@query("g13_extract_knowledge", f"WITH {_W} SELECT case_id, {_COUNTS} FROM ({_ITEMS_SQL}) GROUP BY case_id")
def g13(spark, folder):
    return op.extraction_counts(op.extract(legal_chunks(spark, folder)), ["case_id"])


_NAMES = ("SELECT p_partkey AS entity_id, p_brand AS case_id, 'party' AS entity_type, concat(CASE p_size % 5 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'Justice ' ELSE '' END, p_name, "
          "CASE p_size % 3 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ', co' ELSE '' END) AS name FROM {part}")


def _clean(x: str) -> str:
    out = f"lower({x})"
    for t in rules.NAME_TITLES:
        out = f"replace({out}, '{q(t)}', '')"
    return S(f"regexp_replace(regexp_replace({out}, '[.,]', ' ', 'g'), '\\s+', ' ', 'g')")


_TOK = lambda c: f"list_sort(list_distinct(list_filter(string_split({c}, ' '), lambda z: z <> '')))"
_JAC = lambda a, b: f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))"


@query("g14_normalize_entity_name", f"""WITH n AS (SELECT entity_id, {_clean('name')} AS clean FROM ({D(_NAMES)})), t AS (SELECT *, {_TOK('clean')} AS a FROM n)
SELECT entity_id, clean, round({_JAC('a', "['ltd', 'small']")}, 6) AS jaccard FROM t""")
def g14(spark, folder):
    df = st.rows(spark, folder, _NAMES).withColumn("clean", op.normalize_entity_name("name"))
    return df.select("entity_id", "clean", rounded(op.name_jaccard(op.name_tokens("clean"), F.array(F.lit("ltd"), F.lit("small"))), 6).alias("jaccard"))


def _letters(name: str, spark: bool) -> str:
    """Letter counts of a name: a small vector both engines can compute."""
    f = "length(n) - length(replace(n, chr(c), ''))"
    if spark:
        return f"transform(sequence(97, 122), c -> CAST(length(lower({name})) - length(replace(lower({name}), chr(c), '')) AS DOUBLE))"
    return f"list_transform(range(97, 123), lambda c: CAST(length(lower({name})) - length(replace(lower({name}), chr(c::INT), '')) AS DOUBLE))"


_DIST = f"""nm AS (SELECT case_id, name, min(entity_id) AS id FROM ({D(_NAMES)}) GROUP BY 1, 2), tk AS (SELECT *, {_clean('name')} AS clean, {_TOK(_clean('name'))} AS t, {_letters('name', False)} AS v FROM nm),
pr AS (SELECT a.case_id, a.id AS a_id, b.id AS b_id, 0.6::DOUBLE * list_cosine_similarity(a.v, b.v) + 0.4::DOUBLE * {_JAC('a.t', 'b.t')} AS score FROM tk a JOIN tk b ON a.case_id = b.case_id AND a.id < b.id),
pairs AS (SELECT * FROM pr WHERE score >= 0.78)"""


def _named(spark, folder):
    return st.rows(spark, folder, _NAMES).withColumn("vector", F.expr(_letters("name", True)))


@query("g15_similar_names", f"WITH {_DIST} SELECT case_id, a_id, b_id, round(score, 6) AS score FROM pairs")
def g15(spark, folder):
    return ent.similar_names(ent.distinct_names(_named(spark, folder), "vector")).select("case_id", "a_id", "b_id", rounded("score", 6).alias("score"))


_RESOLVE = f"""WITH RECURSIVE {_DIST},
nb AS (SELECT tk.case_id, tk.id, row_number() OVER (PARTITION BY tk.case_id ORDER BY tk.id) AS k, coalesce((SELECT list(a_id) FROM pairs WHERE b_id = tk.id), []) AS before FROM tk),
g AS (SELECT case_id, 0::BIGINT AS k, []::BIGINT[] AS heads FROM nb GROUP BY case_id UNION ALL
  SELECT g.case_id, nb.k, CASE WHEN list_has_any(heads, before) THEN heads ELSE list_append(heads, nb.id) END FROM g JOIN nb ON nb.case_id = g.case_id AND nb.k = g.k + 1),
hd AS (SELECT unnest(heads) AS id FROM (SELECT case_id, arg_max(heads, k) AS heads FROM g GROUP BY case_id)),
opt AS (SELECT a_id AS id, b_id AS head, score FROM pairs UNION ALL SELECT b_id, a_id, score FROM pairs UNION ALL SELECT id, id, 1.0 FROM tk),
e AS (SELECT n.entity_id, n.case_id, n.name, nm.id FROM ({D(_NAMES)}) n JOIN nm ON nm.case_id = n.case_id AND nm.name = n.name),
best AS (SELECT e.entity_id, arg_min(opt.head, (-score, opt.head)) AS canonical_id, max(score) AS s FROM e JOIN opt ON opt.id = e.id JOIN hd ON hd.id = opt.head WHERE opt.head < e.entity_id GROUP BY e.entity_id),
res AS (SELECT e.entity_id, e.case_id, e.name, canonical_id, round(s, 3) AS similarity, CASE WHEN canonical_id IS NULL THEN 'canonical' ELSE 'merged' END AS status FROM e LEFT JOIN best USING (entity_id))"""


@query("g16_resolve_entities", _RESOLVE + " SELECT entity_id, status, canonical_id, similarity FROM res")
def g16(spark, folder):
    return ent.resolve_entities(_named(spark, folder), "vector").select("entity_id", "status", "canonical_id", "similarity")


@query("g16_resolve_by_name", f"""WITH n AS (SELECT entity_id, case_id, {_clean('name')} AS clean FROM ({D(_NAMES)})), m AS (SELECT *, min(entity_id) OVER (PARTITION BY case_id, clean) AS h FROM n)
SELECT entity_id, CASE WHEN entity_id = h THEN 'canonical' ELSE 'merged' END AS status, CASE WHEN entity_id <> h THEN h END AS canonical_id FROM m""")
def g16_names(spark, folder):
    """Without vectors only equal cleaned names merge."""
    return ent.resolve_entities(st.rows(spark, folder, _NAMES)).select("entity_id", "status", "canonical_id")


@query("g16_aliases", _RESOLVE + " SELECT DISTINCT r.canonical_id, r.name AS alias FROM res r JOIN res c ON c.entity_id = r.canonical_id WHERE r.name <> c.name")
def g16_aliases(spark, folder):
    return ent.aliases(ent.resolve_entities(_named(spark, folder), "vector"))


@query("g24_merge_history", _RESOLVE + """ SELECT r.canonical_id, r.entity_id AS merged_entity_id, r.name AS original_name, r.similarity, c.name AS canonical_name
FROM res r JOIN res c ON c.entity_id = r.canonical_id""")
def g24(spark, folder):
    return ent.merge_history(ent.resolve_entities(_named(spark, folder), "vector"))


_EDGES = "SELECT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst, l_orderkey * 10 + l_linenumber AS edge_id, CASE l_returnflag WHEN 'A' THEN 'RELIES_ON' WHEN 'N' THEN 'HEARD_BY' ELSE 'SUPPORTS' END AS type FROM {lineitem}"


@query("g17_rewrite_references", f"""WITH m AS (SELECT p_partkey AS e, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part)
SELECT l_orderkey, l_linenumber, l_suppkey, m.c AS source_id, CASE WHEN l_suppkey = m2.e AND m2.c IS NOT NULL THEN m2.c ELSE l_suppkey END AS target_id FROM lineitem JOIN m ON m.e = l_partkey LEFT JOIN m m2 ON m2.e = l_suppkey""")
def g17(spark, folder):
    part = load_table(spark, folder, "part")
    heads = part.groupBy("p_name").agg(F.min("p_partkey").alias("canonical_id"))
    merged = part.join(heads, "p_name").filter("p_partkey <> canonical_id").select(F.col("p_partkey").alias("entity_id"), "canonical_id")
    edges = load_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return op.rewrite_references(edges, merged)


_ROLE_ITEMS = """SELECT concat('p', p_partkey) AS item_id, p_brand AS case_id, 'entity' AS kind, CASE p_size % 4 WHEN 0 THEN 'party' WHEN 1 THEN 'judge' WHEN 2 THEN 'court' ELSE 'advocate' END AS type, p_name AS text,
  CASE WHEN p_size = 8 THEN 'Senior Counsel' END AS role, p_partkey AS doc_id FROM {part}
UNION ALL SELECT concat('s', s_suppkey), concat('Brand#', s_nationkey), CASE s_suppkey % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'statute' WHEN 2 THEN 'fact' ELSE 'evidence' END, 'x',
  CASE WHEN s_acctbal > 3000 THEN 'It refutes the claim' ELSE 'It stands' END, NULL, s_suppkey FROM {supplier}"""
_SLOT = f"""i AS ({D(_ROLE_ITEMS)}), sl AS (
SELECT case_id, item_id, 'REPRESENTS' AS rel, 'source' AS side FROM i WHERE kind = 'entity' AND (type = 'advocate' OR contains(lower(coalesce(role, '')), 'counsel'))
UNION ALL SELECT case_id, item_id, 'REPRESENTS', 'target' FROM i WHERE kind = 'entity' AND type = 'party'
UNION ALL SELECT case_id, item_id, 'HEARD_BY', 'source' FROM i WHERE kind = 'entity' AND type = 'judge' UNION ALL SELECT case_id, item_id, 'HEARD_BY', 'target' FROM i WHERE kind = 'entity' AND type = 'court'
UNION ALL SELECT case_id, item_id, CASE WHEN contains(lower(text), 'refutes') THEN 'REFUTES' ELSE 'SUPPORTS' END, 'source' FROM i WHERE kind = 'evidence'
UNION ALL SELECT case_id, item_id, unnest(['REFUTES', 'SUPPORTS']), 'target' FROM i WHERE kind = 'claim' UNION ALL SELECT case_id, item_id, 'RELIES_ON', 'source' FROM i WHERE kind = 'claim'
UNION ALL SELECT case_id, item_id, 'RELIES_ON', 'target' FROM i WHERE kind = 'statute' UNION ALL SELECT case_id, item_id, 'REFERENCES', 'source' FROM i WHERE kind = 'fact'
UNION ALL SELECT case_id, item_id, 'REFERENCES', 'target' FROM i WHERE kind = 'statute'),
edge AS (SELECT a.case_id, a.rel, a.item_id AS source_id, b.item_id AS target_id FROM sl a JOIN sl b ON a.case_id = b.case_id AND a.rel = b.rel AND a.side = 'source' AND b.side = 'target')"""


@query("g18_relation_sides", f"""WITH {_SLOT} SELECT case_id, rel AS relation, 'source' AS side, source_id AS item_id, count(*) AS partners FROM edge GROUP BY ALL
UNION ALL SELECT case_id, rel, 'target', target_id, count(*) FROM edge GROUP BY ALL""")
def g18(spark, folder):
    return op.relation_sides(st.rows(spark, folder, _ROLE_ITEMS)).select("case_id", "relation", "side", "item_id", "partners")


@query("g18_edges_of", f"WITH {_SLOT} SELECT case_id, rel AS relation, source_id, target_id FROM edge WHERE source_id IN (SELECT item_id FROM i WHERE doc_id % 5 = 0)")
def g18_edges(spark, folder):
    """The edges that start at every fifth item of either kind of stand-in, so that all six relations occur."""
    items = st.rows(spark, folder, _ROLE_ITEMS)
    return op.edges_of(op.relation_sides(items), items.filter("doc_id % 5 = 0")).select("case_id", "relation", "source_id", "target_id")


@query("g19_graph_nodes", f"""WITH {_W} SELECT case_id, kind AS type, text AS label, count(*) AS nodes FROM (SELECT case_id, CASE WHEN kind IN ('entity', 'claim') THEN type ELSE kind END AS kind, CASE WHEN kind = 'statute' THEN role WHEN kind = 'entity'
  THEN text ELSE concat(left(text, 40), '...') END AS text FROM ({_ITEMS_SQL}) WHERE kind IN ('entity', 'claim', 'evidence', 'statute')) GROUP BY ALL""")
def g19(spark, folder):
    items = op.extract(legal_chunks(spark, folder)).withColumn("status", F.lit(None).cast("string"))
    return op.graph_nodes(items).groupBy("case_id", "type", "label").agg(F.count("*").alias("nodes"))


@query("g20_graph_neighbors", f"""WITH e AS ({D(_EDGES)}) SELECT dst AS node, src AS other, count(*) AS edges FROM e WHERE dst IN (SELECT concat('s', s_suppkey) FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2""")
def g20(spark, folder):
    nodes = load_table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return gr.graph_neighbors(st.rows(spark, folder, _EDGES), nodes)


@query("g21_hops_from", f"""WITH RECURSIVE e AS ({D(_EDGES)}), l AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT DISTINCT dst, src FROM e),
b(start, node, hops) USING KEY (start, node) AS (SELECT concat('s', s_suppkey), concat('s', s_suppkey), 0 FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)
  UNION SELECT DISTINCT b.start, l.b, b.hops + 1 FROM b JOIN l ON l.a = b.node LEFT JOIN recurring.b AS r ON r.start = b.start AND r.node = l.b WHERE r.node IS NULL)
SELECT start, node, CAST(hops AS INTEGER) AS hops FROM b""")
def g21(spark, folder):
    first = load_table(spark, folder, "supplier").agg(F.min("s_suppkey").alias("k")).select(F.concat(F.lit("s"), "k").alias("node"))
    return gr.hops_from(st.rows(spark, folder, _EDGES), first).select("start", "node", "hops")


_PAIRS = """SELECT concat('s', s_suppkey) AS start, concat('p', p_partkey) AS "end" FROM {supplier} JOIN {part} ON s_suppkey % 10 = 1 AND p_partkey % 20 = s_suppkey % 20"""


@query("g21_paths_of_pairs", f"""WITH RECURSIVE e AS ({D(_EDGES)}), l AS (SELECT DISTINCT src AS a, dst AS b FROM e UNION SELECT DISTINCT dst, src FROM e), pr AS ({D(_PAIRS)}),
b AS (SELECT DISTINCT start, start AS node, 0 AS hops FROM pr UNION SELECT start, l.b, hops + 1 FROM b JOIN l ON l.a = b.node WHERE hops < 4),
m AS (SELECT start, node, min(hops) AS hops FROM b GROUP BY ALL)
SELECT pr.start, pr."end", CAST(hops AS INTEGER) AS hops, CAST(2 * hops + 1 AS BIGINT) AS steps, CAST(0 AS BIGINT) AS broken FROM pr JOIN m ON m.start = pr.start AND m.node = pr."end" """)
def g21_pairs(spark, folder):
    """Shortest paths of many pairs at once, each path checked to be one: relationship steps join the nodes around them."""
    edges = st.rows(spark, folder, _EDGES)
    # The pairs are many more than the rows they are made of, so the parts are dealt to all cores first.
    pairs = spark.sql(_PAIRS.replace('"', "`"), supplier=load_table(spark, folder, "supplier"), part=spread(load_table(spark, folder, "part").select("p_partkey")))
    paths = gr.shortest_paths(edges, pairs, max_hops=4)
    pair = W.partitionBy("start", "end")
    way = paths.select("start", "end", "hops", "step", "kind", "id", F.lag("id").over(pair.orderBy("step")).alias("a"), F.lead("id").over(pair.orderBy("step")).alias("b"), F.count("*").over(pair).alias("steps"))
    taken = way.filter("kind = 'relationship' or step = 0").select("start", "end", "hops", "steps", "kind", "id", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    known = edges.select(F.col("edge_id").cast("string").alias("id"), F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"), F.lit(True).alias("known")).distinct()
    return taken.join(known.hint("merge"), ["id", "_a", "_b"], "left").groupBy("start", "end", "hops", "steps").agg(F.count_if(F.expr("kind = 'relationship' and known is null")).alias("broken"))


@query("g22_degree_centrality", f"WITH e AS ({D(_EDGES)}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def g22(spark, folder):
    return gr.degree_centrality(st.rows(spark, folder, _EDGES), 20)


@query("g23_graph_totals", "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS total_nodes, (SELECT count(*) FROM lineitem) AS total_edges")
def g23(spark, folder):
    nodes = load_table(spark, folder, "part").select("p_partkey").union(load_table(spark, folder, "supplier").select("s_suppkey"))
    return gr.graph_totals(nodes, load_table(spark, folder, "lineitem").select("l_orderkey"))


@query("g23_knowledge_stats", f"WITH {_W} SELECT case_id, {_COUNTS} FROM ({_ITEMS_SQL}) WHERE NOT (kind = 'entity' AND type = 'court') GROUP BY case_id")
def g23_stats(spark, folder):
    """Courts count as merged here."""
    items = op.extract(legal_chunks(spark, folder)).withColumn("status", F.when((F.col("kind") == "entity") & (F.col("type") == "court"), "merged"))
    return op.knowledge_stats(items, ["case_id"])


_KIND_NAMES = {"fact": "Facts", "entity": "Entities", "claim": "Claims/Defenses", "evidence": "Evidence", "statute": "Statutes"}


@query("j13_intelligence_metrics", f"""WITH {_W}, i AS ({_ITEMS_SQL}) SELECT 'intelligence' AS category, 'extracted_items' AS section, {_map_case('kind', _KIND_NAMES, 'NULL')} AS label, count(*)::DOUBLE AS value, 'count' AS unit FROM i WHERE kind <> 'issue' GROUP BY kind
UNION ALL SELECT 'intelligence', 'evidence_strength_distribution', CASE WHEN role::DOUBLE >= 0.8 THEN 'Strong Evidence (>80%)' WHEN role::DOUBLE >= 0.5 THEN 'Medium Strength (50-80%)' ELSE 'Weak/Unverified' END, count(*), 'count' FROM i WHERE kind = 'evidence' GROUP BY 3""")
def j13(spark, folder):
    items = cut_lineage(op.extract(legal_chunks(spark, folder)).select("kind", "strength").filter("kind <> 'issue'"))
    names = F.create_map(*[F.lit(x) for kv in _KIND_NAMES.items() for x in kv])
    return metrics.intelligence_metrics(items.withColumn("kind", names[F.col("kind")]), items.filter("kind = 'evidence'"))


@query("j14_graph_metrics", f"""WITH e AS ({D(_EDGES)}), n AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM e) AS m)
SELECT 'graph' AS category, 'metrics' AS section, 'Total Relation Edges' AS label, m::DOUBLE AS value, 'edges' AS unit FROM n UNION ALL SELECT 'graph', 'metrics', 'Total Graph Nodes', n, 'nodes' FROM n
UNION ALL SELECT 'graph', 'metrics', 'Graph Density', round(m / n::DOUBLE, 2), 'density' FROM n
UNION ALL SELECT 'graph', 'relationship_types_distribution', CASE type WHEN 'RELIES_ON' THEN 'Relies On' WHEN 'HEARD_BY' THEN 'Heard By' ELSE 'Supports' END, count(*), 'count' FROM e GROUP BY type""")
def j14(spark, folder):
    nodes = load_table(spark, folder, "part").select("p_partkey").union(load_table(spark, folder, "supplier").select("s_suppkey"))
    return metrics.graph_metrics(nodes, st.rows(spark, folder, _EDGES))


@query("j15_quality_metrics", f"""WITH {_W}, i AS (SELECT * FROM ({_ITEMS_SQL}) WHERE kind IN ('fact', 'entity', 'claim')) SELECT 'quality' AS category, 'metrics' AS section, 'Extraction Quality' AS label, round(avg(confidence) * 100, 1) AS value, '%' AS unit FROM i
UNION ALL SELECT 'quality', 'confidence_distribution', CASE WHEN confidence >= 0.9 THEN 'High (> 90%)' WHEN confidence >= 0.7 THEN 'Medium (70-90%)' ELSE 'Low (< 70%)' END, count(*), 'count' FROM i GROUP BY 3""")
def j15(spark, folder):
    items = op.extract(legal_chunks(spark, folder)).filter("kind in ('fact', 'entity', 'claim')")
    return metrics.quality_metrics(items)
