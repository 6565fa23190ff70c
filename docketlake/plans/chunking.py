"""Queries over chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import sentences
from ..operators import chunking as op
from ..sources.tables import load_table
from . import standins as st
from .registry import query
from .sqltext import CASE_REGEX, NL, S, SENT, TOK, WC


def _pack_sql(joiner: int) -> str:
    """Recursive packing of the rows u(key, i, s, len, w) into chunks."""
    over = (f"(r.c + {joiner} + u.len > 3000 OR r.ws + u.w > 500 OR {TOK('(r.ws + u.w)')} > 800)")
    return f"""SELECT key, i, len AS c, w AS ws, 1 AS chunk FROM u WHERE i = 1 UNION ALL
  SELECT u.key, u.i, CASE WHEN {over} THEN u.len ELSE r.c + {joiner} + u.len END,
  CASE WHEN {over} THEN u.w ELSE r.ws + u.w END, r.chunk + CAST({over} AS INT) FROM r JOIN u ON u.key = r.key AND u.i = r.i + 1"""


_MARKS = st.PAGED_TEXT


@query("d1_page_range", f"""
WITH w AS (SELECT doc_id, n_chars, {_MARKS} AS text FROM documents),
m AS (SELECT doc_id, n_chars, instr(text, '--- Page 2 ---') - 1 AS p2, length(text) AS n FROM w)
SELECT doc_id, CASE WHEN n_chars // 2 >= p2 THEN 2 ELSE 1 END AS page_start, CASE WHEN n // 2 + 20 >= p2 THEN 2 ELSE 1 END
  AS page_end FROM m""")
def d1(spark, folder):
    df = st.documents(spark, folder, _MARKS)
    rng = op.offset_range(F.col("pages"), F.floor(F.col("n_chars") / 2), F.floor(F.length("text") / 2) + 20, "page")
    return df.withColumn("pages", op.page_offsets("text")).withColumn("r", rng).select(
        "doc_id", F.col("r.first").alias("page_start"), F.col("r.last").alias("page_end"))


@query("d2_paragraph_range", f"""
WITH w AS (SELECT doc_id, {st.PARAGRAPH_TEXT} AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, {NL} || {NL})) AS x, generate_subscripts(string_split(text, {NL} || {NL}), 1) AS i FROM w),
o AS (SELECT doc_id, i, coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1
  PRECEDING), 0) AS pos FROM p),
a AS (SELECT doc_id, count(*) AS n, sum(pos) AS total FROM o GROUP BY doc_id),
m AS (SELECT o.doc_id, max(i) AS mid FROM o JOIN w ON w.doc_id = o.doc_id AND pos <= length(text) // 2 GROUP BY o.doc_id)
SELECT doc_id, CAST(n AS INTEGER) AS paragraphs, CAST(total AS BIGINT) AS pos_total, CAST(mid AS INTEGER) AS paragraph_start,
  CAST(n AS INTEGER) AS paragraph_end FROM a JOIN m USING (doc_id)""")
def d2(spark, folder):
    df = st.documents(spark, folder, st.PARAGRAPH_TEXT)
    starts = op.paragraph_starts(df).groupBy("doc_id").agg(F.count("*").cast("int").alias("paragraphs"), F.sum("pos").alias("pos_total"))
    rng = df.select("doc_id", op.paragraph_range("text", F.floor(F.length("text") / 2), F.length("text")).alias("r"))
    return starts.join(rng, "doc_id").select(
        "doc_id", "paragraphs", "pos_total", F.col("r.first").alias("paragraph_start"), F.col("r.last").alias("paragraph_end"))


@query("d3_estimate_tokens", f"""
SELECT doc_id, CAST({WC('text')} AS INTEGER) AS words, {TOK(WC('text'))} AS tokens FROM documents""")
def d3(spark, folder):
    return op.token_estimates(st.documents(spark, folder)).select("doc_id", "words", "tokens")


@query("d4_split_sentences", f"""
SELECT doc_id, i AS position, length(s) AS chars, md5(s) AS digest FROM (SELECT doc_id, unnest({SENT('text')}) AS s,
  generate_subscripts({SENT('text')}, 1) - 1 AS i FROM documents)""")
def d4(spark, folder):
    return st.documents(spark, folder).select("doc_id", F.posexplode(sentences("text")).alias("position", "s")).select(
        "doc_id", "position", F.length("s").alias("chars"), F.md5("s").alias("digest"))


_CHUNK_COLS = ["doc_id", "chunk_index", "words", "chars", "tokens", "page_start", "page_end", "paragraph_start",
               "paragraph_end"]


def _rows(chunks, *more):
    return chunks.select(*_CHUNK_COLS, *more, F.md5("text").alias("digest"))


@query("d5_chunk_paragraphs", f"""
WITH RECURSIVE w AS (SELECT doc_id, {st.PARAGRAPH_TEXT} AS text FROM documents),
p0 AS (SELECT doc_id, unnest(string_split(text, {NL} || {NL})) AS raw, generate_subscripts(string_split(text, {NL} || {NL}), 1) AS pi,
  len(string_split(text, {NL} || {NL})) AS np FROM w),
p AS (SELECT doc_id, pi, np, {S('raw')} AS s, length({S('raw')}) > 3000 OR {WC('raw')} > 500 AS big FROM p0 WHERE {S('raw')} <> ''),
g AS (SELECT *, sum(CAST(big AS INT)) OVER (PARTITION BY doc_id ORDER BY pi) AS run FROM p),
u AS (
  SELECT concat(doc_id, '/', run, '/n') AS key, row_number() OVER (PARTITION BY doc_id, run ORDER BY pi) AS i, s, length(s) AS len,
    {WC('s')} AS w, doc_id, pi, np, big, 0 AS k FROM g WHERE NOT big
  UNION ALL
  SELECT concat(doc_id, '/', pi, '/b'), row_number() OVER (PARTITION BY doc_id, pi ORDER BY k), s, length(s), {WC('s')}, doc_id, pi, np,
    big, k FROM (SELECT doc_id, pi, np, big, unnest({SENT('s')}) AS s, generate_subscripts({SENT('s')}, 1) AS k FROM g WHERE big)),
rn AS (SELECT key, i, len, w FROM u),
r AS ({_pack_sql(2).replace('FROM u WHERE i = 1', "FROM u WHERE i = 1 AND NOT big").replace('JOIN u ON', 'JOIN u ON NOT u.big AND')}),
rb AS ({_pack_sql(1).replace('FROM u WHERE i = 1', "FROM u WHERE i = 1 AND big").replace('JOIN u ON', 'JOIN u ON u.big AND').replace('FROM r JOIN', 'FROM rb r JOIN')}),
a AS (SELECT u.doc_id, u.key, r.chunk, u.i, u.s, u.w, u.pi, u.np, u.big, u.k FROM (SELECT * FROM r UNION ALL SELECT * FROM rb) r
  JOIN u ON u.key = r.key AND u.i = r.i),
c AS (SELECT doc_id, key, chunk, min(pi) AS p1, min(k) AS k1, any_value(np) AS np, any_value(big) AS big, sum(w) AS words,
  CASE WHEN any_value(big) THEN string_agg(s, ' ' ORDER BY i) ELSE string_agg(s, {NL} || {NL} ORDER BY i) END AS text
  FROM a GROUP BY doc_id, key, chunk)
SELECT doc_id, CAST(row_number() OVER v - 1 AS INTEGER) AS chunk_index, CAST(words AS INTEGER) AS words,
  CAST(length(text) AS INTEGER) AS chars, {TOK('words')} AS tokens, 1 AS page_start, 1 AS page_end, CAST(p1 AS INTEGER) AS paragraph_start,
  CAST(CASE WHEN big THEN p1 ELSE coalesce(lead(p1) OVER v, np) END AS INTEGER) AS paragraph_end, md5(text) AS digest
FROM c WINDOW v AS (PARTITION BY doc_id ORDER BY p1, k1)""")
def d5(spark, folder):
    return _rows(op.chunk_paragraphs(st.documents(spark, folder, st.PARAGRAPH_TEXT)))


_SLIDING_SQL = f"""
WITH RECURSIVE s AS (SELECT doc_id, unnest({SENT('text')}) AS s, generate_subscripts({SENT('text')}, 1) AS i FROM documents),
u AS (SELECT doc_id, i, s, length(s) AS len, {WC('s')} AS w, sum({WC('s')}) OVER v AS cw, sum(length(s)) OVER v AS cl,
  count(*) OVER (PARTITION BY doc_id) AS n FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
stop AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i >= a.i
  AND (b.cw - a.cw + a.w > 500 OR b.cl - a.cl + a.len > 3000 OR {TOK('b.w')} + {TOK('(b.cw - b.w - a.cw + a.w)')} > 800)
  GROUP BY a.doc_id, a.i),
e AS (SELECT u.doc_id, u.i, u.n, greatest(coalesce(stop.j - 1, u.n), u.i) AS last FROM u LEFT JOIN stop USING (doc_id, i)),
back AS (SELECT e.doc_id, e.i, max(b.i) AS stopper FROM e JOIN u l ON l.doc_id = e.doc_id AND l.i = e.last JOIN u b ON
  b.doc_id = e.doc_id AND b.i > e.i AND b.i <= e.last AND l.cw - b.cw + b.w > 50 GROUP BY e.doc_id, e.i),
nx AS (SELECT e.doc_id, e.i, e.last, e.n, greatest(coalesce(stopper, e.i) + 1, e.i + 1) AS nxt FROM e LEFT JOIN back USING (doc_id, i)),
chain AS (SELECT doc_id, i, last, n, nxt, 0 AS chunk_index FROM nx WHERE i = 1 UNION ALL
  SELECT nx.doc_id, nx.i, nx.last, nx.n, nx.nxt, chunk_index + 1 FROM chain c JOIN nx ON nx.doc_id = c.doc_id AND nx.i = c.nxt
  WHERE c.last < c.n),
t AS (SELECT c.doc_id, c.chunk_index, string_agg(u.s, ' ' ORDER BY u.i) AS text, sum(u.w) AS words FROM chain c JOIN u ON
  u.doc_id = c.doc_id AND u.i BETWEEN c.i AND c.last GROUP BY c.doc_id, c.chunk_index)"""


@query("d6_chunk_sliding", _SLIDING_SQL + f"""
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(words AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars,
  {TOK('words')} AS tokens, 1 AS page_start, 1 AS page_end, 1 AS paragraph_start, 1 AS paragraph_end, md5(text) AS digest FROM t""")
def d6(spark, folder):
    return _rows(op.chunk_sliding(st.documents(spark, folder)))


def _section_sql(is_title: str, title: str, first: str) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {st.SECTION_TEXT} AS text FROM documents),
l AS (SELECT doc_id, x, i, {S('x')} AS z FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS x,
  generate_subscripts(string_split(text, {NL}), 1) AS i FROM w)),
h AS (SELECT *, coalesce({is_title}, false) AS ish FROM l),
g AS (SELECT *, sum(CAST(ish AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
sec AS (SELECT doc_id, sec, {S(f'string_agg(x, {NL} ORDER BY i)')} AS s, coalesce(max(CASE WHEN ish THEN {title} END), '{first}') AS section
  FROM g GROUP BY doc_id, sec),
sc AS (SELECT *, length(s) <= 3000 AND {WC('s')} <= 500 AS small FROM sec WHERE s <> ''),
u0 AS (SELECT doc_id, sec, section, unnest(CASE WHEN small THEN [s] ELSE {SENT('s')} END) AS s,
  generate_subscripts(CASE WHEN small THEN [s] ELSE {SENT('s')} END, 1) AS i FROM sc),
u AS (SELECT concat(doc_id, '/', sec) AS key, doc_id, sec, section, i, s, length(s) AS len, {WC('s')} AS w FROM u0),
r AS ({_pack_sql(1)}),
c AS (SELECT u.doc_id, u.sec, any_value(u.section) AS section, r.chunk, string_agg(u.s, ' ' ORDER BY u.i) AS text, sum(u.w) AS words
  FROM r JOIN u ON u.key = r.key AND u.i = r.i GROUP BY u.doc_id, u.sec, r.chunk)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, chunk) - 1 AS INTEGER) AS chunk_index, section,
  CAST(words AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars, {TOK('words')} AS tokens, md5(text) AS digest FROM c"""


_HEADING = "'^[A-Z0-9\\s.\\-:]{4,70}$'"


@query("d7_chunk_headings", _section_sql(
    f"z <> '' AND (regexp_matches(z, '^#{{1,6}}\\s+.+$') OR (regexp_matches(z, {_HEADING}) AND NOT ends_with(z, '.')"
    " AND length(regexp_replace(z, '[^A-Z]', '', 'g')) > 3))",
    r"CASE WHEN regexp_matches(z, '^#{1,6}\s+.+$') THEN regexp_replace(z, '^#{1,6}\s+', '') ELSE z END", "Introduction"))
def d7(spark, folder):
    return op.chunk_headings(st.documents(spark, folder, st.SECTION_TEXT)).select(
        "doc_id", "chunk_index", "section", "words", "chars", "tokens", F.md5("text").alias("digest"))


_BARE = rf"""regexp_replace(z, '{rules.SECTION_NUMBER}', '')"""


@query("d8_chunk_legal_sections", _section_sql(
    f"z <> '' AND {CASE_REGEX(S(_BARE), rules.LEGAL_SECTIONS, '')} <> ''",
    CASE_REGEX(S(_BARE), rules.LEGAL_SECTIONS, ""), "Introductory Context"))
def d8(spark, folder):
    return op.chunk_legal_sections(st.documents(spark, folder, st.SECTION_TEXT)).select(
        "doc_id", "chunk_index", "section", "words", "chars", "tokens", F.md5("text").alias("digest"))


_CAT = "CASE lang WHEN 'en' THEN 'judgment' WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'letter' ELSE 'text' END"
_REQ = "CASE source WHEN 'src1' THEN 'Paragraph_Strategy' WHEN 'src2' THEN 'heading' WHEN 'src3' THEN 'unknown' END"


@query("d9_select_strategy", f"""
SELECT doc_id, CASE source WHEN 'src1' THEN 'paragraph' WHEN 'src2' THEN 'heading' ELSE CASE WHEN lang IN ('en', 'fr') THEN 'legal'
  ELSE 'sliding' END END AS strategy FROM documents""")
def d9(spark, folder):
    return load_table(spark, folder, "documents").select(
        "doc_id", op.select_strategy(F.expr(_CAT), F.expr(_REQ)).alias("strategy"))


_SLID_CHUNKS = _SLIDING_SQL + ", chunks AS (SELECT doc_id, chunk_index, text, words FROM t)"


@query("d10_validate_chunks", _SLIDING_SQL + f"""
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN length({S('text')}) < 10 THEN 'too_small' ELSE 'too_large' END AS reason
FROM t WHERE length({S('text')}) < 10 OR length({S('text')}) > 2400
UNION ALL SELECT doc_id, NULL, 'no_chunks' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)""")
def d10(spark, folder):
    """Checked with a lower limit, so that some chunks break it."""
    docs = st.documents(spark, folder)
    return op.validate_chunks(op.chunk_sliding(docs), docs, limits=op.ChunkLimits(max_chars=1600))


@query("d11_chunk_stats", _SLIDING_SQL + f"""
SELECT doc_id, count(*) AS total_chunks, round(avg(length(text)), 4) AS average_chunk_size, CAST(max(length(text)) AS INTEGER) AS
  largest_chunk, CAST(min(length(text)) AS INTEGER) AS smallest_chunk, round(avg(words), 4) AS average_words,
  CAST(sum({TOK('words')}) AS BIGINT) AS estimated_tokens FROM t GROUP BY doc_id""")
def d11(spark, folder):
    return op.chunk_stats(op.chunk_sliding(st.documents(spark, folder)), ["doc_id"])


@query("d11_chunk_stats_by_source", _SLIDING_SQL + f"""
SELECT source, lang, count(*) AS total_chunks, round(avg(length(t.text)), 4) AS average_chunk_size, CAST(max(length(t.text)) AS INTEGER)
  AS largest_chunk, CAST(min(length(t.text)) AS INTEGER) AS smallest_chunk, round(avg(words), 4) AS average_words,
  CAST(sum({TOK('words')}) AS BIGINT) AS estimated_tokens FROM t JOIN documents d USING (doc_id) GROUP BY source, lang""")
def d11_by_source(spark, folder):
    """Flagship: whitespace cleanup is left out so that chunk texts equal the SQL's."""
    docs = st.documents(spark, folder)
    chunks = op.chunk_sliding(docs).drop("text").join(docs.select("doc_id", "source", "lang"), "doc_id")
    return op.chunk_stats(chunks, ["source", "lang"])


@query("d12_chunk_boundaries", _SLIDING_SQL + f"""
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, 1 AS page_start, 1 AS page_end, CAST(a AS BIGINT) AS char_start,
  CAST(a + length(text) AS BIGINT) AS char_end, concat({S('left(text, 120)')}, CASE WHEN length(text) > 120 THEN '...' ELSE '' END) AS preview
FROM (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS a FROM t)""")
def d12(spark, folder):
    return op.chunk_boundaries(op.chunk_sliding(st.documents(spark, folder)))


@query("d13_overlap_flags", _SLIDING_SQL + """
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, 'General' AS section, chunk_index > 0 AS overlap_previous,
  chunk_index < max(chunk_index) OVER (PARTITION BY doc_id) AS overlap_next FROM t""")
def d13(spark, folder):
    return op.overlap_flags(op.chunk_sliding(st.documents(spark, folder))).select(
        "doc_id", "chunk_index", "section", "overlap_previous", "overlap_next")
