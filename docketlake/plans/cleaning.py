"""Queries over the cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import cleaning as op
from . import standins as st
from .registry import query
from .sqltext import CNT, NL, S, q

DIGEST = "md5(text) AS digest"


def _summary(df, *metrics):
    return df.select("doc_id", *[F.col(m).cast("int").alias(m) for m in metrics], F.md5("text").alias("digest"))


_PUNCT = "".join(c for c, _ in rules.UNICODE_TO_ASCII)
_PUNCT_TO = "".join(t * len(c) for c, t in rules.UNICODE_TO_ASCII)
_TRANSLATE = f"translate(text, '{q(_PUNCT + rules.UNICODE_REMOVED)}', '{q(_PUNCT_TO)}')"


@query("c1_normalize_unicode", f"""
WITH w AS (SELECT doc_id, {st.TYPO_TEXT} AS text FROM documents),
n AS (SELECT doc_id, length(text) AS before, nfc_normalize({_TRANSLATE}) AS text FROM w)
SELECT doc_id, CAST(greatest(before - length(text), 0) AS INTEGER) AS unicode_removed, {DIGEST} FROM n""")
def c1(spark, folder):
    return _summary(op.normalize_unicode(st.documents(spark, folder, st.TYPO_TEXT)), "unicode_removed")


def _citations(x: str) -> str:
    return "(" + " + ".join(CNT(x, p) for p in rules.CITATION_PATTERNS) + ")"


@query("c2_citation_guard", f"""
WITH w AS (SELECT doc_id, {st.MESSY_TEXT} AS text FROM documents),
g AS (SELECT doc_id, {_citations('text')} AS b, {_citations("replace(text, 'SCC', 'S')")} AS a FROM w)
SELECT doc_id, CAST(b AS INTEGER) AS citations_before, CAST(a AS INTEGER) AS citations_after,
  CASE WHEN a <> b THEN concat('Citation count discrepancy detected: ', b, ' before cleaning, ', a, ' after.') END
  AS citation_warning FROM g""")
def c2(spark, folder):
    """Guard over an edit that loses a reporter name."""
    df = op.count_citations(st.documents(spark, folder, st.MESSY_TEXT))
    df = df.withColumn("text", F.replace("text", F.lit("SCC"), F.lit("S")))
    return op.citation_guard(df).select("doc_id", "citations_before", "citations_after", "citation_warning")


def _ocr_sql() -> str:
    ctes, prev = [f"p0 AS (SELECT doc_id, {st.MESSY_TEXT} AS t, 0 AS n FROM documents)"], "p0"
    for i, (pat, one) in enumerate(rules.REPEATED_PUNCTUATION, 1):
        ctes.append(f"p{i} AS (SELECT doc_id, regexp_replace(t, '{pat}', '{one}', 'g') AS t, n + {CNT('t', pat)} AS n FROM {prev})")
        prev = f"p{i}"
    marker = r"regexp_matches(z, '(?i)^---\s*Page\s+\d+\s*---$')"
    noise = rf"(NOT {marker} AND length(z) >= 5 AND regexp_matches(z, '^[_.\-*~=+ ]+$'))"
    opens = f"(NOT {marker} AND (starts_with(z, '| ') OR starts_with(z, '/ ')))"
    closes = f"(NOT {marker} AND (ends_with(z, ' |') OR ends_with(z, ' /')))"
    junk = r"\s+[\\|/_+]\s+"
    return f"""WITH {', '.join(ctes)},
l AS (SELECT doc_id, n, i, x, {S('x')} AS z FROM (SELECT doc_id, n, unnest(string_split(t, {NL})) AS x,
      generate_subscripts(string_split(t, {NL}), 1) AS i FROM {prev})),
m AS (SELECT doc_id, n, i, {noise} AS noise, CAST({noise} AS INT) + CASE WHEN {noise} THEN 0 ELSE CAST({opens} AS INT)
      + CAST({closes} AS INT) END AS fixes, {closes} AS closes, CASE WHEN {opens} THEN
      regexp_replace(regexp_replace(x, '\\| ', ''), '/ ', '') ELSE x END AS y FROM l),
j AS (SELECT doc_id, any_value(n) + sum(fixes) AS n, string_agg(CASE WHEN closes THEN
      regexp_replace(left(y, length(y) - 2), '\\s+$', '') ELSE y END, {NL} ORDER BY i) FILTER (NOT noise) AS t
      FROM m GROUP BY doc_id)
SELECT doc_id, CAST(n + {CNT('t', junk)} AS INTEGER) AS ocr_repairs, md5(regexp_replace(t, '{junk}', ' ', 'g')) AS digest
FROM j"""


@query("c3_clean_ocr_artifacts", _ocr_sql())
def c3(spark, folder):
    return _summary(op.clean_ocr_artifacts(st.documents(spark, folder, st.MESSY_TEXT)), "ocr_repairs")


def _repeating_sql(top: bool) -> str:
    order = "i" if top else "i DESC"
    name = "headers_removed" if top else "footers_removed"
    return f"""
WITH w AS (SELECT doc_id, {st.PAGED_TEXT} AS text FROM documents),
p AS (SELECT doc_id, pg, regexp_extract(body, '^ \\d+ ---') AS tail, regexp_replace(body, '^ \\d+ ---', '') AS body FROM
  (SELECT doc_id, unnest(string_split(text, '--- Page')[2:]) AS body,
          generate_subscripts(string_split(text, '--- Page')[2:], 1) AS pg FROM w)),
l AS (SELECT doc_id, pg, tail, x, i, {S('x')} AS z FROM (SELECT doc_id, pg, tail, unnest(string_split(body, {NL})) AS x,
      generate_subscripts(string_split(body, {NL}), 1) AS i FROM p)),
r AS (SELECT *, CASE WHEN z <> '' THEN sum(CAST(z <> '' AS INT)) OVER (PARTITION BY doc_id, pg ORDER BY {order}) END AS k FROM l),
c AS (SELECT doc_id, count(DISTINCT pg) AS pages FROM p GROUP BY doc_id),
h AS (SELECT doc_id, z FROM r JOIN c USING (doc_id) WHERE k <= 3 AND length(z) >= 5 GROUP BY doc_id, z, pages
      HAVING count(*) >= greatest(2, CAST(trunc(pages * 0.3) AS INT))),
d AS (SELECT r.*, h.z IS NOT NULL AND k <= 4 AS gone FROM r LEFT JOIN h ON h.doc_id = r.doc_id AND h.z = r.z),
b AS (SELECT doc_id, pg, concat('--- Page', any_value(tail), coalesce(string_agg(x, {NL} ORDER BY i) FILTER (NOT gone), ''))
      AS t, sum(CAST(gone AS INT)) AS n FROM d GROUP BY doc_id, pg)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS {name}, md5(string_agg(t, '' ORDER BY pg)) AS digest FROM b GROUP BY doc_id"""


@query("c4_remove_repeating_headers", _repeating_sql(True))
def c4(spark, folder):
    return _summary(op.remove_repeating_headers(st.documents(spark, folder, st.PAGED_TEXT)), "headers_removed")


@query("c5_remove_repeating_footers", _repeating_sql(False))
def c5(spark, folder):
    return _summary(op.remove_repeating_footers(st.documents(spark, folder, st.PAGED_TEXT)), "footers_removed")


@query("c6_remove_page_numbers", f"""
WITH w AS (SELECT doc_id, {st.PAGED_TEXT} AS text FROM documents),
p AS (SELECT doc_id, pg, regexp_extract(body, '^ \\d+ ---') AS tail, regexp_replace(body, '^ \\d+ ---', '') AS body FROM
  (SELECT doc_id, unnest(string_split(text, '--- Page')[2:]) AS body,
          generate_subscripts(string_split(text, '--- Page')[2:], 1) AS pg FROM w)),
l AS (SELECT doc_id, pg, tail, x, i, {S('x')} AS z FROM (SELECT doc_id, pg, tail, unnest(string_split(body, {NL})) AS x,
      generate_subscripts(string_split(body, {NL}), 1) AS i FROM p)),
r AS (SELECT *, sum(CAST(z <> '' AS INT)) OVER (PARTITION BY doc_id, pg ORDER BY i) AS a,
      sum(CAST(z <> '' AS INT)) OVER (PARTITION BY doc_id, pg ORDER BY i DESC) AS b,
      regexp_matches(z, '{rules.PAGE_NUMBER_LINE}') AS num FROM l),
b AS (SELECT doc_id, pg, concat('--- Page', any_value(tail), string_agg(CASE WHEN num AND (a <= 3 OR b <= 3) THEN '' ELSE x
      END, {NL} ORDER BY i)) AS t, sum(CASE WHEN num THEN CAST(a <= 3 AS INT) + CAST(b <= 3 AS INT) ELSE 0 END) AS n
      FROM r GROUP BY doc_id, pg)
SELECT doc_id, CAST(sum(n) AS INTEGER) AS page_numbers_removed, md5(string_agg(t, '' ORDER BY pg)) AS digest
FROM b GROUP BY doc_id""")
def c6(spark, folder):
    return _summary(op.remove_page_numbers(st.documents(spark, folder, st.PAGED_TEXT)), "page_numbers_removed")


_HYPHEN = (r"\b(?:((?i:" + "|".join(rules.HYPHEN_PREFIXES) + r"))(-)|([a-zA-Z]+)-)\s*\n\s*([a-zA-Z]+)")


@query("c7_repair_hyphenation", f"""
WITH w AS (SELECT doc_id, {st.MESSY_TEXT} AS text FROM documents)
SELECT doc_id, CAST({CNT('text', _HYPHEN)} AS INTEGER) AS hyphen_repairs,
  md5(regexp_replace(text, '{_HYPHEN}', '\\1\\2\\3\\4', 'g')) AS digest FROM w""")
def c7(spark, folder):
    return _summary(op.repair_hyphenation(st.documents(spark, folder, st.MESSY_TEXT)), "hyphen_repairs")


_WRAP = f"""
WITH w AS (SELECT doc_id, concat({st.PARAGRAPH_TEXT}, chr(10), 'SECTION heading', chr(10), 'ALL CAPS', chr(10), 'ends with:',
  chr(10), 'kept line', chr(10), 'joined', chr(10), '(a) item') AS text FROM documents),
p AS (SELECT doc_id, length(text) - length(replace(text, {NL}, '')) AS before, unnest(string_split(text, {NL} || {NL})) AS par,
  generate_subscripts(string_split(text, {NL} || {NL}), 1) AS pi FROM w),
l AS (SELECT doc_id, before, pi, unnest(string_split(par, {NL})) AS x, generate_subscripts(string_split(par, {NL}), 1) AS i FROM p),
n AS (SELECT *, {S('x')} AS own, lag({S('x')}) OVER v AS prev, lead({S('x')}) OVER v AS nxt FROM l
  WINDOW v AS (PARTITION BY doc_id, pi ORDER BY i)),
k AS (SELECT *, CASE
  WHEN own = '' AND nxt <> '' THEN ''
  WHEN own = '' THEN CASE WHEN i = 1 THEN x ELSE {NL} || x END
  WHEN i = 1 THEN x
  WHEN prev = '' THEN CASE WHEN i = 2 THEN x ELSE {NL} || x END
  WHEN regexp_matches(x, '{rules.LIST_LINE}') OR regexp_matches(x, '{rules.LEGAL_LINE}')
    OR (regexp_matches(own, '\\p{{Lu}}') AND NOT regexp_matches(own, '\\p{{Ll}}') AND length(own) > 3)
    OR ends_with(prev, ':') THEN {NL} || x
  WHEN NOT regexp_matches(prev, '[.?!]$') OR regexp_matches(own, '^\\p{{Ll}}') THEN ' ' || own
  ELSE {NL} || x END AS piece FROM n),
j AS (SELECT doc_id, before, pi, string_agg(piece, '' ORDER BY i) AS par FROM k GROUP BY doc_id, before, pi),
t AS (SELECT doc_id, before, string_agg(par, {NL} || {NL} ORDER BY pi) AS text FROM j GROUP BY doc_id, before)
SELECT doc_id, CAST(before - (length(text) - length(replace(text, {NL}, ''))) AS INTEGER) AS lines_joined, {DIGEST} FROM t"""


@query("c8_repair_line_wraps", _WRAP)
def c8(spark, folder):
    text = (f"concat({st.PARAGRAPH_TEXT}, chr(10), 'SECTION heading', chr(10), 'ALL CAPS', chr(10), 'ends with:', chr(10),"
            " 'kept line', chr(10), 'joined', chr(10), '(a) item')")
    return _summary(op.repair_line_wraps(st.documents(spark, folder, text)), "lines_joined")


_NUM = (r"^(\s*)(\(\s*[a-zA-Z0-9]+\s*\)|[a-zA-Z0-9]+\s*[.)])\s{2,}(.+)$")
_BUL = r"^(\s*)[-*o]\s+(.+)$"


@query("c9_normalize_bullets", f"""
WITH w AS (SELECT doc_id, {st.MESSY_TEXT} AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS x, generate_subscripts(string_split(text, {NL}), 1) AS i FROM w),
k AS (SELECT doc_id, i, regexp_matches(x, '{_BUL}') AS b, regexp_matches(x, '{_NUM}') AS m, x FROM l)
SELECT doc_id, CAST(sum(CAST(b OR m AS INT)) AS INTEGER) AS bullets_normalized, md5(string_agg(CASE
  WHEN b THEN regexp_replace(x, '{_BUL}', '\\1• \\2')
  WHEN m THEN concat(regexp_extract(x, '{_NUM}', 1), regexp_extract(x, '{_NUM}', 2), ' ', {S(f"regexp_extract(x, '{_NUM}', 3)")})
  ELSE x END, {NL} ORDER BY i)) AS digest FROM k GROUP BY doc_id""")
def c9(spark, folder):
    return _summary(op.normalize_bullets(st.documents(spark, folder, st.MESSY_TEXT)), "bullets_normalized")


_TABLE_TEXT = st.lines("text", "'| Name | Age | City |'", "'|---|---|---|'", "'| John | 30 | |'", "'| Mary | - | Delhi | extra |'",
                       "'|'", "'after | single'", "'end'")


@query("c10_flatten_tables", f"""
WITH w AS (SELECT doc_id, {_TABLE_TEXT} AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, {NL})) AS x, generate_subscripts(string_split(text, {NL}), 1) AS i FROM w),
k AS (SELECT *, contains(x, '|') AND {S('x')} <> '|' AS t FROM l),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS isl FROM k),
cells AS (SELECT doc_id, isl, i, list_transform(string_split(x, '|'), lambda z: {S('z')}) AS c FROM g
  WHERE t AND NOT regexp_matches({S('x')}, '^\\|?\\s*[-=:\\s|]+\\s*\\|?$')),
c1 AS (SELECT doc_id, isl, i, CASE WHEN c[1] = '' THEN c[2:] ELSE c END AS c FROM cells),
c2 AS (SELECT doc_id, isl, i, CASE WHEN len(c) > 0 AND c[-1] = '' THEN c[:-2] ELSE c END AS c FROM c1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY i) - 1 AS rn, first_value(c) OVER (PARTITION BY doc_id, isl
  ORDER BY i) AS h FROM c2 WHERE len(list_filter(c, lambda z: z <> '')) > 0),
f AS (SELECT doc_id, isl, string_agg(concat('Row ', rn, ':', {NL}, list_aggregate(list_transform(c, lambda z, k: concat('  ',
  CASE WHEN k <= len(h) THEN h[k] ELSE concat('Column ', k) END, ': ', CASE WHEN z IN ('', '-') THEN '—' ELSE z END)), 'string_agg', {NL}),
  {NL}), {NL} ORDER BY i) AS t FROM r WHERE rn > 0 GROUP BY doc_id, isl),
b AS (SELECT doc_id, min(i) AS i, CASE WHEN bool_and(t) AND any_value(f.t0) IS NOT NULL THEN concat('--- Table Start ---', {NL},
  any_value(f.t0), {NL}, '--- Table End ---') ELSE string_agg(x, {NL} ORDER BY i) END AS part, bool_and(t) AND any_value(f.t0) IS NOT NULL
  AS flat FROM (SELECT g.*, f.t AS t0 FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.isl = g.isl AND g.t) f GROUP BY doc_id, isl, t)
SELECT doc_id, CAST(sum(CAST(flat AS INT)) AS INTEGER) AS tables_flattened, md5(string_agg(part, {NL} ORDER BY i)) AS digest
FROM b GROUP BY doc_id""")
def c10(spark, folder):
    return _summary(op.flatten_tables(st.documents(spark, folder, _TABLE_TEXT)), "tables_flattened")


_SPACES = "concat('  Word   with  too    many   spaces.  ', chr(10), chr(10), chr(10), chr(10), chr(9), text, '   ', chr(10))"


def _ws(x: str) -> str:
    return S(rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?m)[^\S\n]+$', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("c11_cleanup_whitespace", f"""
WITH w AS (SELECT doc_id, {_SPACES} AS text FROM documents), c AS (SELECT doc_id, length(text) AS b, {_ws('text')} AS text FROM w)
SELECT doc_id, CAST(greatest(b - length(text), 0) AS INTEGER) AS whitespace_removed, {DIGEST} FROM c""")
def c11(spark, folder):
    return _summary(op.cleanup_whitespace(st.documents(spark, folder, _SPACES)), "whitespace_removed")


@query("c12_clean_documents")
def c12(spark, folder):
    """The whole chain over whole texts; counters per category."""
    df = st.documents(spark, folder, st.MESSY_TEXT).withColumn(
        "category", F.when(F.col("lang") == "en", "pdf").otherwise("docx"))
    out = op.clean_documents(df)
    return out.groupBy("category").agg(
        F.count("*").alias("documents"),
        F.sum("report.ocr_repairs").alias("ocr_repairs"),
        F.sum("report.hyphen_repairs").alias("hyphen_repairs"),
        F.sum("report.bullets_normalized").alias("bullets_normalized"),
        F.sum("report.tables_flattened").alias("tables_flattened"),
        F.sum("report.lines_joined").alias("lines_joined"),
        F.sum("report.characters_removed").alias("characters_removed"),
        F.sum(F.size("report.warnings")).alias("warnings"),
        F.sum(F.length("cleaned")).alias("cleaned_chars"),
    )


@query("c13_validate_cleaned", f"""
WITH w AS (SELECT doc_id, concat(text, {NL}, {NL}, 'a', {NL}, {NL}, 'b', {NL}, {NL}) AS o,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ab ' WHEN 2 THEN repeat('x', 5 + length(text) // 20) WHEN 3 THEN text ELSE
  concat(text, {NL}, {NL}) END AS c FROM documents),
m AS (SELECT doc_id, o, c, length({S('o')}) AS lo, length({S('c')}) AS lc FROM w)
SELECT doc_id, CASE WHEN c = '' THEN 'empty' WHEN lo > 0 AND lc < 5 THEN 'too_short'
  WHEN lo > 100 AND lc / lo < 0.2 THEN 'text_loss'
  WHEN len(regexp_extract_all(o, '\\n\\n')) > 2 AND len(regexp_extract_all(c, '\\n\\n')) = 0 THEN 'paragraph_loss' END
  AS reject_reason FROM m""")
def c13(spark, folder):
    """One kind of damage per document, picked by its key."""
    df = st.documents(spark, folder, "concat(text, chr(10), chr(10), 'a', chr(10), chr(10), 'b', chr(10), chr(10))")
    src = F.expr("substring(text, 1, length(text) - 8)")
    df = df.withColumn("src", src).withColumn(
        "cleaned",
        F.expr("CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' ab ' WHEN 2 THEN repeat('x', 5 + length(src) div 20)"
               " WHEN 3 THEN src ELSE concat(src, chr(10), chr(10)) END"))
    return op.validate_cleaned(df).select("doc_id", "reject_reason")
