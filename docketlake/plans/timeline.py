"""Queries over dated events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import timeline as op
from . import standins as st
from .registry import query
from .sqltext import CASE_REGEX, SENT

D = st.duck


def date_sql(c: str) -> str:
    """The first readable form of a raw date, or NULL."""
    ex = lambda p, i: f"TRY_CAST(regexp_extract({c}, '{p}', {i}) AS INT)"
    dmy, ymd, nam = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    day = lambda y, m, d: f"TRY_CAST(concat(lpad(CAST({y} AS VARCHAR), 4, '0'), '-', {m}, '-', {d}) AS DATE)"
    y = f"CASE WHEN {ex(dmy, 3)} < 100 THEN {ex(dmy, 3)} + 2000 ELSE {ex(dmy, 3)} END"
    month = f"CASE lower(left(regexp_extract({c}, '{nam}', 1), 3)) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(rules.MONTHS, 1)) + " ELSE 1 END"
    return f"coalesce({day(y, ex(dmy, 2), ex(dmy, 1))}, {day(ex(ymd, 1), ex(ymd, 2), ex(ymd, 3))}, CASE WHEN regexp_matches({c}, '{nam}') THEN {day(ex(nam, 3), month, ex(nam, 2))} END)"


_EVENTS_SQL = f"""w AS (SELECT doc_id, source AS case_id, {st.LEGAL_TEXT} AS text FROM documents),
s AS (SELECT doc_id, case_id, unnest({SENT('text')}) AS sentence, generate_subscripts({SENT('text')}, 1) - 1 AS position FROM w),
o AS (SELECT *, regexp_extract(sentence, '{rules.DATE_PATTERN}', 1) AS original_date FROM s),
ev AS (SELECT *, {date_sql('original_date')} AS event_date FROM o WHERE original_date <> ''),
x AS (SELECT *, regexp_extract_all(sentence, '\\S+') AS ws, {CASE_REGEX('lower(sentence)', rules.EVENT_CATEGORIES, 'general')} AS event_type FROM ev WHERE event_date IS NOT NULL)"""


def legal_chunks(spark, folder):
    return st.documents(spark, folder, st.LEGAL_TEXT).select("doc_id", F.col("source").alias("case_id"), F.col("doc_id").alias("chunk_id"),
                                                             F.lit(1).alias("page_start"), "text")


@query("f1_extract_events", f"""WITH {_EVENTS_SQL} SELECT case_id, doc_id, position, CASE WHEN len(ws) > 6 THEN concat(array_to_string(ws[1:6], ' '), '...') ELSE sentence END AS title,
  md5(sentence) AS digest, strftime(event_date, '%Y-%m-%d') AS event_date, original_date, event_type, 0.85::DOUBLE AS confidence FROM x""")
def f1(spark, folder):
    return op.extract_events(legal_chunks(spark, folder)).select(
        "case_id", "doc_id", "position", "title", F.md5("description").alias("digest"), F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        "original_date", "event_type", "confidence")


_RAW = ("CASE event_id % 6 WHEN 0 THEN concat(user_id % 40, '/', event_id % 15, '/', 1990 + event_id % 40) WHEN 1 THEN concat(1990 + user_id % 40, '-', event_id % 14, '-', user_id % 33) "
        "WHEN 2 THEN concat('October ', user_id % 33, ', ', 2000 + event_id % 30) WHEN 3 THEN concat(1 + user_id % 28, '.', 1 + event_id % 12, '.', 10 + user_id % 80) "
        "WHEN 4 THEN concat('Feb  ', user_id % 31, ' 2023') ELSE 'no date' END")


@query("f2_normalize_date", f"""SELECT event_id, strftime({date_sql("regexp_replace(raw, '\\s+', ' ', 'g')")}, '%Y-%m-%d') AS day FROM (SELECT event_id, {_RAW} AS raw FROM events)""")
def f2(spark, folder):
    df = st.rows(spark, folder, f"SELECT event_id, {_RAW} AS raw FROM {{events}}")
    return df.select("event_id", F.date_format(op.normalize_date("raw"), "yyyy-MM-dd").alias("day"))


@query("f3_event_category", f"""WITH w AS (SELECT doc_id, {st.LEGAL_TEXT} AS text FROM documents), s AS (SELECT unnest({SENT('text')}) AS s FROM w)
SELECT {CASE_REGEX('lower(s)', rules.EVENT_CATEGORIES, 'general')} AS category, count(*) AS sentences FROM s GROUP BY 1""")
def f3(spark, folder):
    s = st.documents(spark, folder, st.LEGAL_TEXT).select(F.explode(op.sentences("text")).alias("s"))
    return s.groupBy(op.event_category("s").alias("category")).agg(F.count("*").alias("sentences"))


# Orders as case events: 40 cases, few titles per day, and short descriptions that contain one another.
CASE_EVENTS = """SELECT o_orderkey AS event_id, o_custkey % 40 AS case_id, CASE WHEN o_custkey % 97 = 5 THEN NULL ELSE date_trunc('month', o_orderdate) END AS event_date,
  concat(o_orderpriority, ' hearing') AS title, concat('Notice ', CASE WHEN o_orderkey % 3 = 0 THEN 'not ' ELSE '' END, 'served on party ', o_custkey % 23) AS description,
  CASE o_orderstatus WHEN 'O' THEN 'court' WHEN 'F' THEN 'civil' ELSE '' END AS event_type, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence FROM {orders}"""
_CE = f"ce AS ({D(CASE_EVENTS)})"
_KEY = "array_to_string(regexp_extract_all(lower(title), '\\S+')[1:2], ' ')"


@query("f4_merge_duplicate_events", f"""WITH {_CE} SELECT case_id, strftime(min(event_date), '%Y-%m-%d') AS day, arg_min(title, event_id) AS title, min(event_id) AS event_id, count(*) AS merged FROM ce
WHERE event_date IS NOT NULL GROUP BY case_id, event_date, {_KEY} UNION ALL SELECT case_id, NULL, title, event_id, 1 FROM ce WHERE event_date IS NULL""")
def f4(spark, folder):
    return op.merge_duplicate_events(st.rows(spark, folder, CASE_EVENTS)).select(
        "case_id", F.date_format("event_date", "yyyy-MM-dd").alias("day"), "title", "event_id", "merged")


@query("f4_merged_notes", f"""WITH {_CE}, t AS (SELECT case_id, event_date, {_KEY} AS k, description, min(event_id) AS note_id FROM ce WHERE event_date IS NOT NULL GROUP BY 1, 2, 3, 4),
h AS (SELECT *, min(note_id) OVER (PARTITION BY case_id, event_date, k) AS event_id FROM t)
SELECT case_id, event_id, note_id, description AS note FROM h WHERE note_id > event_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = h.case_id AND t.event_date = h.event_date AND t.k = h.k
  AND t.note_id < h.note_id AND contains(t.description, h.description))""")
def f4_notes(spark, folder):
    return op.merged_notes(st.rows(spark, folder, CASE_EVENTS)).select("case_id", "event_id", "note_id", "note")


_LINKS = """ln AS (SELECT case_id, event_id AS parent_id, lead(event_id) OVER v AS child_id, lead(event_date) OVER v - event_date AS gap FROM ce WHERE event_date IS NOT NULL
  WINDOW v AS (PARTITION BY case_id ORDER BY event_date, event_id))"""


@query("f5_link_events", f"WITH {_CE}, {_LINKS} SELECT case_id, parent_id, child_id, 'sequential_stage' AS type FROM ln WHERE gap <= INTERVAL 60 DAY")
def f5(spark, folder):
    return op.link_events(st.rows(spark, folder, CASE_EVENTS))


@query("f6_case_timeline", f"""WITH {_CE}, {_LINKS}, e AS (SELECT parent_id, child_id FROM ln WHERE gap <= INTERVAL 60 DAY)
SELECT event_id, case_id, child_id, coalesce(nullif(confidence, 0), 1) AS confidence FROM ce LEFT JOIN e ON e.parent_id = ce.event_id WHERE event_type = 'court' AND confidence >= 0.3""")
def f6(spark, folder):
    events = st.rows(spark, folder, CASE_EVENTS)
    return op.case_timeline(events, op.link_events(events), "court", 0.3).select("event_id", "case_id", "child_id", "confidence")


_CONF = "coalesce(nullif(confidence, 0), 1)"


@query("f7_timeline_stats", f"""WITH {_CE}
SELECT case_id, 'timeline' AS category, 'metrics' AS section, 'total_events' AS label, count(*)::DOUBLE AS value, 'events' AS unit FROM ce GROUP BY case_id
UNION ALL SELECT case_id, 'timeline', 'metrics', 'average_confidence', round(avg({_CONF}), 2), 'score' FROM ce GROUP BY case_id
UNION ALL SELECT case_id, 'timeline', 'metrics', 'timeline_span_days', CASE WHEN count(event_date) >= 2 THEN date_diff('day', min(event_date), max(event_date)) ELSE 0 END, 'days' FROM ce GROUP BY case_id
UNION ALL SELECT case_id, 'timeline', 'category_breakdown', coalesce(nullif(event_type, ''), 'general'), count(*), 'count' FROM ce GROUP BY case_id, 4""")
def f7(spark, folder):
    return op.timeline_stats(st.rows(spark, folder, CASE_EVENTS), ["case_id"])


@query("f8_rebuild_timeline", f"""WITH {_EVENTS_SQL}, m AS (SELECT case_id, event_date, sentence AS description, concat(doc_id, '/', lpad(CAST(position AS VARCHAR), 6, '0')) AS event_id,
  array_to_string(regexp_extract_all(lower(CASE WHEN len(ws) > 6 THEN concat(array_to_string(ws[1:6], ' '), '...') ELSE sentence END), '\\S+')[1:2], ' ') AS k FROM x),
d AS (SELECT case_id, event_date, k, min(event_id) AS event_id, count(*) AS merged FROM m GROUP BY 1, 2, 3),
l AS (SELECT *, lead(event_date) OVER v - event_date AS gap FROM d WINDOW v AS (PARTITION BY case_id ORDER BY event_date, event_id))
, t AS (SELECT case_id, event_date, k, description, min(event_id) AS id FROM m GROUP BY 1, 2, 3, 4), h AS (SELECT *, min(id) OVER (PARTITION BY case_id, event_date, k) AS head FROM t),
n AS (SELECT case_id, count(*) AS notes FROM h WHERE id > head AND NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = h.case_id AND t.event_date = h.event_date AND t.k = h.k AND t.id < h.id
  AND contains(t.description, h.description)) GROUP BY 1)
SELECT case_id, count(*) AS events, CAST(sum(merged) AS BIGINT) AS found, count(*) FILTER (gap <= 60) AS edges, any_value(coalesce(notes, 0)) AS notes FROM l LEFT JOIN n USING (case_id) GROUP BY case_id""")
def f8(spark, folder):
    events, edges, notes = op.rebuild_timeline(legal_chunks(spark, folder))
    e, n = edges.groupBy("case_id").agg(F.count("*").alias("edges")), notes.groupBy("case_id").agg(F.count("*").alias("notes"))
    return events.groupBy("case_id").agg(F.count("*").alias("events"), F.sum("merged").alias("found")).join(e, "case_id", "left").join(n, "case_id", "left").fillna(0, ["notes"])
