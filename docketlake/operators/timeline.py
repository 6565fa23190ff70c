"""Dated events: extraction, merging of duplicates, linking, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import col, first_regex, rounded, sentences, words
from ..session import cut_lineage
from .metrics import bundle
from .scale import containing, next_row


def normalize_date(raw: str | Column) -> Column:
    """d/m/y (two-digit years are 20xx), y-m-d, or Month d, yyyy; null when impossible."""
    c = F.trim(F.regexp_replace(col(raw), r"\s+", " "))

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("int")

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0))

    dmy = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})"
    ymd = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    named = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    year = part(dmy, 3)
    year = F.when(year < 100, year + 2000).otherwise(year)
    name = F.lower(F.substring(F.regexp_extract(c, named, 1), 1, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in rules.MONTHS]), name).cast("int")
    month = F.when(month == 0, 1).otherwise(month)
    return F.coalesce(
        made(year, part(dmy, 2), part(dmy, 1)),
        made(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
        F.when(c.rlike(named), made(part(named, 3), month, part(named, 2))),
    )


def event_category(sentence: str | Column) -> Column:
    return first_regex(F.lower(col(sentence)), rules.EVENT_CATEGORIES, "general")


def event_title(sentence: str | Column) -> Column:
    """The first six words, with dots when there are more."""
    w = words(sentence)
    return F.when(F.size(w) > 6, F.concat(F.array_join(F.slice(w, 1, 6), " "), F.lit("..."))).otherwise(col(sentence))


def extract_events(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """One event per sentence with a readable date (the first one counts)."""
    keep = [c for c in ("case_id", "doc_id", "page_start") if c in chunks.columns]
    found = F.when(F.col("sentence").rlike("[0-9]"), F.regexp_extract("sentence", rules.DATE_PATTERN, 1)).otherwise("")  # all dates hold a digit
    return (
        chunks.select(*keep, id, F.posexplode(sentences("text")).alias("position", "sentence"))
        .withColumn("original_date", found).filter("original_date <> ''")
        .withColumn("event_date", normalize_date("original_date")).filter("event_date is not null")
        .select(*keep, id, "position", event_title("sentence").alias("title"), F.col("sentence").alias("description"), "event_date",
                "original_date", event_category("sentence").alias("event_type"), F.lit(rules.EVENT_CONFIDENCE).alias("confidence"))
    )


def _title_key(title: Column) -> Column:
    w = words(F.lower(title))
    return F.array_join(F.slice(w, 1, 2), " ")


def merge_duplicate_events(events: DataFrame, by: str = "case_id", id: str = "event_id") -> DataFrame:
    """One row per (case, day, first two title words): the event with the smallest id.

    Undated events stay as they are.  ``merged`` counts the rows behind each event.  The
    aggregate combines copies before the shuffle.
    """
    keyed = events.withColumn("day", F.to_date("event_date")).withColumn("title_key", _title_key(F.col("title")))
    dated = keyed.filter("day is not null")
    cols = [c for c in events.columns if c != by]
    first = dated.groupBy(by, "day", "title_key").agg(
        F.min_by(F.struct(*cols), F.struct("event_date", id)).alias("e"), F.count("*").alias("merged")).select(by, "e.*", "merged")
    return first.unionByName(events.filter("event_date is null").withColumn("merged", F.lit(1).cast("long")))


def merged_notes(events: DataFrame, by: str = "case_id", id: str = "event_id") -> DataFrame:
    """The descriptions a merge appends to the kept event, one row each, in order of their event.

    A description is appended unless an earlier one of the group contains it.  Containment
    is transitive, so it suffices to ask for *any* earlier description.  Candidates meet on
    the rarest six-character piece of the contained text, not pairwise.
    """
    g = [by, "day", "title_key"]
    keyed = events.filter("event_date is not null and coalesce(description, '') <> ''").select(
        by, id, "event_date", "description", F.to_date("event_date").alias("day"), _title_key(F.col("title")).alias("title_key"))
    texts = keyed.groupBy(*g, "description").agg(F.min(F.struct("event_date", id)).alias("ord"))
    several = texts.groupBy(*g).agg(F.count("*").alias("n"), F.min("ord").alias("head")).filter("n > 1").drop("n")
    texts = cut_lineage(texts.join(several.hint("merge"), g).withColumn("tid", F.col(f"ord.{id}")))  # read five times below
    later = texts.filter(F.col("ord") > F.col("head"))
    pairs = containing(later.select(*g, F.col("tid").alias("nid"), F.col("description").alias("text")),
                       texts.select(*g, F.col("tid").alias("hid"), F.col("description").alias("text")), g)
    side = lambda p: texts.select(*g, F.col("tid").alias(f"{p}id"), F.col("ord").alias(f"{p}_ord")).hint("merge")
    contained = (
        pairs.filter("nid <> hid").join(side("h"), [*g, "hid"]).join(side("n"), [*g, "nid"])
        .filter(F.col("h_ord") < F.col("n_ord")).select(*g, F.col("nid").alias("tid")).distinct()
    )
    return later.join(contained.hint("merge"), [*g, "tid"], "left_anti").select(
        by, "day", "title_key", F.col(f"head.{id}").alias(id), F.col("tid").alias("note_id"), F.col("description").alias("note"))


def link_events(events: DataFrame, by: str = "case_id", days: int = rules.LINK_DAYS, id: str = "event_id") -> DataFrame:
    """Edge from each event to the next one of its case when at most ``days`` apart."""
    slim = events.filter("event_date is not null").select(by, id, "event_date")
    linked = next_row(slim, [by], ["event_date", id], [id, "event_date"])
    gap = F.unix_micros("next.event_date") - F.unix_micros("event_date")
    return linked.filter(gap <= days * 86_400_000_000).select(
        by, F.col(id).alias("parent_id"), F.col(f"next.{id}").alias("child_id"), F.lit("sequential_stage").alias("type"))


def case_timeline(events: DataFrame, edges: DataFrame, event_type: str | None = None, min_confidence: float | None = None,
                  id: str = "event_id") -> DataFrame:
    """Events with their linked events, one row per link (null without any)."""
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    if min_confidence is not None:
        events = events.filter(F.col("confidence") >= min_confidence)
    links = edges.select(F.col("parent_id").alias(id), "child_id")
    return events.join(links, id, "left").withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)))


def timeline_stats(events: DataFrame, by: list[str]) -> DataFrame:
    c = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    span = F.when(F.count("event_date") >= 2, F.floor(
        (F.unix_micros(F.max("event_date")) - F.unix_micros(F.min("event_date"))) / 86_400_000_000)).otherwise(0)
    kind = F.coalesce(F.nullif("event_type", F.lit("")), F.lit("general"))
    return bundle(events, "timeline", cards={
        "total_events": (F.count("*"), "events"), "average_confidence": (rounded(F.avg(c), 2), "score"), "timeline_span_days": (span, "days")},
        groups={"category_breakdown": kind}, by=by)


def rebuild_timeline(chunks: DataFrame, by: str = "case_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, edges, notes) of all cases from their chunks; notes are what merged events said besides."""
    found = extract_events(chunks).withColumn("event_id", F.concat_ws("/", "chunk_id", F.lpad(F.col("position").cast("string"), 6, "0")))
    events = merge_duplicate_events(found, by)
    return events, link_events(events, by), merged_notes(found, by)
