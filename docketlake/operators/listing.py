"""Listings, paging and bulk edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .scale import last_by

# Sort orders of the listings.
DOCUMENT_SORTS = {
    "newest": ("created_at", True), "oldest": ("created_at", False), "filename": ("filename", False),
    "file_size": ("file_size", False), "category": ("category", False),
}
CASE_SORTS = {
    "newest": ("created_at", True), "oldest": ("created_at", False), "title": ("title", False), "priority": ("priority", True),
    "status": ("status", False), "updated": ("updated_at", True), "client": ("client_name", False),
}


def like_any(cols: list[str], text: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def search(df: DataFrame, filters: dict | None = None, text: str | None = None, text_cols: list[str] | None = None,
           tag: str | None = None, tag_col: str = "user_tags", since=None, until=None, date_col: str = "created_at") -> DataFrame:
    """Rows that match all conditions; every condition is a plain predicate the scan can use."""
    for c, v in (filters or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    if tag:
        df = df.filter(F.col(tag_col).ilike(f"%{tag}%"))
    if since is not None:
        df = df.filter(F.col(date_col) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.filter(F.col(date_col) <= F.lit(until).cast("timestamp"))
    if text:
        df = df.filter(like_any(text_cols or [], text))
    return df


def page_of(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 10) -> DataFrame:
    """One page; a bounded top-k (offset + size rows), not a full sort."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_info(df: DataFrame, page_size: int = 10) -> DataFrame:
    """One row with the number of matches and of pages (at least one)."""
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.ceil(n / page_size), F.lit(1)).cast("long").alias("total_pages"))


def sort_order(sorts: dict, name: str, tie: str, favorites_first: bool = False) -> list[Column]:
    c, desc = sorts.get(name, sorts["newest"])
    order = [F.desc("is_favorite")] if favorites_first else []
    return [*order, F.desc(c) if desc else F.asc(c), F.asc(tie)]


def search_cases(cases: DataFrame, owner=None, archived: bool = False, text: str | None = None, status: str | None = None,
                 priority: str | None = None, statuses: list[str] = (), priorities: list[str] = ()) -> DataFrame:
    """``archived`` switches between the two halves; unknown status or priority is ignored."""
    return search(
        cases, {"owner_id": owner, "archived": archived, "status": status if status in statuses else None,
                "priority": priority if priority in priorities else None},
        text, ["title", "case_number", "client_name", "court_name"])


def list_items(items: DataFrame, case=None, kind: str | None = None, kind_col: str = "kind", text: str | None = None,
               text_cols: list[str] | None = None) -> DataFrame:
    """Facts, entities, evidence or claims of a case, optionally of one kind and with a text."""
    return search(items, {"case_id": case, kind_col: kind}, text, text_cols)


def search_timeline(events: DataFrame, text: str, case=None) -> DataFrame:
    """Events of a case (all cases when none is given) with the text in title or description."""
    t = text.lower()
    hit = F.lower("title").contains(t) | F.coalesce(F.lower("description").contains(t), F.lit(False))
    return (events if case is None else events.filter(F.col("case_id") == F.lit(case))).filter(hit)


def search_logs(logs: DataFrame, jobs: DataFrame, user=None, text: str | None = None, level: str | None = None) -> DataFrame:
    """Log rows of a user's jobs."""
    own = jobs.select("job_id", "user_id") if user is None else jobs.filter(F.col("user_id") == F.lit(user)).select("job_id", "user_id")
    return search(logs, {"level": level}, text, ["message"]).join(own, "job_id")


def owner_jobs(jobs: DataFrame, docs: DataFrame, owner=None, kind: str | None = None) -> DataFrame:
    """Jobs of documents that belong to the owner; order them by start, newest first, nulls last."""
    own = docs.select(F.col("doc_id").alias("document_id"), "owner_id", "title")
    return search(jobs, {"job_type": kind}).join(own if owner is None else own.filter(F.col("owner_id") == F.lit(owner)), "document_id")


def recent_documents(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy(F.desc_nulls_last("last_accessed"), F.desc("created_at"), "doc_id").limit(n)


def sessions_with_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    n = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    return sessions.join(n, "session_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def latest_user_message(messages: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    return last_by(messages.filter("role = 'user'"), [session], [turn], [turn, "text"])


def text_preview(c: str | Column, n: int = 1000) -> Column:
    return F.substring(col(c), 1, n)


def raw_vs_clean(raw: DataFrame, cleaned: DataFrame, id: str = "doc_id") -> DataFrame:
    return raw.select(id, F.col("text").alias("raw_text")).join(cleaned.select(id, "cleaned", "report"), id, "left")


def bulk_check(ids: DataFrame, df: DataFrame, owner, id: str = "doc_id") -> DataFrame:
    """Ids a bulk edit may not touch, with the reason.  The batch goes ahead only if this is empty."""
    known = df.select(id, F.col("owner_id").alias("_owner"))
    return ids.select(id).distinct().join(known, id, "left").select(
        id, F.when(F.col("_owner").isNull(), "not_found").when(F.col("_owner") != F.lit(owner), "not_owner").alias("reason")
    ).filter("reason is not null")


def _batch_allowed(df: DataFrame, ids: DataFrame, owner, id: str) -> DataFrame:
    """The ids with a flag whether the whole batch is accepted (one-row join)."""
    verdict = bulk_check(ids, df, owner, id).agg((F.count("*") == 0).alias("_ok"))
    return ids.select(id).distinct().crossJoin(verdict)


def bulk_reassign(df: DataFrame, ids: DataFrame, case, owner, id: str = "doc_id") -> DataFrame:
    """All or nothing: every id must exist and belong to the owner, else nothing changes."""
    batch = _batch_allowed(df, ids, owner, id)
    return df.join(batch, id, "left").withColumn(
        "case_id", F.when(F.coalesce("_ok", F.lit(False)), F.lit(case)).otherwise(F.col("case_id"))).drop("_ok")


def bulk_delete(df: DataFrame, ids: DataFrame, owner, id: str = "doc_id") -> DataFrame:
    return df.join(_batch_allowed(df, ids, owner, id).filter("_ok").select(id), id, "left_anti")


def set_flag(df: DataFrame, ids: DataFrame, column: str, value: Column, id: str) -> DataFrame:
    """Set one column on the given ids: archive, restore, toggle a favorite, replace tags."""
    hit = ids.select(id).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, id, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def tags_to_list(c: str | Column) -> Column:
    """Comma separated text to a list without blanks and empty entries."""
    return F.filter(F.transform(F.split(col(c), ","), lambda t: F.trim(t)), lambda t: t != "")


def tags_to_text(c: str | Column) -> Column:
    return F.array_join(col(c), ",")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; rows with a null key never clash."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def active_version(versions: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The newest version per key, and the number the next one gets."""
    n = versions.groupBy(*keys).agg((F.count("*") + 1).alias("next_version"))
    return last_by(versions, keys, [version]).join(n, keys)


def activate_version(versions: DataFrame, chosen: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Exactly the chosen version of each key is active; keys without a choice stay as they are."""
    pick = chosen.select(*keys, F.col(version).alias("_pick"))
    return versions.join(pick, keys, "left").withColumn(
        "is_active", F.when(F.col("_pick").isNull(), F.col("is_active")).otherwise(F.col(version) == F.col("_pick"))).drop("_pick")


def format_size(c: str | Column) -> Column:
    b = col(c)
    return (
        F.when(b < 1024, F.format_string("%d B", b.cast("long")))
        .when(b < 1024 * 1024, F.format_string("%.1f KB", F.bround(b / 1024, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(b / (1024 * 1024), 1)))
    )
