"""Splitting texts into chunks that know their page and paragraph.

A text is an array of located units (sentences, paragraphs or whole sections), made by column
expressions: no shuffle, and offsets are running sums, so a repeated sentence keeps its own place.
Only which units go together is a left-to-right fold; for it the sizes of the units, not their
texts, pass through one Arrow function.  Chunks, their pages and paragraphs are columns again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import BLANKS, bind, first_regex, lead, prefix_sums, rounded, strip, token_estimate, word_count


@dataclass(frozen=True)
class ChunkLimits:
    max_chars: int = rules.CHUNK_LIMITS["max_chars"]
    max_words: int = rules.CHUNK_LIMITS["max_words"]
    max_tokens: int = rules.CHUNK_LIMITS["max_tokens"]
    overlap_words: int = rules.CHUNK_LIMITS["overlap_words"]
    min_chars: int = rules.CHUNK_LIMITS["min_chars"]


# ---- positions as columns -----------------------------------------------------------------

def _starts(parts: Column, gap: int) -> Column:
    """Offset of each part when parts are laid end to end with a gap."""
    return prefix_sums(F.transform(parts, lambda p: F.length(p) + gap))


def page_offsets(text: str) -> Column:
    """Array of (pos, page) for every page marker; (0, 1) without any."""
    def found(parts: Column) -> Column:
        return F.filter(
            F.arrays_zip(_starts(parts, 0).alias("pos"),
                         F.transform(parts, lambda p: F.regexp_extract(p, r"^--- Page (\d+) ---", 1).try_cast("int")).alias("page")),
            lambda x: x["page"].isNotNull(),
        )

    first = F.array(F.struct(F.lit(0).alias("pos"), F.lit(1).alias("page")))
    marked = bind(F.split(F.col(text), r"(?=--- Page \d+ ---)"), lambda parts: bind(found(parts), lambda f: F.when(F.size(f) > 0, f).otherwise(first)))
    return F.when(F.col(text).contains("--- Page "), marked).otherwise(first)  # most texts hold no marker


def paragraph_starts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, paragraph, pos); paragraphs are separated by an empty line."""
    parts = df.select(id, F.posexplode(F.split(text, "\n\n")).alias("_i", "_p")).select(
        id, (F.col("_i") + 1).alias("paragraph"), F.length("_p").alias("_n"))
    w = W.partitionBy(id).orderBy("paragraph").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(id, "paragraph", F.coalesce(F.sum(F.col("_n") + 2).over(w), F.lit(0)).alias("pos"))


def paragraph_at(text: str, pos: Column) -> Column:
    """Paragraph that starts last at or before the position: separators fully before it, plus one."""
    return F.regexp_count(F.substring(F.col(text), F.lit(1), pos.cast("int")), F.lit("\n\n")) + 1


def paragraph_range(text: str, start: Column, end: Column) -> Column:
    first, last = paragraph_at(text, start), paragraph_at(text, end)
    return F.struct(first.alias("first"), F.greatest(first, last).alias("last"))


def offset_range(offsets: Column, start: Column, end: Column, field: str) -> Column:
    """As-of lookup of both ends: the last offset at or before the position, else the first one."""
    def at(p: Column) -> Column:
        hit = F.filter(offsets, lambda o: o["pos"] <= p)
        return F.coalesce(F.try_element_at(hit, F.lit(-1))[field], F.get(offsets, F.lit(0))[field])

    return F.struct(at(start).alias("first"), F.greatest(at(start), at(end)).alias("last"))


# ---- units ----------------------------------------------------------------------------------

# A unit is packed whole.  Units of one run may share a chunk, joined by ``joiner``; a chunk ends where
# the next unit of its run begins, the last one at ``run_end``.
_FIELDS = ("text", "pos", "words", "chars", "run", "run_end", "joiner", "title")


def _unit(piece: Column, run: Column, run_end: Column, joiner: str, title: Column) -> Column:
    rest = dict(run=run.cast("int"), run_end=run_end.cast("int"), joiner=F.lit(joiner), title=title.cast("string"))
    return F.struct(*[piece[f].alias(f) for f in _FIELDS[:4]], *[v.alias(f) for f, v in rest.items()])


def _piece(raw: Column, at: Column) -> Column:
    """A part of a text without blanks on its ends, and where it then begins."""
    return bind(raw, lambda r: bind(strip(r), lambda s: F.struct(s.alias("text"), (at + F.length(r) - F.length(lead(r))).cast("int").alias("pos"), word_count(s).alias("words"), F.length(s).alias("chars"))))


def _pieces(parts: Column, gap: int, base: Column) -> Column:
    """The parts of a text that are not blank, with their places; ``gap`` characters lie between parts."""
    placed = bind(parts, lambda p: bind(_starts(p, gap), lambda at: F.transform(p, lambda x, i: _piece(x, F.get(at, i) + base))))
    return F.filter(placed, lambda u: u["chars"] > 0)


def _sentences(text: Column, base: Column) -> Column:
    """A sentence ends before a blank that follows ``. ! ?``; the cut takes no characters, so lengths give places."""
    return _pieces(F.split(text, f"(?<=[.!?])(?=[{BLANKS}])"), 0, base)


def _none() -> Column:
    return F.lit(None).cast("string")


def _sliding_units(text: Column, lim: ChunkLimits) -> Column:
    return F.transform(_sentences(text, F.lit(0)), lambda u: _unit(u, F.lit(0), F.lit(0), " ", _none()))


def _too_long(piece: Column, lim: ChunkLimits) -> Column:
    return (piece["chars"] > lim.max_chars) | (piece["words"] > lim.max_words)


def _paragraph_units(text: Column, lim: ChunkLimits) -> Column:
    """Paragraphs; one that is too long is a run of its own sentences and parts the others into runs."""
    def units(found: Column) -> Column:
        long = F.filter(found, lambda u: _too_long(u, lim))

        def runs(b: Column) -> Column:
            def one(u: Column, i: Column) -> Column:
                before = F.get(b["before"], i)
                apart = F.transform(_sentences(u["text"], u["pos"]), lambda v: _unit(v, 2 * before + 1, u["pos"] + u["chars"], " ", _none()))
                end = F.coalesce(F.get(b["long"], before)["pos"], F.length(text))
                return F.when(_too_long(u, lim), apart).otherwise(F.array(_unit(u, 2 * before, end, "\n\n", _none())))

            return F.flatten(F.transform(found, one))

        return bind(F.struct(prefix_sums(F.transform(found, lambda u: _too_long(u, lim).cast("int"))).alias("before"), long.alias("long")), runs)

    return bind(_pieces(F.split(text, "\n\n"), 2, F.lit(0)), units)


def _section_units(text: Column, lim: ChunkLimits, title_of, first_title: str) -> Column:
    """Sections from one title line to the next; one that is too long is a run of its sentences."""
    def titled(b: Column) -> Column:
        lines = F.transform(b["lines"], lambda x, i: F.struct(title_of(strip(x)).alias("title"), F.get(b["at"], i).cast("int").alias("pos")))
        return F.concat(F.array(F.struct(F.lit(first_title).alias("title"), F.lit(0).alias("pos"))), F.filter(lines, lambda x: x["title"].isNotNull()))

    def sections(heads: Column) -> Column:
        def one(h: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1)["pos"], F.length(text))

            def units(p: Column) -> Column:
                last = p["pos"] + p["chars"]
                apart = F.transform(_sentences(p["text"], p["pos"]), lambda v: _unit(v, k, last, " ", h["title"]))
                return F.when(p["chars"] == 0, F.array().cast(apart_type)).when(_too_long(p, lim), apart).otherwise(F.array(_unit(p, k, last, " ", h["title"])))

            return bind(_piece(F.substring(text, h["pos"] + 1, end - h["pos"]), h["pos"]), units)

        return F.flatten(F.transform(heads, one))

    apart_type = "array<struct<text:string,pos:int,words:int,chars:int,run:int,run_end:int,joiner:string,title:string>>"
    split = F.split(text, "\n")
    return bind(bind(split, lambda p: F.struct(p.alias("lines"), _starts(p, 1).alias("at"))), lambda b: bind(titled(b), sections))


def _heading_of(line: Column) -> Column:
    """The title a line is: after one to six ``#``, or a short line in capitals."""
    marked = line.rlike(f"^#{{1,6}}[{BLANKS}]+[^{BLANKS}]")
    capitals = F.length(F.regexp_replace(line, "[^A-Z]", "")) > 3
    shouted = line.rlike(f"^[A-Z0-9{BLANKS}.\\-:]{{4,70}}\\z") & ~line.endswith(".") & capitals
    return F.when(marked, strip(F.regexp_replace(line, f"^#{{1,6}}[{BLANKS}]+", ""))).when(shouted, line)


def _legal_section_of(line: Column) -> Column:
    numbered = F.regexp_replace(line, rules.SECTION_NUMBER.replace(r"\s", f"[{BLANKS}]"), "")
    return F.when(line != "", bind(strip(numbered), lambda x: F.nullif(first_regex(x, rules.LEGAL_SECTIONS, ""), F.lit(""))))


_UNITS = {
    "paragraph": _paragraph_units,
    "sliding": _sliding_units,
    "heading": lambda text, lim: _section_units(text, lim, _heading_of, "Introduction"),
    "legal": lambda text, lim: _section_units(text, lim, _legal_section_of, "Introductory Context"),
}


# ---- the folds ----------------------------------------------------------------------------

def _token_counts(words: np.ndarray) -> np.ndarray:
    return np.maximum((words * 1.33).astype(np.int64), 1)


def _windows(words: np.ndarray, chars: np.ndarray, lim: ChunkLimits) -> Iterator[tuple[int, int]]:
    """Overlapping windows of whole sentences (first, last), found by searching running sums of words and characters."""
    word_sum, char_sum = np.append(0, np.cumsum(words)), np.append(0, np.cumsum(chars))
    begin, n = 0, len(words)
    while begin < n:
        full = min(np.searchsorted(total, total[begin] + most, "right") - 1 for total, most in ((word_sum, lim.max_words), (char_sum, lim.max_chars)))
        # Tokens are rounded per sentence and for the words before it, so their limit may break earlier.
        tokens = _token_counts(words[begin:full]) + _token_counts(word_sum[begin:full] - word_sum[begin])
        over = np.flatnonzero(tokens > lim.max_tokens)
        end = max(begin + int(over[0]) if len(over) else int(full), begin + 1)
        yield begin, end - 1
        if end == n:
            return
        # The next window takes over the last sentences that hold few enough words.
        begin = max(int(np.searchsorted(word_sum, word_sum[end] - lim.overlap_words)), begin + 1)


def _packs(words: np.ndarray, chars: np.ndarray, runs: np.ndarray, joints: np.ndarray, lim: ChunkLimits) -> Iterator[tuple[int, int]]:
    """Greedy packing inside each run (first, last): a unit that would break a limit begins the next chunk."""
    begin, w, c = 0, 0, 0
    for i, (word, char, joint) in enumerate(zip(words.tolist(), chars.tolist(), joints.tolist(), strict=True)):
        grown = c + joint + char
        if i and (runs[i] != runs[i - 1] or grown > lim.max_chars or w + word > lim.max_words or max(int((w + word) * 1.33), 1) > lim.max_tokens):
            yield begin, i - 1
            begin, w, grown = i, 0, char
        elif not i:
            grown = char
        w, c = w + word, grown
    if len(words):
        yield begin, len(words) - 1


def _folding(lim: ChunkLimits):
    def fold(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for kinds, *sizes in batches:
            out = []
            for kind, words, chars, runs, joints in zip(kinds, *sizes, strict=True):
                words, chars = np.asarray(words, np.int64), np.asarray(chars, np.int64)
                found = _windows(words, chars, lim) if kind == "sliding" else _packs(words, chars, np.asarray(runs), np.asarray(joints), lim)
                out.append(np.array(list(found), np.int32).ravel())
            yield pd.Series(out)

    return F.pandas_udf(fold, "array<int>")


_CHUNK_FIELDS = ("section", "text", "page_start", "page_end", "paragraph_start", "paragraph_end", "words", "chars", "tokens")


def _chunk(units: Column, pages: Column, paragraphs: Column, kind: Column, first: Column, last: Column) -> Column:
    """A chunk of the units from ``first`` to ``last`` as a struct of columns."""
    def made(b: Column) -> Column:
        own, head, tail, after = b["own"], b["head"], b["tail"], b["after"]
        text = F.call_function("array_join", F.transform(own, lambda u: u["text"]), head["joiner"])
        packed_end = F.when(after["run"] == head["run"], after["pos"]).otherwise(head["run_end"])
        start, end = head["pos"], F.when(kind == "sliding", tail["pos"] + tail["chars"]).otherwise(packed_end)
        words = F.aggregate(own, F.lit(0), lambda n, u: n + u["words"])
        page = lambda p: F.get(pages, F.greatest(F.size(F.filter(pages, lambda o: o["pos"] <= p)) - 1, F.lit(0)))["page"]
        para = lambda p: F.greatest(F.size(F.filter(paragraphs, lambda at: at <= p)), F.lit(1))

        def whole(x: Column) -> Column:
            values = (head["title"], x["text"], x["p0"], F.greatest(x["p0"], x["p1"]), x["g0"], F.greatest(x["g0"], x["g1"]), x["words"], F.length(x["text"]), token_estimate(x["words"]))
            return F.struct(*[v.alias(n) for n, v in zip(_CHUNK_FIELDS, values, strict=True)])

        return bind(F.struct(text.alias("text"), words.alias("words"), page(start).alias("p0"), page(end).alias("p1"), para(start).alias("g0"), para(end).alias("g1")), whole)

    return bind(F.struct(F.slice(units, first + 1, last - first + 1).alias("own"), F.get(units, first).alias("head"), F.get(units, last).alias("tail"), F.get(units, last + 1).alias("after")), made)


def chunk_documents(df: DataFrame, strategy: str | Column, id: str = "doc_id", text: str = "text",
                    limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """One row per chunk; the strategy may differ per row, all of them in one pass.  Null and empty texts have no chunks."""
    kind, t = F.col("_kind"), F.col("_text")
    rows = df.select(F.col(id).alias("_id"), (F.lit(strategy) if isinstance(strategy, str) else strategy).alias("_kind"), F.col(text).alias("_text")).filter("_text <> ''")
    if isinstance(strategy, str):
        units = _UNITS[strategy](t, limits)
    else:
        units = F.coalesce(*[F.when(kind == name, make(t, limits)) for name, make in _UNITS.items()])
    paragraphs = _starts(F.split(t, "\n\n"), 2)
    located = rows.select("_id", "_kind", units.alias("_units"), page_offsets("_text").alias("_pages"), paragraphs.alias("_paragraphs"))
    size = lambda f: F.transform("_units", lambda u: u[f])
    joints = F.transform("_units", lambda u: F.length(u["joiner"]))
    cut = located.withColumn("_cuts", _folding(limits)(kind, size("words"), size("chars"), size("run"), joints))
    numbers = F.filter(F.sequence(F.lit(0), F.size("_cuts")), lambda k: 2 * k < F.size("_cuts"))
    chunks = F.transform(numbers, lambda k: _chunk(F.col("_units"), F.col("_pages"), F.col("_paragraphs"), kind, F.get("_cuts", 2 * k), F.get("_cuts", 2 * k + 1)))
    out = cut.select("_id", "_kind", F.posexplode(chunks).alias("chunk_index", "_c"))
    return out.select(F.col("_id").alias(id), F.col("_kind").alias("strategy"), "chunk_index", *[F.col(f"_c.{f}") for f in _CHUNK_FIELDS])


def chunk_paragraphs(df: DataFrame, **kw) -> DataFrame:
    return chunk_documents(df, "paragraph", **kw)


def chunk_sliding(df: DataFrame, **kw) -> DataFrame:
    return chunk_documents(df, "sliding", **kw)


def chunk_headings(df: DataFrame, **kw) -> DataFrame:
    return chunk_documents(df, "heading", **kw)


def chunk_legal_sections(df: DataFrame, **kw) -> DataFrame:
    return chunk_documents(df, "legal", **kw)


def select_strategy(category: Column, requested: Column | None = None) -> Column:
    """Requested strategy by name part, else by category: legal kinds, and sliding for the rest."""
    auto = F.when(category.isin(rules.LEGAL_CATEGORIES), "legal").otherwise("sliding")
    if requested is None:
        return auto
    part = F.replace(F.replace(F.lower(requested), F.lit("_"), F.lit("")), F.lit("strategy"), F.lit(""))
    names = [("legal", "legalsectionchunkingstrategy"), ("heading", "headingawarechunkingstrategy"),
             ("sliding", "slidingwindowchunkingstrategy"), ("paragraph", "paragraphchunkingstrategy")]
    asked = F.coalesce(*[F.when(F.contains(F.lit(full), part), label) for label, full in names])
    return F.when(F.coalesce(requested, F.lit("")) == "", auto).otherwise(F.coalesce(asked, auto))


# ---- checks and summaries over a chunk table -------------------------------------------------

def validate_chunks(chunks: DataFrame, documents: DataFrame, id: str = "doc_id",
                    limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """(document, reason) of every rule a chunk breaks; documents without chunks come last.

    A window over one document is bounded by the size of that document.
    """
    w = W.partitionBy(id).orderBy("chunk_index")
    bare = strip("text")
    prev_page = F.coalesce(F.lag("page_start").over(w), F.lit(0))
    prev_para = F.coalesce(F.lag("paragraph_start").over(w), F.lit(0))
    reason = (
        F.when(bare == "", "blank")
        .when((F.length(bare) < limits.min_chars) & (F.length(bare) < 10), "too_small")
        .when(F.length(bare) > limits.max_chars * 1.5, "too_large")
        .when(~F.is_valid_utf8("text"), "invalid_utf8")
        .when((F.col("page_start") < 1) | (F.col("page_end") < 1), "page_below_one")
        .when(F.col("page_start") > F.col("page_end"), "page_range_inverted")
        .when((F.col("paragraph_start") < 1) | (F.col("paragraph_end") < 1), "paragraph_below_one")
        .when(F.col("paragraph_start") > F.col("paragraph_end"), "paragraph_range_inverted")
        .when(F.col("page_start") < F.col("_prev_page"), "page_order")
        .when((F.col("paragraph_start") < F.col("_prev_para")) & (F.col("page_start") == F.col("_prev_page")), "paragraph_order")
    )
    broken = (
        chunks.withColumn("_prev_page", prev_page).withColumn("_prev_para", prev_para)
        .select(id, "chunk_index", reason.alias("reason")).filter("reason is not null")
    )
    empty = documents.join(chunks.select(id).distinct(), id, "left_anti").select(
        id, F.lit(None).cast("int").alias("chunk_index"), F.lit("no_chunks").alias("reason"))
    return broken.unionByName(empty)


def chunk_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        rounded(F.avg("chars"), 4).alias("average_chunk_size"),
        F.max("chars").alias("largest_chunk"),
        F.min("chars").alias("smallest_chunk"),
        rounded(F.avg("words"), 4).alias("average_words"),
        F.sum("tokens").alias("estimated_tokens"),
    )


def chunk_boundaries(chunks: DataFrame, id: str = "doc_id") -> DataFrame:
    """Character positions when chunks are laid end to end with one blank between."""
    w = W.partitionBy(id).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    snippet = F.concat(strip(F.substring("text", 1, 120)), F.when(F.length("text") > 120, "...").otherwise(""))
    return chunks.select(id, "chunk_index", "page_start", "page_end", start.alias("char_start"),
                         (start + F.length("text")).alias("char_end"), snippet.alias("preview"))


def overlap_flags(chunks: DataFrame, id: str = "doc_id") -> DataFrame:
    """Overlap marks for sliding chunks and the default section name."""
    total = F.max("chunk_index").over(W.partitionBy(id))
    sliding = F.col("strategy") == "sliding"
    return (
        chunks.withColumn("section", F.coalesce("section", F.lit("General")))
        .withColumn("overlap_previous", sliding & (F.col("chunk_index") > 0))
        .withColumn("overlap_next", sliding & (F.col("chunk_index") < total))
    )


def token_estimates(df: DataFrame, text: str = "text") -> DataFrame:
    words = F.regexp_count(text, F.lit(r"\S+"))
    return df.withColumn("words", words).withColumn("tokens", token_estimate("words"))
