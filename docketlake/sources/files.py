"""Reading text files and checking uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import col, strip


def read_text_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files as text.  A UTF-16 mark wins; else valid UTF-8; else Latin-1 with a warning."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return decode_files(reader.load(path))


def decode_files(files: DataFrame) -> DataFrame:
    """Decode a binaryFile frame, batch or stream."""
    content = F.col("content")
    mark = F.hex(F.substring(content, 1, 2))
    utf8 = F.is_valid_utf8(content.cast("string"))
    encoding = F.when(mark.isin("FFFE", "FEFF"), "utf-16").when(utf8, "utf-8").otherwise("latin-1")
    text = (
        F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(utf8, content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
    return files.select(
        "path", text.alias("text"), F.lit("txt").alias("method"), encoding.alias("encoding"),
        F.when(encoding == "latin-1", F.array(F.lit("not valid UTF-8, decoded as Latin-1"))).otherwise(
            F.array().cast("array<string>")).alias("warnings"),
        F.lit(1).alias("page_count"), F.lit(1.0).alias("confidence"), F.col("length").alias("size"),
        F.sha2(content, 256).alias("checksum"))


def extension(c: str | Column) -> Column:
    """Lower case part after the last dot, '' without one."""
    return F.lower(F.regexp_extract(col(c), r"\.([^./?#]*)$", 1))


def detect_mime(path: str | Column, declared: str | Column) -> Column:
    """Declared type unless it says nothing; else by extension."""
    known = F.create_map(*[F.lit(x) for kv in rules.MIME_BY_EXTENSION.items() for x in kv])
    named = F.nullif(col(declared), F.lit(rules.UNKNOWN_MIME))
    return F.coalesce(named, F.try_element_at(known, extension(path)), F.lit(rules.UNKNOWN_MIME))


def detect_category(filename: str | Column, mime: str | Column) -> Column:
    ext, mime = extension(filename), F.coalesce(col(mime), F.lit(""))
    return (
        F.when(ext.isin("doc", "docx") | mime.isin(rules.WORD_MIMES), "word")
        .when((ext == "pdf") | (mime == "application/pdf"), "pdf")
        .when((ext == "txt") | (mime == "text/plain"), "text")
        .when(ext.isin(rules.IMAGE_EXTENSIONS) | mime.startswith("image/"), "image")
        .otherwise("other")
    )


ROUTES = [("txt", ["text/plain"]), ("pdf", ["application/pdf"]), ("docx", rules.WORD_MIMES[:1]), ("image", ["image/png", "image/jpeg", "image/webp"])]


def route_documents(df: DataFrame, mime: str = "mime_type") -> tuple[DataFrame, DataFrame]:
    """(accepted with ``extractor``, rejected): the first extractor that takes the type."""
    label = reduce(lambda acc, r: acc.when(F.col(mime).isin(r[1]), r[0]), ROUTES[1:], F.when(F.col(mime).isin(ROUTES[0][1]), ROUTES[0][0]))
    routed = df.withColumn("extractor", label)
    return routed.filter("extractor is not null"), routed.filter("extractor is null").drop("extractor")


def validate_upload(files: DataFrame, cases: DataFrame, max_bytes: int = rules.MAX_UPLOAD_BYTES) -> DataFrame:
    """One reject reason per row: case, extension, type, size, in this order; null means accepted.

    ``cases`` holds (case_id, owner_id); the join side is picked by its measured size.
    """
    own = cases.select("case_id", "owner_id").distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col("_known").isNull(), "case_not_found")
        .when(~extension("filename").isin(rules.ALLOWED_EXTENSIONS), "extension")
        .when(~F.coalesce("mime_type", F.lit("")).isin(rules.ALLOWED_MIMES), "mime")
        .when(F.col("file_size") > max_bytes, "too_large")
    )
    return files.join(own, ["case_id", "owner_id"], "left").withColumn("reject_reason", reason).drop("_known")


def checksum_duplicates(df: DataFrame, owner: str = "owner_id", id: str = "doc_id", content: str = "text",
                        order: str = "created_at") -> DataFrame:
    """Marks later rows with the same owner and content; ``original`` is the earliest one.

    The earliest row is an aggregate, so a text copied into a third of all rows is combined
    before the shuffle; the join back is a plain equality that AQE may split.
    """
    hashed = df.withColumn("checksum", F.sha2(F.col(content), 256))
    first = hashed.groupBy(owner, "checksum").agg(F.min_by(id, F.struct(order, id)).alias("original"))
    return hashed.join(first, [owner, "checksum"]).withColumn("is_duplicate", F.col(id) != F.col("original"))


def assemble_pages(pages: DataFrame, id: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """One text per document with page markers.  A document's pages fit one row by definition."""
    part = F.concat(F.lit("--- Page "), F.col(page), F.lit(" ---\n\n"), strip(text))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t"))))
    return pages.groupBy(id).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def needs_ocr(text: str | Column, min_chars: int = 100) -> Column:
    """Hardly any text besides the page markers."""
    return F.length(strip(F.regexp_replace(col(text), rules.PAGE_MARKER, ""))) < min_chars


def ocr_confidence(words: DataFrame, doc: str = "doc_id", page: str = "page", word: str = "word", conf: str = "conf") -> DataFrame:
    """Per document the mean of its page means; filled words with a confidence only."""
    good = (strip(word) != "") & (F.col(conf) >= 0)
    pages = words.groupBy(doc, page).agg(F.coalesce(F.avg(F.when(good, F.col(conf))), F.lit(100.0)).alias("c"))
    pages = pages.withColumn("c", F.least(F.greatest(F.col("c") / 100.0, F.lit(0.0)), F.lit(1.0)))
    return pages.groupBy(doc).agg(F.avg("c").alias("confidence"))
