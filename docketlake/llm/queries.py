"""The registered query of each operator, with its production parameters, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, fill_middle, line_dedup, packing, passage_dedup, pii, quality_model, quality_rules, sentencepiece_fst, simhash, substring_dedup, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; pass another path to the operators for another place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@_query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


@_query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@_query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_fst.round_trip(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


ORACLE["op6_exact_dedup"] = exact_dedup.ORACLE


@_query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query
def op9_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passage_dedup.remove_passages(table(spark, folder, "documents"))


@_query
def op10_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.fill_in_middle(table(spark, folder, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE["op11_fill_in_middle"] = fill_middle.ORACLE


@_query
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op12_line_dedup"] = line_dedup.ORACLE


@_query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


ORACLE["op13_collocations"] = collocations.ORACLE
