"""Registered queries of the operators, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet")


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


from public_tokenizers import PATTERN  # noqa: E402
from public_tokenizers import path as tokenizer_path  # noqa: E402

from sparkassay.llm import (  # noqa: E402
    best_fit, bpe, decontaminate, fill_middle, fm_spelling, license_scan, line_rules, lsh_forest, page_template, quality,
    token_files, toxicity, url_cascade,
)
from sparkassay.llm.storage import new_path  # noqa: E402


@_query("op1_quality_classifier")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_documents(_load(spark, sf, "documents"), _load(spark, sf, "labels"))


@_query("op2_quality_rules", line_rules.SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return line_rules.measure(_load(spark, sf, "documents"))


@_query("op3_byte_bpe")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest(_load(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


@_query("op4_token_files")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_load(spark, sf, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read(spark, path, "crc")


@_query("op5_url_filters", url_cascade.SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return url_cascade.judge(_load(spark, sf, "pages"))


@_query("op6_jaccard_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.join_classes(_load(spark, sf, "documents"))


@_query("op7_decontamination")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(_load(spark, sf, "documents"), _load(spark, sf, "benchmark"))


@_query("op8_license_scan")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(_load(spark, sf, "documents"))


@_query("op9_page_text")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return page_template.extract(_load(spark, sf, "pages"))


@_query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_documents(_load(spark, sf, "documents"), _load(spark, sf, "labels"))


@_query("op11_best_fit_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return best_fit.pack(_load(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json")).drop("ids")


@_query("op12_fill_in_middle", fill_middle.SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.digest(_load(spark, sf, "documents"))


@_query("op13_spelling_variants")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return fm_spelling.variants(_load(spark, sf, "documents"))
