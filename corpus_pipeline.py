"""A training corpus in five stages: classify, clean, deduplicate, decontaminate, encode.

Each stage gets what the one before it kept, read again from Parquet, and looks at all of it. All but the last return the
columns of documents as they came. A null text counts as empty; other columns may hold anything.

Executor and Python worker each hold the Arrow batches of texts that they exchange, and workers keep the memory of the largest one for the
stages after. So a stage sets the session's spark.sql.execution.arrow.maxRecordsPerBatch to BATCH, unless it is lower.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path

from sparkassay.llm import bpe, decontaminate, line_rules, lsh_forest, quality
from sparkassay.llm.storage import new_path


BATCH = 1000  # rows
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """The stage with batches of at most BATCH rows between Spark and Python; not positive means no bound."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(_BATCH_CONF))
        spark.conf.set(_BATCH_CONF, str(min(rows, BATCH) if rows > 0 else BATCH))
        return stage(spark, docs, sf_dir)

    return bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@small_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


@small_batches
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject, with all their lines."""
    return line_rules.keep_good(docs)


@small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return lsh_forest.keep_one(docs)


@small_batches
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the bytes that they decode to."""
    return bpe.digest(docs, tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", clean),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode),
]

#: The classifier and the similarity search are beyond SQL; tests compare what stages 3 and 4 keep with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again as the next one's input."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
