"""From raw documents to training tokens, in stages that each read what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives a
DataFrame. All but the last return the columns of their documents. ``run`` writes the result
of each stage as Parquet and reads it again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm import bpe, decontamination, near_dedup, quality, substring_dedup
from tidewatt.llm.frames import free_name
from tidewatt.session import staged

REPEATED_WORDS = 50  # a passage of so many words is cut from all documents but the first
BENCHMARK_WORDS = 10
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage may have cut."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.dedup_near(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has."""
    return _measured(substring_dedup.dedup_substrings(docs, window=REPEATED_WORDS))


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go."""
    return _measured(decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), window=BENCHMARK_WORDS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and token_ids."""
    out = bpe.encode(docs, public_tokenizers.path(TOKENIZER))
    tokens = F.col(out.columns[-1])
    return out.select(*docs.columns, tokens["n_tokens"].alias(free_name(docs, "n_tokens")), tokens["ids"].alias(free_name(docs, "token_ids")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_dedup", no_near_copies),
    ("substring_dedup", no_repeated_passages),
    ("decontamination", no_benchmark_passages),
    ("bpe", encoded),
]

#: A trained classifier has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
