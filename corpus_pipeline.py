"""From raw documents to packed sequences: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is stored and is the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, language_id, line_dedup, packing, simhash
from flowlens.llm.common import table
from flowlens.session import cut

#: A text whose best language is less likely than this is not taken for text of a known language.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a likely language go; a missing ``lang`` is filled in."""
    found = docs.withColumn("_found", language_id.language(language_id.train(docs), spark))
    found = found.filter((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= MIN_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "_found.lang_pred")).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go, and documents of which nothing is left; ``n_chars`` follows the text."""
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose fingerprints of four-word shingles are linked by four or fewer differing bits."""
    return simhash.keep_one(docs, simhash.MAX_BITS, simhash.SHINGLE)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("packing", pack_sequences),
]

#: Not expressible in SQL (learned language model, tokenizer); tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
