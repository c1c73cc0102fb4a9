"""A corpus from documents to token files, in five stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, mixing, queries, simhash, token_output
from factloom.llm.common import discard, materialize, table

#: Some stages can't be expressed in SQL (a trained model, XXH64, a tokenizer); tests compare them with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with too low a calibrated score for it, go."""
    return language_id.accepted_only(docs, language_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source has its target of words."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary segments, and what can be read back from them; workers that served other stages keep little."""
    found = token_output.write_and_read(docs, queries.tokenizer_path(), kept=50_000, group=1 << 20)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", known_language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again, and deleted once the next one is written."""
    docs, written = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
