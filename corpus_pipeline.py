"""A training corpus in five stages: rules, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs. All but the last return the columns of `documents`.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotworks.llm import byte_bpe, decontaminate, near_dup, quality_rules, substring_dup
from slotworks.llm.common import free_name, pin, row_name, without_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep. Each row is judged by its own text, also where its doc_id is null or repeats."""
    name = free_name(docs, "_row")
    named = docs.withColumn(name, row_name("doc_id", "text"))
    verdict = quality_rules.judge(named, _table(spark, sf_dir, "labels"), also=(name,))
    return without_rows(named, verdict.filter(~F.col("kept")), name).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Rows with a null doc_id stay; of rows that repeat a doc_id, each has its own verdict."""
    name = free_name(docs, "_row")
    named = docs.withColumn(name, row_name("doc_id", "text"))
    found = near_dup.near_duplicates(named, also=(name,))
    return without_rows(named, found.filter(~F.col("kept")), name).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller doc_id; n_chars follows the text."""
    cut = substring_dup.cut_repeats(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Rows with a null doc_id are judged too: each goes by a name of its own."""
    name = free_name(docs, "_row")
    named = docs.withColumn(name, row_name("doc_id", "text"))
    return decontaminate.decontaminate(named, _table(spark, sf_dir, "benchmark"), key=name).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document; ids decode to the text's bytes."""
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), codec)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_dup_stage), ("substring_dedup", substring_stage),
          ("decontamination", decontamination_stage), ("byte_bpe", tokens_stage)]

#: Near duplicates, the forest and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
