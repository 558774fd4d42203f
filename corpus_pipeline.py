"""A corpus pipeline of five stages; each works on all documents that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.llm import bpe, near_dedup, quality_rules, source_mixing, substring_dedup
from evimap.llm.common import kept_table
from evimap.llm.queries import WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    Each row is judged by its own text, so repeated rows stay or go together; null and
    empty texts fail the base rules. An empty table stays empty. Columns named like the
    judge's own are carried under other names.
    """
    trees = quality_rules.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    carried = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in carried.items()))
    judged = quality_rules.judge(rows, trees, id_col=carried["doc_id"], text=carried["text"], carried=tuple(carried.values()))
    return judged.where("kept").select(*(F.col(n).alias(c) for c, n in carried.items()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies; rows with a null id stay, repeated rows are one."""
    return near_dedup.deduplicate(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that a document of a smaller id has; texts of which nothing is left go, other null and empty ones stay."""
    return substring_dedup.deduplicate(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, in random order; a null source counts as one without a weight."""
    return source_mixing.mix(docs, WEIGHTS, copy_col="__copy_of").drop("__copy_of").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text; a null text is an empty one.

    The ids are kept before they are decoded: one task would otherwise feed two Python workers at once, and hold the batches of both.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.decode(kept_table(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), "bpe-ids"), path)
    return both.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), "token_ids")


STAGES = [
    ("quality_rules", keep_quality), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages),
    ("source_mixing", mix_sources), ("bpe", encode),
]

#: boosted trees, near copies and merges are beyond SQL; tests/llm holds near_dedup and substring_dedup against brute force, not the other stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
