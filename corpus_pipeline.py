"""A training corpus from raw documents: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxon.llm import apportion, language_mixture, oph_minhash, vector_packing, weak_quality
from taxon.llm.common import held_out, private, written


# Copies are alike from 80 % of their shingles on; a pair at 0.8 shares no band once in 190 million times.
NEAR = oph_minhash.Banding(bands=48, rows=5, percent=80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is known."""
    model = language_mixture.fit_languages(docs.filter(~held_out("doc_id")))
    return language_mixture.keep_identified(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are probably good."""
    return weak_quality.keep_good(docs)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a unique, non-null row key, written so that it stays the same when read again."""
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "keyed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, nulls last, then the row key.

    Groups are formed over rows, so a null or repeated doc_id is a document like any other; rows without
    words form groups of their own and stay. The survivor of a group is found by a combinable minimum.
    """
    row = private("row")
    keyed = with_row_key(docs, row)
    groups = oph_minhash.near_duplicates(keyed, row, "text", NEAR).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(row).alias("c"))
    first = keyed.select(row, "doc_id").join(groups, row).groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(first.select(F.col("first.c").alias(row)), row, "left_semi").drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the mix decides per row (a null or repeated doc_id included)."""
    row = private("row")
    return apportion.repeat_documents(with_row_key(docs, row), key=row).drop(row)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    return vector_packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

# Likelihood estimation, signatures and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
