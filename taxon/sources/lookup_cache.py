"""Incrementally grown lookup table keyed by lower-cased name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions.text import truncated
from taxon.operators.joins import lookup_join

CACHE_COLUMNS = ["key", "summary", "found", "languages"]


def missing_keys(items: DataFrame, cache: DataFrame, name: str = "name") -> DataFrame:
    """Distinct keys that the cache does not hold; a popular name is looked up once."""
    keys = items.select(F.lower(name).alias("key")).where(F.col("key").isNotNull()).distinct()
    return lookup_join(keys, cache.select("key"), "key", "left_anti")


def resolve(keys: DataFrame, source: DataFrame) -> DataFrame:
    """Cache entries for the keys; one the source does not know is stored as not found."""
    hits = lookup_join(keys, source, "key")
    return hits.select(
        "key",
        F.coalesce(truncated(F.col("summary")), F.lit("")).alias("summary"),
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("languages", F.lit(0)).cast("bigint").alias("languages"),
    )


def append_missing(items: DataFrame, cache_path: str, source: DataFrame, name: str = "name") -> DataFrame:
    """Look up what the stored cache lacks, append it and return the whole cache."""
    spark = items.sparkSession
    cache = spark.read.parquet(cache_path)
    # append adds files next to those being read; nothing read is rewritten
    resolve(missing_keys(items, cache, name), source).write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path).select(*CACHE_COLUMNS)
