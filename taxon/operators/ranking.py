"""Top-k reports and previews; ties are broken by key so the answer is repeatable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions.labels import misclassified


def preview(df: DataFrame, key: str, rows: int = 3) -> DataFrame:
    return df.orderBy(key).limit(rows)


def most_and_least_confident(df: DataFrame, k: int = 10, key: str = "item", confidence: str = "confidence") -> DataFrame:
    """The k surest and the k least sure predictions."""
    columns = [key, "predicted_label", confidence]
    most = df.select(*columns).orderBy(F.desc(confidence), key).limit(k).withColumn("side", F.lit("most"))
    least = df.select(*columns).orderBy(F.asc(confidence), key).limit(k).withColumn("side", F.lit("least"))
    return most.unionByName(least)


def least_confident_errors(df: DataFrame, k: int = 10, key: str = "item", confidence: str = "confidence") -> DataFrame:
    return misclassified(df).select(key, "label", "predicted_label", confidence).orderBy(confidence, key).limit(k)


def top_importances(importances: DataFrame, k: int = 20) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
