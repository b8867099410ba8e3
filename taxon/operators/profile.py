"""Distributions and summary statistics of item, feature and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taxon.operators.quantiles import ACCURACY, exact_quantiles


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def class_distribution(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Count and rounded share of each class per split; unlabelled rows are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))
    # the window sees one row per split and class
    total = F.sum("count").over(W.partitionBy(split))
    return counts.select(
        split, label, "count", total.alias("total"), F.round(_pct(F.col("count"), total), 2).alias("pct")
    )


def value_counts(df: DataFrame, column: str = "label") -> DataFrame:
    """Count of each value and its share of all rows, missing values included in the whole."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    # a scalar subquery, as a column may have very many values
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("pct", _pct(F.col("count"), total)).where(F.col(column).isNotNull())


def _per_column(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """Aggregate all columns in one pass, then turn the single row into one row per column."""
    aggregated = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[measure(F.col(c)).alias(f"{c}__{m}") for c in columns for m, measure in measures.items()],
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col("rows"), *[F.col(f"{c}__{m}").alias(m) for m in measures])
        for c in columns
    ]
    return aggregated.select(F.inline(F.array(*rows)))


def numeric_profile(df: DataFrame, columns: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """Mean, median, extremes and non-zero share of each column, one row per column."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stats = _per_column(
        doubles,
        columns,
        {"mean": F.avg, "min": F.min, "max": F.max, "nonzero": lambda c: F.count_if(c != 0)},
    )
    median = exact_quantiles(_long(doubles, columns), "feature", "value", [0.5], accuracy).select("feature", F.col("quantile").alias("median"))
    # one row per column on either side
    return stats.join(F.broadcast(median), "feature", "left").select(
        "feature",
        "mean",
        "median",
        "min",
        "max",
        "nonzero",
        _pct(F.col("nonzero"), F.col("rows")).alias("nonzero_pct"),
    )


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value): one row per row and column."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def boolean_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = _per_column(df, columns, {"true_count": F.count_if})
    false_count = F.col("rows") - F.col("true_count")
    return counts.select(
        "feature",
        "true_count",
        _pct(F.col("true_count"), F.col("rows")).alias("true_pct"),
        false_count.alias("false_count"),
        _pct(false_count, F.col("rows")).alias("false_pct"),
    )


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which each feature is above zero."""
    counts = _per_column(df, columns, {"covered": lambda c: F.count_if(c > 0)})
    return counts.select("feature", "covered", _pct(F.col("covered"), F.col("rows")).alias("covered_pct"))


def feature_means_by_label(df: DataFrame, means: list[str], flags: list[str], label: str = "label") -> DataFrame:
    rows = F.count(F.lit(1))
    return df.groupBy(label).agg(
        rows.alias("rows"),
        *[F.avg(c).alias(f"avg_{c}") for c in means],
        *[F.count_if(F.col(c)).alias(f"with_{c}") for c in flags],
        *[_pct(F.count_if(F.col(c)), rows).alias(f"pct_{c}") for c in flags],
    )


def confidence_stats(df: DataFrame, confidence: str = "confidence", accuracy: int = ACCURACY) -> DataFrame:
    """One row: mean, sample deviation, extremes and exact quartiles."""
    stats = _per_column(df, [confidence], {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quartiles = (
        exact_quantiles(_long(df, [confidence]), "feature", "value", [0.25, 0.5, 0.75], accuracy)
        .groupBy("feature")
        .pivot("prob", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF("feature", "q25", "median", "q75")
    )
    # a single row on either side
    return stats.join(F.broadcast(quartiles), "feature").drop("feature", "rows")


def confidence_stats_population(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.agg(
        F.avg(confidence).alias("mean"),
        F.stddev_pop(confidence).alias("std"),
        F.min(confidence).alias("min"),
        F.max(confidence).alias("max"),
    )


def confidence_by(df: DataFrame, key: str, confidence: str = "confidence") -> DataFrame:
    """Mean, sample deviation and count of the confidence per key."""
    return df.groupBy(key).agg(
        F.avg(confidence).alias("mean"),
        F.stddev_samp(confidence).alias("std"),
        F.count(F.lit(1)).alias("count"),
    )


# Confidence thresholds of the report.
THRESHOLDS = (0.5, 0.6, 0.7, 0.8)


def threshold_sweep(
    df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, confidence: str = "confidence"
) -> DataFrame:
    """Rows strictly below each threshold, all thresholds in one pass."""
    c = F.col(confidence)
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c < t).alias(f"below_{i}") for i, t in enumerate(thresholds)]
    )
    out = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"below_{i}").alias("count"),
            _pct(F.col(f"below_{i}"), F.col("rows")).alias("pct"),
        )
        for i, t in enumerate(thresholds)
    ]
    return row.select(F.inline(F.array(*out)))


def crosstab(df: DataFrame, key: str, predicted: str = "predicted_label") -> DataFrame:
    """Predictions per value of the key; blank keys are left out."""
    return df.where(F.col(key) != "").groupBy(key, predicted).agg(F.count(F.lit(1)).alias("count"))


def top_key_crosstab(df: DataFrame, key: str = "category", predicted: str = "predicted_label", top: int = 10) -> DataFrame:
    """Crosstab over the most frequent keys; a blank among them still takes its place."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key, predicted).agg(F.count(F.lit(1)).alias("count"))
    # from here on a row per key and class; a key's list is as long as there are classes
    leaders = (
        counts.groupBy(key)
        .agg(F.sum("count").alias("total"), F.collect_list(F.struct(predicted, "count")).alias("classes"))
        .orderBy(F.desc("total"), key)
        .limit(top)
    )
    return leaders.where(F.col(key) != "").select(key, "total", F.inline("classes"))


def enrichment_stats(enriched: DataFrame, original: str, description: str, found: str) -> DataFrame:
    """One row: rows, share found and mean text length before and after."""
    rows = F.count(F.lit(1))
    return enriched.agg(
        rows.alias("rows"),
        F.count_if(F.col(found)).alias("found"),
        _pct(F.count_if(F.col(found)), rows).alias("found_pct"),
        F.avg(F.length(original)).alias("avg_length_before"),
        F.avg(F.length(description)).alias("avg_length_after"),
    )


def distribution_wide(df: DataFrame, splits: list[str], split: str = "split", label: str = "label") -> DataFrame:
    """Class shares with one column per split."""
    shares = class_distribution(df, split, label)
    return shares.groupBy(label).pivot(split, splits).agg(F.first("pct")).na.fill(0.0)
