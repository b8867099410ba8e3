"""Keyed joins. The looked-up side is unique per key; the other side may be skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions.text import entity_id_by_pattern


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a table that is unique per key. Rows with a NULL key match nothing.

    A plain equi-join: Spark broadcasts a side whose size in bytes allows it, and adaptive execution
    splits the partitions of hot and NULL keys.
    """
    return left.join(right, key, how)


def attach_features(items: DataFrame, features: DataFrame, item: str = "item", qid: str = "qid") -> DataFrame:
    """Items with the features of their entity; items without one keep NULLs."""
    return lookup_join(items.withColumn(qid, entity_id_by_pattern(F.col(item))), features, qid)


def evaluation_frame(truth: DataFrame, predictions: DataFrame, key: str = "item") -> DataFrame:
    """True and predicted label side by side; both sides pruned before the join."""
    return lookup_join(
        predictions.select(key, "predicted_label", "confidence"),
        truth.select(key, "name", "label"),
        key,
        "inner",
    )


def unmatched(truth: DataFrame, predictions: DataFrame, key: str = "item") -> DataFrame:
    """Truth rows without a prediction."""
    return lookup_join(truth, predictions.select(key).distinct(), key, "left_anti")


def require_coverage(truth: DataFrame, predictions: DataFrame, key: str = "item") -> DataFrame:
    """Row counts of the match as one row; fails at run time when nothing matched."""
    marked = lookup_join(truth.select(key), predictions.select(key).distinct().withColumn("_hit", F.lit(True)), key)
    counts = marked.agg(F.count(F.lit(1)).alias("truth_rows"), F.count("_hit").alias("matched_rows"))
    checked = F.when(F.col("matched_rows") > 0, F.col("matched_rows")).otherwise(
        F.raise_error(F.lit(f"no {key} occurs in both tables"))
    )
    return counts.select(
        "truth_rows",
        checked.cast("bigint").alias("matched_rows"),
        (F.col("truth_rows") - F.col("matched_rows")).alias("unmatched_rows"),
    )


def enrich_by_name(items: DataFrame, lookup: DataFrame, name: str = "name") -> DataFrame:
    """Attach the lookup entry of the lower-cased name; absent entries read as not found."""
    joined = lookup_join(items.withColumn("key", F.lower(name)), lookup, "key")
    return joined.withColumns(
        {
            "summary": F.coalesce("summary", F.lit("")),
            "found": F.coalesce("found", F.lit(False)),
            "languages": F.coalesce("languages", F.lit(0).cast("bigint")),
        }
    )


def best_entity_per_label(index: DataFrame, label: str, qid: str, rank: str) -> DataFrame:
    """Best-ranked entity of each normalised label, the smallest id when tied.

    A minimum over (rank, id) is combined map-side, so a label shared by very many
    entities never sits in one task the way a window partition would.
    """
    best = F.min(F.struct(F.col(rank), F.col(qid)))
    return index.groupBy(F.lower(label).alias("key")).agg(best.alias("_best")).select("key", F.col(f"_best.{qid}"))


def resolve_names(
    items: DataFrame, index: DataFrame, name: str = "name", label: str = "label", qid: str = "qid", rank: str = "rank"
) -> DataFrame:
    """Entity id of each item's name, best hit only."""
    best = best_entity_per_label(index, label, qid, rank)
    return lookup_join(items.withColumn("key", F.lower(name)), best, "key")


def compare_versions(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """One row: matched rows, mean text length in both versions and how many rows changed.

    Texts are replaced by their length and digest before the join.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.length(text).alias(f"_{name}"), F.md5(text).alias(f"_{name}_digest"))

    joined = lookup_join(side(before, "before"), side(after, "after"), key, "inner")
    return joined.agg(
        F.count(F.lit(1)).alias("matched_rows"),
        F.avg("_before").alias("avg_length_before"),
        F.avg("_after").alias("avg_length_after"),
        F.count_if(F.col("_before_digest") != F.col("_after_digest")).alias("changed_rows"),
    )
