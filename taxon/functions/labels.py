"""Labels, class probabilities and flags on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class ids of the fine-tuned model.
LABEL_IDS = {
    "cultural agnostic": 0,
    "cultural representative": 1,
    "cultural exclusive": 2,
}


def label_to_id(label: Column, ids: dict[str, int] = LABEL_IDS) -> Column:
    pairs = [F.lit(v) for pair in ids.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), label)


def id_to_label(label_id: Column, ids: dict[str, int] = LABEL_IDS) -> Column:
    pairs = [F.lit(v) for label, i in ids.items() for v in (i, label)]
    return F.try_element_at(F.create_map(*pairs), label_id)


def softmax(logits: Column) -> Column:
    """Probabilities from an array of logits, shifted by the maximum for safety."""
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def best(values: Column) -> Column:
    """Struct of the largest element and its 0-based position, the first one when tied.

    The array is named once only: a predicate pushed below it must not multiply its cost.
    """
    ranked = F.transform(values, lambda v, i: F.struct(v.alias("value"), (-i).alias("rank")))
    return F.array_max(ranked)


def argmax(values: Column) -> Column:
    return -best(values)["rank"]


def class_at(index: Column, classes: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def slug(label: str) -> str:
    return label.replace(" ", "_")


def with_prediction(df: DataFrame, classes: list[str], probs: str = "probs") -> DataFrame:
    """Add the winning class and its probability."""
    top = df.withColumn("_best", best(F.col(probs)))
    return top.withColumns(
        {"predicted_label": class_at(-F.col("_best.rank"), classes), "confidence": F.col("_best.value")}
    ).drop("_best")


def with_class_probabilities(df: DataFrame, classes: list[str], probs: str = "probs") -> DataFrame:
    """One ``prob_<class>`` column per class."""
    return df.withColumns({f"prob_{slug(c)}": F.get(F.col(probs), F.lit(i)) for i, c in enumerate(classes)})


def with_correct_flag(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return df.withColumn("correct", F.col(label) == F.col(predicted))


def low_confidence(df: DataFrame, threshold: float = 0.7, confidence: str = "confidence") -> DataFrame:
    return df.where(F.col(confidence) < threshold)


def misclassified(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return df.where(F.col(label) != F.col(predicted))
