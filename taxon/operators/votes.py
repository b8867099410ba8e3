"""Ensemble votes over an array of class probabilities per model.

All models score the same row, so a vote is an expression on that row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.functions.labels import argmax, class_at, with_class_probabilities, with_prediction


def combine(model_probs: Column, weights: list[float], classes: int) -> Column:
    """Weighted mean of the models' probabilities; the weights are scaled to sum to 1."""
    total = float(sum(weights))
    per_class = []
    for c in range(classes):
        terms = [F.get(F.get(model_probs, F.lit(m)), F.lit(c)) * (w / total) for m, w in enumerate(weights)]
        per_class.append(sum(terms[1:], terms[0]))
    return F.array(*per_class)


def weighted_vote(df: DataFrame, classes: list[str], weights: list[float], model_probs: str = "model_probs") -> DataFrame:
    probs = combine(F.col(model_probs), weights, len(classes))
    voted = with_prediction(df.withColumn("probs", probs), classes)
    return with_class_probabilities(voted, classes).drop("probs")


def average_vote(df: DataFrame, classes: list[str], models: int, model_probs: str = "model_probs") -> DataFrame:
    return weighted_vote(df, classes, [1.0] * models, model_probs)


def majority_vote(df: DataFrame, classes: list[str], model_probs: str = "model_probs") -> DataFrame:
    """Most voted class, the earliest model's choice when tied; shares stand in for probabilities."""
    ids = F.array(*[F.lit(i) for i in range(len(classes))])
    voted = df.withColumn("_votes", F.transform(model_probs, argmax))
    counted = voted.withColumn("_counts", F.transform(ids, lambda c: F.size(F.filter("_votes", lambda x: x == c))))
    leading = F.filter("_votes", lambda x: F.get("_counts", x) == F.array_max("_counts"))
    models = F.size("_votes")
    decided = counted.withColumns(
        {
            "predicted_label": class_at(F.get(leading, F.lit(0)), classes),
            "confidence": F.array_max("_counts") / models,
            "probs": F.transform("_counts", lambda n: n / models),
        }
    )
    return with_class_probabilities(decided, classes).drop("_votes", "_counts", "probs")
