"""Soft-voting ensemble of three Spark ML learners weighted by validation F1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions.labels import argmax, class_at, label_to_id
from taxon.learning.boosting import BoostedTreesModel, TreeParams, classes_of, fit_boosted_trees
from taxon.operators.metrics import overall
from taxon.operators.votes import weighted_vote


@dataclass(frozen=True)
class EnsembleModel:
    classes: list[str]
    linear: object
    forest: object
    trees: BoostedTreesModel
    weights: list[float]

    def model_probs(self, df: DataFrame) -> DataFrame:
        """Add ``model_probs``: one probability array per member, all from one scan."""
        out = df
        for name, model in (("lin", self.linear), ("rf", self.forest)):
            model = model.setProbabilityCol(f"_{name}").setRawPredictionCol(f"_{name}_raw").setPredictionCol(f"_{name}_y")
            out = model.transform(out)
        out = self.trees.predict_proba(out)
        members = F.array(vector_to_array("_lin"), vector_to_array("_rf"), F.col("probs"))
        return out.withColumn("model_probs", members).drop(
            "probs", *[f"_{n}{s}" for n in ("lin", "rf") for s in ("", "_raw", "_y")]
        )

    def predict(self, df: DataFrame) -> DataFrame:
        return weighted_vote(self.model_probs(df), self.classes, self.weights)


def member_scores(df: DataFrame, model: EnsembleModel, label: str = "label") -> list[float]:
    """Macro F1 of each member, in order; one row per member comes back."""
    long = model.model_probs(df).select(label, F.posexplode("model_probs").alias("member", "p"))
    scored = long.select(
        F.col(label).alias("label"), "member", class_at(argmax(F.col("p")), model.classes).alias("predicted_label")
    )
    rows = overall(scored, ["member"]).select("member", "f1_macro").orderBy("member").collect()
    return [row["f1_macro"] for row in rows]


def fit_ensemble(
    df: DataFrame,
    params: TreeParams = TreeParams(max_depth=6, learning_rate=0.1, rounds=500),
    trees: int = 100,
    label: str = "label",
    validation: str = "is_validation",
) -> EnsembleModel:
    """Fit the members on the training rows and weight them by F1 on the validation rows."""
    df = df.where(F.col(label).isNotNull() & F.col(validation).isNotNull())
    classes = classes_of(df, label)
    ids = {c: i for i, c in enumerate(classes)}
    train = df.where(~F.col(validation)).withColumn("label_id", label_to_id(F.col(label), ids).cast("double"))
    linear = LogisticRegression(labelCol="label_id", family="multinomial", maxIter=50, regParam=0.01).fit(train)
    forest = RandomForestClassifier(
        labelCol="label_id", numTrees=trees, maxDepth=params.max_depth, subsamplingRate=params.subsample, seed=params.seed
    ).fit(train)
    boosted = fit_boosted_trees(df, params, label, validation)
    even = EnsembleModel(classes, linear, forest, boosted, [1.0, 1.0, 1.0])
    scores = member_scores(df.where(F.col(validation)), even, label)
    weights = scores if sum(scores) > 0 else even.weights
    return EnsembleModel(classes, linear, forest, boosted, weights)
