"""Cross-validated training over stratified folds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions.labels import label_to_id, with_prediction
from taxon.learning.boosting import classes_of
from taxon.operators.experiments import best_row, fold_metrics, fold_summary, with_class_weight
from taxon.operators.splits import stratified_folds
from taxon.session import cut_lineage


def fit_linear(df: DataFrame, classes: list[str], weight: str | None = None, max_iter: int = 50):
    ids = {c: i for i, c in enumerate(classes)}
    encoded = df.where(F.col("label").isNotNull()).withColumn("label_id", label_to_id(F.col("label"), ids).cast("double"))
    learner = LogisticRegression(labelCol="label_id", family="multinomial", maxIter=max_iter, regParam=0.01)
    return (learner.setWeightCol(weight) if weight else learner).fit(encoded)


def predict_linear(model, df: DataFrame, classes: list[str]) -> DataFrame:
    scored = model.transform(df).withColumn("probs", vector_to_array("probability"))
    return with_prediction(scored.drop("rawPrediction", "probability", "prediction"), classes)


def cross_validate(df: DataFrame, key: str, folds: int = 5, seed: int = 42, max_iter: int = 50):
    """Out-of-fold predictions, fold summary, best fold row and the models by fold.

    ``df`` holds the key, ``features`` and ``label``; classes are weighted by inverse frequency.
    """
    # every fold fits on this table again and again, so it is stored once
    folded = cut_lineage(with_class_weight(stratified_folds(df, key, folds=folds, seed=seed)))
    classes = classes_of(folded)
    models, scored = [], []
    for fold in range(folds):
        model = fit_linear(folded.where(F.col("fold") != fold), classes, "weight", max_iter)
        models.append(model)
        scored.append(predict_linear(model, folded.where(F.col("fold") == fold), classes))
    predictions = reduce(DataFrame.unionByName, scored)
    metrics = fold_metrics(predictions)
    return predictions, fold_summary(metrics), best_row(metrics, "f1_macro", "fold"), models
