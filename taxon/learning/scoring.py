"""Batch scoring with a model that lives outside the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taxon.functions.labels import with_class_probabilities, with_prediction


def batch_scorer(weights: np.ndarray, bias: np.ndarray, batch_size: int = 4096):
    """Arrow-batched scorer of a linear softmax model, built once per Python worker.

    The model (classes x features) is shipped with the function; its size does not depend
    on the data.
    """

    def make_predict():
        w, b = np.asarray(weights), np.asarray(bias)

        def predict(batch: np.ndarray) -> np.ndarray:
            logits = batch @ w.T + b
            logits -= logits.max(axis=1, keepdims=True)
            exps = np.exp(logits)
            return exps / exps.sum(axis=1, keepdims=True)

        return predict

    return predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[int(np.asarray(weights).shape[1])]],
    )


def score_table(
    df: DataFrame, weights: np.ndarray, bias: np.ndarray, classes: list[str], column: str, batch_size: int = 4096
) -> DataFrame:
    """Add predicted label, confidence and one probability per class."""
    scored = df.withColumn("probs", batch_scorer(weights, bias, batch_size)(column))
    return with_class_probabilities(with_prediction(scored, classes), classes).drop("probs")
