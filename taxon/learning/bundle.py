"""One saved bundle for the published training path: label encoder, population scaler, features, trees.

The bundle is a Spark ML ``PipelineModel`` whose stages are all Spark's own writable transformers:
a ``StringIndexerModel`` (classes in alphabetical order), a ``SQLTransformer`` that fills missing values
with 0 and scales each feature by the training mean and population deviation, a ``VectorAssembler``
(its input columns are the feature names), a ``OneVsRestModel`` of boosted trees (one binary model per
class, each stopped at its best round on the validation rows and cut there), and ``IndexToString``. Two
estimators of this module fit the scaler and the trees; saving and loading need nothing of this module.

Probabilities: a boosted model's margin m gives the positive probability 1 / (1 + exp(-2 m)); the classes'
probabilities are scaled to sum to 1 and the prediction is their arg-max (ties: the first class), as in
``BoostedTreesModel``.
"""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxon.learning.boosting import ROWS_PER_TASK, TreeParams, _fit_class, _learner

SCALED_PREFIX = "scaled_"


class PopulationScaler(Estimator):
    """Fits mean and population deviation of ``inputCols`` (missing as 0); the model is a ``SQLTransformer``.

    A constant feature is only centred. The statement holds the fitted numbers as literals, so the model is
    saved and loaded as Spark's own transformer.
    """

    inputCols = Param(Params._dummy(), "inputCols", "features to scale", typeConverter=TypeConverters.toListString)

    def __init__(self, inputCols: list[str]):
        super().__init__()
        self._set(inputCols=inputCols)

    def _fit(self, df: DataFrame) -> SQLTransformer:
        names = self.getOrDefault(self.inputCols)
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
        row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]).first()
        terms = []
        for i, c in enumerate(names):
            mean, deviation = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
            terms.append(f"(coalesce(CAST(`{c}` AS DOUBLE), 0D) - ({mean!r}D)) / ({deviation or 1.0!r}D) AS `{SCALED_PREFIX}{c}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


class BoostedOneVsRest(Estimator):
    """One boosted binary model per class index of ``labelCol``, stopped on rows whose ``validationCol`` is true."""

    labelCol = Param(Params._dummy(), "labelCol", "class index", typeConverter=TypeConverters.toString)
    validationCol = Param(Params._dummy(), "validationCol", "validation flag", typeConverter=TypeConverters.toString)
    treeParams = Param(Params._dummy(), "treeParams", "TreeParams as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, labelCol: str = "label_id", validationCol: str = "is_validation", params: TreeParams = TreeParams()):
        super().__init__()
        self._set(labelCol=labelCol, validationCol=validationCol, treeParams=json.dumps(params.__dict__))

    def _fit(self, df: DataFrame) -> OneVsRestModel:
        label, validation = self.getOrDefault(self.labelCol), self.getOrDefault(self.validationCol)
        params = TreeParams(**json.loads(self.getOrDefault(self.treeParams)))
        known = df.where(F.col(label).isNotNull() & F.col(validation).isNotNull()).select("features", label, validation)
        classes = int(known.agg(F.max(label)).first()[0]) + 1
        rows = known.where(~F.col(validation)).count()
        known = known.coalesce(max(1, -(-rows // ROWS_PER_TASK)))

        def fit(k: int):
            one = known.select("features", validation, (F.col(label) == k).cast("double").alias("is_class"))
            return _fit_class(one.where(~F.col(validation)).drop(validation), one.where(F.col(validation)).drop(validation), rows, params)

        with ThreadPool(min(classes, 8)) as pool:
            models = pool.map(fit, range(classes))
        ovr = OneVsRestModel(models)
        # the learner of the classes' models, as the writer records it
        ovr._set(classifier=_learner(params, params.rounds, rows), labelCol=label)
        return ovr.setFeaturesCol("features").setPredictionCol("prediction").setRawPredictionCol("rawPrediction")


def fit_bundle(df: DataFrame, features: list[str], label: str = "label", validation: str = "is_validation",
               params: TreeParams = TreeParams()) -> PipelineModel:
    """The whole training path on rows with a label: encode, scale on the training rows, assemble, boost."""
    labelled = df.where(F.col(label).isNotNull())
    indexer = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep").fit(labelled)
    scaler = PopulationScaler(features).fit(labelled.where(~F.col(validation)))
    assembler = VectorAssembler(inputCols=[f"{SCALED_PREFIX}{c}" for c in features], outputCol="features")
    ready = assembler.transform(scaler.transform(indexer.transform(labelled)))
    trees = BoostedOneVsRest("label_id", validation, params).fit(ready)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return PipelineModel([indexer, scaler, assembler, trees, back])


def predict(bundle: PipelineModel, df: DataFrame) -> DataFrame:
    """The bundle's output with ``probs`` (one per class, summing to 1) and ``confidence``; helper columns dropped."""
    out = bundle.transform(df)
    margins = vector_to_array("rawPrediction")
    positive = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(positive, F.lit(0.0), lambda a, p: a + p)
    out = out.withColumn("probs", F.transform(positive, lambda p: p / total))
    scaled = [c for c in out.columns if c.startswith(SCALED_PREFIX)]
    return out.withColumn("confidence", F.array_max("probs")).drop(*scaled, "features", "label_id", "rawPrediction")


def feature_names(bundle: PipelineModel) -> list[str]:
    assembler = next(s for s in bundle.stages if isinstance(s, VectorAssembler))
    return [c.removeprefix(SCALED_PREFIX) for c in assembler.getInputCols()]


def importances(spark: SparkSession, bundle: PipelineModel) -> DataFrame:
    """(feature, importance) by feature name, averaged over the classes' models."""
    names = feature_names(bundle)
    ovr = next(s for s in bundle.stages if isinstance(s, OneVsRestModel))
    total = [0.0] * len(names)
    for model in ovr.models:
        for i, value in enumerate(model.featureImportances.toArray()):
            total[i] += float(value) / len(ovr.models)
    return spark.createDataFrame(list(zip(names, total)), "feature string, importance double")
