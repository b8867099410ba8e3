"""Classification metrics.

Every metric starts from the confusion counts, one map-side combined aggregation over the
predictions. What follows touches one row per class pair, whatever the size of the data.
``by`` names columns (model, split, fold) that each get their own set of metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL, PREDICTED = "label", "predicted_label"


def _ratio(a: Column, b: Column) -> Column:
    """Quotient that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion_counts(df: DataFrame, by: list[str] = (), label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:
    """Rows per observed (true, predicted) pair; rows without a label are left out."""
    # filtering the counts, not the rows: a predicate on a computed prediction would be pushed
    # down and make the scan evaluate the whole model once more
    known = F.col(label).isNotNull() & F.col(predicted).isNotNull()
    return (
        df.groupBy(*by, F.col(label).alias(LABEL), F.col(predicted).alias(PREDICTED))
        .agg(F.count_if(known).alias("count"))
        .where(F.col("count") > 0)
    )


def accuracy(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(LABEL) == F.col(PREDICTED)).cast("double")).alias("accuracy"))


def _class_totals(confusion: DataFrame, by: list[str]) -> DataFrame:
    """Per class of either side: hits, rows predicted as it and rows that truly are it."""
    hit = F.when(F.col(LABEL) == F.col(PREDICTED), F.col("count")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(LABEL).alias("class"), hit.alias("tp"), F.lit(0).alias("predicted"), F.col("count").alias("support")),
        F.struct(F.col(PREDICTED).alias("class"), F.lit(0).alias("tp"), F.col("count").alias("predicted"), F.lit(0).alias("support")),
    )
    return (
        confusion.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "predicted", "support")])
    )


def _class_metrics(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
        }
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def per_class(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support over the union of true and predicted labels."""
    metrics = _class_metrics(_class_totals(confusion_counts(df, by), by))
    return metrics.select(*by, "class", "precision", "recall", "f1", "support")


def _macro(c: str) -> Column:
    return F.avg(c)


def _weighted(c: str) -> Column:
    return _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))


def _kappa() -> Column:
    """Agreement beyond the one expected from the two marginals."""
    n = F.sum("support").cast("double")
    observed = F.sum("tp") / n
    expected = F.sum(F.col("support").cast("double") * F.col("predicted")) / (n * n)
    return F.try_divide(observed - expected, 1 - expected)


def overall(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted averages and kappa in one row per ``by`` group."""
    metrics = _class_metrics(_class_totals(confusion_counts(df, by), by))
    return metrics.groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _macro("f1").alias("f1_macro"),
        _weighted("f1").alias("f1_weighted"),
        _macro("precision").alias("precision_macro"),
        _weighted("precision").alias("precision_weighted"),
        _macro("recall").alias("recall_macro"),
        _weighted("recall").alias("recall_weighted"),
        _kappa().alias("cohen_kappa"),
    )


def macro(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return overall(df, by).select(*by, "precision_macro", "recall_macro", "f1_macro")


def weighted(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return overall(df, by).select(*by, "precision_weighted", "recall_weighted", "f1_weighted")


def kappa(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return overall(df, by).select(*by, "cohen_kappa")


def label_domain(df: DataFrame, label: str = LABEL, predicted: str = PREDICTED) -> DataFrame:
    """Every label that occurs as truth or as prediction."""
    return (
        confusion_counts(df, label=label, predicted=predicted)
        .select(F.explode(F.array(LABEL, PREDICTED)).alias("label"))
        .distinct()
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Dense matrix in long form: absent pairs count 0. One row per pair of classes."""
    # the whole confusion table is one row of this aggregate: classes squared, not data
    table = confusion_counts(df).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(LABEL, PREDICTED), F.col("count")))).alias("counts"),
        F.array_distinct(F.flatten(F.collect_list(F.array(LABEL, PREDICTED)))).alias("domain"),
    )
    cells = table.select("counts", "domain", F.explode("domain").alias(LABEL)).select(
        "counts", LABEL, F.explode("domain").alias(PREDICTED)
    )
    count = F.try_element_at("counts", F.struct(LABEL, PREDICTED))
    return cells.select(LABEL, PREDICTED, F.coalesce(count, F.lit(0)).cast("bigint").alias("count"))


def confusion_matrix_normalised(df: DataFrame) -> DataFrame:
    """Each cell as a share of its true class."""
    cells = confusion_matrix(df)
    totals = cells.groupBy(LABEL).agg(
        F.sum("count").alias("total"), F.collect_list(F.struct(PREDICTED, "count")).alias("row")
    )
    return totals.select(LABEL, "total", F.inline("row")).select(
        LABEL, PREDICTED, _ratio(F.col("count"), F.col("total")).alias("share")
    )


def report(df: DataFrame) -> DataFrame:
    """Rows per class followed by accuracy, macro and weighted averages."""
    # one rollup gives the class rows and the totals together, so the data is read once
    metrics = _class_metrics(_class_totals(confusion_counts(df), []))
    rolled = metrics.rollup("class").agg(
        F.grouping("class").alias("total"),
        _macro("precision").alias("p"),
        _macro("recall").alias("r"),
        _macro("f1").alias("f"),
        F.sum("support").alias("s"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _weighted("precision").alias("wp"),
        _weighted("recall").alias("wr"),
        _weighted("f1").alias("wf"),
    )

    def row(name, p, r, f):
        return F.struct(name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("s").alias("support"))

    none = F.lit(None).cast("double")
    p, r, f = F.col("p"), F.col("r"), F.col("f")
    averages = F.array(
        row(F.lit("accuracy"), none, none, F.col("accuracy")),
        row(F.lit("macro avg"), p, r, f),
        row(F.lit("weighted avg"), F.col("wp"), F.col("wr"), F.col("wf")),
    )
    return rolled.select(F.inline(F.when(F.col("total") == 1, averages).otherwise(F.array(row(F.col("class"), p, r, f)))))


def error_breakdown(df: DataFrame) -> DataFrame:
    """Per true class with errors: their number, rate and share going to each other class."""
    by_label = (
        confusion_counts(df)
        .groupBy(LABEL)
        .agg(
            F.sum("count").alias("total_samples"),
            F.sum(F.when(F.col(LABEL) != F.col(PREDICTED), F.col("count")).otherwise(0)).alias("total_errors"),
            F.collect_list(
                F.when(F.col(LABEL) != F.col(PREDICTED), F.struct(F.col(PREDICTED).alias("misclassified_as"), F.col("count")))
            ).alias("targets"),
        )
    )
    rate = 100.0 * F.col("total_errors") / F.col("total_samples")
    return by_label.select(
        LABEL, "total_errors", "total_samples", rate.alias("error_rate"), F.inline("targets")
    ).withColumn("pct_of_errors", 100.0 * F.col("count") / F.col("total_errors"))


def full_report(df: DataFrame) -> DataFrame:
    """The complete evaluation as one nested row.

    Each part is a handful of rows, so the parts meet by scalar subqueries.
    """

    def entries(part: DataFrame, key: list[str], values: list[str]) -> Column:
        pair = F.struct(key[0] if len(key) == 1 else F.struct(*key), F.struct(*values))
        return part.agg(F.map_from_entries(F.collect_list(pair))).scalar()

    errors = error_breakdown(df).groupBy(LABEL, "total_errors", "total_samples", "error_rate").agg(
        F.map_from_entries(F.collect_list(F.struct("misclassified_as", "count"))).alias("misclassified_as")
    )
    cells = F.array_sort(F.collect_list(F.struct(LABEL, PREDICTED, "count")))
    shares = F.array_sort(F.collect_list(F.struct(LABEL, PREDICTED, "share")))
    metrics = overall(df)
    return metrics.select(
        df.agg(F.count(F.lit(1))).scalar().alias("dataset_size"),
        F.struct(*metrics.columns).alias("overall_metrics"),
        entries(per_class(df), ["class"], ["precision", "recall", "f1", "support"]).alias("per_class_metrics"),
        entries(errors, [LABEL], ["total_errors", "total_samples", "error_rate", "misclassified_as"]).alias("error_analysis"),
        confusion_matrix(df).agg(cells).scalar().alias("confusion_matrix"),
        confusion_matrix_normalised(df).agg(shares).scalar().alias("confusion_matrix_normalized"),
        entries(report(df), ["class"], ["precision", "recall", "f1", "support"]).alias("classification_report"),
    )


def flat_report(report: DataFrame) -> DataFrame:
    """The nested evaluation as rows ``section, key, metric, value``; undefined values are left out."""

    def rows(section: str, key: Column, values: dict[str, Column]) -> Column:
        fields = [
            F.struct(F.lit(section).alias("section"), key.alias("key"), F.lit(m).alias("metric"), x.cast("double").alias("value"))
            for m, x in values.items()
        ]
        return F.array(*fields)

    def of_map(name: str, values: list[str]) -> Column:
        entries = F.map_entries(name)
        return F.flatten(F.transform(entries, lambda e: rows(name, e["key"], {m: e["value"][m] for m in values})))

    def of_cells(name: str, value: str) -> Column:
        pair = lambda c: F.concat(c[LABEL], F.lit(">"), c[PREDICTED])
        return F.flatten(F.transform(name, lambda c: rows(name, pair(c), {value: c[value]})))

    def mistakes(e: Column) -> Column:
        pairs = F.map_entries(e["value"]["misclassified_as"])
        return F.flatten(F.transform(pairs, lambda p: rows("error_analysis", F.concat(e["key"], F.lit(">"), p["key"]), {"count": p["value"]})))

    scores = report.schema["overall_metrics"].dataType.names
    parts = [
        rows("dataset", F.lit("all"), {"size": F.col("dataset_size")}),
        rows("overall_metrics", F.lit("all"), {m: F.col(f"overall_metrics.{m}") for m in scores}),
        of_map("per_class_metrics", ["precision", "recall", "f1", "support"]),
        of_map("error_analysis", ["total_errors", "total_samples", "error_rate"]),
        F.flatten(F.transform(F.map_entries("error_analysis"), mistakes)),
        of_cells("confusion_matrix", "count"),
        of_cells("confusion_matrix_normalized", "share"),
        of_map("classification_report", ["precision", "recall", "f1", "support"]),
    ]
    return report.select(F.inline(F.concat(*[F.coalesce(p, F.array().cast(REPORT_ROWS)) for p in parts]))).where("value IS NOT NULL")


REPORT_ROWS = "array<struct<section:string,key:string,metric:string,value:double>>"


def log_loss(df: DataFrame, classes: list[str], probs: str = "probs") -> DataFrame:
    """Mean negative log-probability of the true class."""
    p_true = F.get(F.col(probs), (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(LABEL)) - 1).cast("int"))
    return df.agg(F.avg(-F.ln(p_true)).alias("log_loss"))


def with_smoothed_cross_entropy(
    df: DataFrame, classes: list[str], weights: DataFrame, smoothing: float = 0.1, probs: str = "probs"
) -> DataFrame:
    """Add ``loss`` (class-weighted, label-smoothed cross-entropy) and ``weight`` per row.

    ``weights`` is (label, weight), one row per class; it travels as a map of class size.
    """
    as_map = weights.agg(F.map_from_entries(F.collect_list(F.struct(LABEL, "weight")))).scalar()
    domain = F.array(*[F.lit(c) for c in classes])
    weighted_df = df.withColumn("_weights", as_map)
    nll = F.transform(
        domain,
        lambda c, i: -F.ln(F.get(F.col(probs), i)) * F.coalesce(F.try_element_at(F.col("_weights"), c), F.lit(0.0)),
    )
    k = len(classes)
    true_index = (F.array_position(domain, F.col(LABEL)) - 1).cast("int")
    spread = F.aggregate(F.col("_nll"), F.lit(0.0), lambda acc, x: acc + x)
    return (
        weighted_df.withColumn("_nll", nll)
        .withColumn("loss", (1 - smoothing) * F.get(F.col("_nll"), true_index) + smoothing / k * spread)
        .withColumn("weight", F.try_element_at(F.col("_weights"), F.col(LABEL)))
        .drop("_nll", "_weights")
    )


def weighted_cross_entropy(
    df: DataFrame, classes: list[str], weights: DataFrame, smoothing: float = 0.1, probs: str = "probs"
) -> DataFrame:
    rows = with_smoothed_cross_entropy(df, classes, weights, smoothing, probs)
    return rows.agg((F.sum("loss") / F.sum("weight")).alias("cross_entropy"))


def focal_loss(
    df: DataFrame,
    classes: list[str],
    weights: DataFrame,
    smoothing: float = 0.1,
    gamma: float = 2.0,
    probs: str = "probs",
) -> DataFrame:
    """Mean and sum of the cross-entropy damped where the prediction is already good."""
    rows = with_smoothed_cross_entropy(df, classes, weights, smoothing, probs)
    focal = F.pow(1 - F.exp(-F.col("loss")), F.lit(gamma)) * F.col("loss")
    return rows.agg(F.avg(focal).alias("focal_mean"), F.sum(focal).alias("focal_sum"))


def f1_wide(df: DataFrame, models: list[str], model: str = "model") -> DataFrame:
    """F1 of each class with one column per model."""
    scores = per_class(df, [model])
    return scores.groupBy("class").pivot(model, models).agg(F.first("f1"))
