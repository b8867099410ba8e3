import math

import pytest
from pyspark.sql import functions as F

from taxon.operators import experiments as E
from taxon.operators import metrics as M

# Published confusion matrices and the metrics published with them.
CLASSES = ["agnostic", "exclusive", "representative"]
GOLDEN = [
    ([[113, 2, 2], [3, 50, 23], [12, 22, 73]], (0.786667, 0.767104, 0.782660, 0.767795, 0.781148, 0.768650, 0.674101)),
    ([[108, 4, 5], [2, 49, 25], [13, 21, 73]], (0.766667, 0.749524, None, None, None, None, 0.643850)),
]


def from_matrix(spark, matrix, classes=CLASSES):
    rows = [(t, p, n) for t, row in zip(classes, matrix) for p, n in zip(classes, row) if n]
    df = spark.createDataFrame(rows, "label string, predicted_label string, n int")
    return df.select("label", "predicted_label", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


@pytest.mark.parametrize("matrix,expected", GOLDEN)
def test_published_values(spark, matrix, expected):
    row = M.overall(from_matrix(spark, matrix)).first()
    names = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted", "recall_macro", "cohen_kappa"]
    for name, value in zip(names, expected):
        if value is not None:
            assert row[name] == pytest.approx(value, abs=1e-6), name


def test_published_error_breakdown(spark):
    rows = M.error_breakdown(from_matrix(spark, GOLDEN[0][0])).collect()
    got = {(r["label"], r["misclassified_as"]): r["count"] for r in rows}
    assert got["representative", "exclusive"] == 22 and got["exclusive", "representative"] == 23
    assert sum(got.values()) == 64
    exclusive = next(r for r in rows if r["label"] == "exclusive")
    assert exclusive["total_samples"] == 76 and exclusive["error_rate"] == pytest.approx(100 * 26 / 76)


def test_class_never_predicted_and_class_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "label string, predicted_label string")
    rows = {r["class"]: r for r in M.per_class(df).collect()}
    assert sorted(rows) == ["a", "b", "c"]
    assert rows["b"]["precision"] == rows["b"]["recall"] == rows["b"]["f1"] == 0.0
    assert rows["c"]["support"] == 0 and rows["c"]["f1"] == 0.0
    assert M.macro(df).first()["f1_macro"] == pytest.approx(0.5 / 3)


def test_dense_matrix_and_shares(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "label string, predicted_label string")
    cells = {(r[0], r[1]): r[2] for r in M.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells["b", "b"] == 0 and cells["a", "c"] == 1
    shares = {(r[0], r[1]): r[2] for r in M.confusion_matrix_normalised(df).collect()}
    assert shares["a", "a"] == 0.5 and shares["c", "a"] == 0.0


def test_missing_labels_are_left_out(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None)], "label string, predicted_label string")
    assert M.confusion_counts(df).collect() == [("a", "a", 1)]


def test_report_rows(spark):
    rows = {r["class"]: r for r in M.report(from_matrix(spark, GOLDEN[0][0])).collect()}
    assert set(rows) == {*CLASSES, "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"]["precision"] is None and rows["accuracy"]["support"] == 300
    assert rows["weighted avg"]["f1"] == pytest.approx(0.782660, abs=1e-6)


def test_full_report_agrees_with_its_parts(spark):
    df = from_matrix(spark, GOLDEN[0][0])
    report = M.full_report(df).first()
    assert report["dataset_size"] == 300
    assert report["overall_metrics"]["cohen_kappa"] == pytest.approx(0.674101, abs=1e-6)
    assert report["per_class_metrics"]["exclusive"]["support"] == 76
    assert report["error_analysis"]["exclusive"]["misclassified_as"] == {"agnostic": 3, "representative": 23}
    assert [c["count"] for c in report["confusion_matrix"]] == [113, 2, 2, 3, 50, 23, 12, 22, 73]


def test_perfect_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "label string, predicted_label string")
    assert M.error_breakdown(df).count() == 0
    assert M.full_report(df).first()["error_analysis"] in (None, {})
    assert M.kappa(df).first()["cohen_kappa"] == 1.0


def test_class_weights_of_published_counts(spark):
    counts = {"agnostic": 1872, "representative": 2691, "exclusive": 1688}
    df = spark.createDataFrame(list(counts.items()), "label string, n int")
    df = df.select("label", F.explode(F.sequence(F.lit(1), "n")))
    weights = {r["label"]: r["weight"] for r in E.class_weights(df).collect()}
    assert weights["agnostic"] == pytest.approx(1.1131, abs=1e-4)
    assert weights["representative"] == pytest.approx(0.7743, abs=1e-4)
    assert weights["exclusive"] == pytest.approx(1.2344, abs=1e-4)


def test_losses_by_hand(spark):
    classes = ["a", "b", "c"]
    df = spark.createDataFrame([("a", [0.7, 0.2, 0.1]), ("c", [0.1, 0.1, 0.8])], "label string, probs array<double>")
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 2.0)], "label string, weight double")
    w = {"a": 1.0, "b": 0.5, "c": 2.0}

    def loss(label, probs):
        nll = {c: -math.log(p) for c, p in zip(classes, probs)}
        return 0.9 * w[label] * nll[label] + 0.1 / 3 * sum(w[c] * nll[c] for c in classes)

    losses = [loss("a", [0.7, 0.2, 0.1]), loss("c", [0.1, 0.1, 0.8])]
    assert M.weighted_cross_entropy(df, classes, weights).first()[0] == pytest.approx(sum(losses) / 3.0)
    focal = [(1 - math.exp(-x)) ** 2 * x for x in losses]
    row = M.focal_loss(df, classes, weights).first()
    assert row["focal_mean"] == pytest.approx(sum(focal) / 2) and row["focal_sum"] == pytest.approx(sum(focal))
    assert M.log_loss(df, classes).first()[0] == pytest.approx(-(math.log(0.7) + math.log(0.8)) / 2)


def test_fold_summary_and_best_fold(spark):
    df = spark.createDataFrame([(0, 0.5, 1.0), (1, 0.7, 2.0), (2, 0.7, 3.0)], "fold int, f1_macro double, x double")
    rows = {r["metric"]: r for r in E.fold_summary(df).collect()}
    assert rows["x"]["values"] == [1.0, 2.0, 3.0] and rows["x"]["std"] == pytest.approx((2 / 3) ** 0.5)
    assert E.best_row(df, "f1_macro", "fold").first()["fold"] == 1
