import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from taxon.learning import search
from taxon.learning.boosting import BoostedTreesModel, TreeParams, best_round, fit_boosted_trees
from taxon.learning.ensemble import fit_ensemble
from taxon.learning.folds import cross_validate
from taxon.learning.scaling import fit_scaler
from taxon.learning.scoring import score_table
from taxon.operators import tfidf as T
from taxon.session import cut_lineage, scratch_path

TEXTS = ["The cat sat. The cat ran!", "a dog ran to the café", "x", "", "Cat cat CAT dog"]


def brute_force(texts, top):
    docs = [re.findall(r"\w\w+", t.lower()) for t in texts]
    grams = [d + [f"{a} {b}" for a, b in zip(d, d[1:])] for d in docs]
    counts = Counter(g for d in grams for g in d)
    vocab = sorted(sorted(counts, key=lambda g: (-counts[g], g))[:top])
    n = len(texts)
    idf = {g: math.log((1 + n) / (1 + sum(g in d for d in grams))) + 1 for g in vocab}
    out = {}
    for i, d in enumerate(grams):
        row = {g: d.count(g) * idf[g] for g in vocab if g in d}
        norm = math.sqrt(sum(v * v for v in row.values()))
        out.update({(i, g): v / norm for g, v in row.items()})
    return out, vocab


@pytest.mark.parametrize("top", [3, 100])
def test_tfidf_against_brute_force(spark, top):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    expected, vocab = brute_force(TEXTS, top)
    counts = T.term_counts(df, "id", "text")
    cells = T.tfidf(counts, T.fit_idf(counts, len(TEXTS), top), "id")
    rows = cells.collect()
    assert {(r["id"], r["term"]) for r in rows} == set(expected)
    for r in rows:
        assert r["tfidf"] == pytest.approx(expected[r["id"], r["term"]])
        assert vocab[r["position"]] == r["term"]
    wide = {r["id"]: r for r in T.widened(df, cells, "id", top).collect()}
    assert len(wide) == len(TEXTS) and wide[2]["tfidf_0"] == 0.0


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    rows = fit_scaler(df, ["x", "c"]).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    """Three well separated groups, every fifth row held out."""
    rng = np.random.default_rng(0)
    centres = {"a": (0, 0), "b": (4, 0), "c": (0, 4)}
    rows = []
    for label, centre in centres.items():
        for i, point in enumerate(rng.normal(centre, 0.5, (60, 2))):
            rows.append((f"{label}{i}", label, [float(x) for x in point], i % 5 == 0))
    df = spark.createDataFrame(rows, "id string, label string, x array<double>, is_validation boolean")
    return cut_lineage(df.withColumn("features", array_to_vector("x")))


PARAMS = TreeParams(max_depth=2, learning_rate=0.3, rounds=3, min_child_weight=1, gamma=0.0)


def test_boosted_trees_predict_save_and_rank_features(spark, blobs):
    model = fit_boosted_trees(blobs, PARAMS)
    rows = model.predict(blobs).collect()
    assert all(sum(r["probs"]) == pytest.approx(1.0) for r in rows)
    assert np.mean([r["label"] == r["predicted_label"] for r in rows]) > 0.95
    assert sum(r["importance"] for r in model.importances(spark).collect()) == pytest.approx(1.0)
    path = scratch_path(spark, "trees")
    model.save(spark, path)
    again = BoostedTreesModel.load(spark, path).predict(blobs).select("id", "predicted_label", "confidence")
    assert again.exceptAll(model.predict(blobs).select("id", "predicted_label", "confidence")).count() == 0


def test_boosting_goes_on_at_the_published_settings(spark):
    """More than one tree for each class and more than one node for each tree, and better than a constant."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = rng.uniform(-1, 1, 3)
        label = "a" if x[0] * x[1] > 0.05 else "b" if x[2] > 0 else None if i % 40 == 0 else "c"
        rows.append((label, [float(v) for v in x], None if i % 50 == 1 else i % 4 == 0))
    df = spark.createDataFrame(rows, "label string, x array<double>, is_validation boolean")
    data = cut_lineage(df.withColumn("features", array_to_vector("x")))
    model = fit_boosted_trees(data, TreeParams(rounds=60))
    assert model.classes == ["a", "b", "c"]
    for one in model.models:
        assert len(one.trees) > 1 and min(t.numNodes for t in one.trees) > 1
    scored = model.predict(data.where("is_validation and label is not null")).collect()
    right = np.mean([r["label"] == r["predicted_label"] for r in scored])
    assert right > 0.2 + max(np.mean([r["label"] == c for r in scored]) for c in "abc")


def test_patience_counts_rounds_without_gain():
    assert best_round([5, 4, 3, 3.5, 3.2, 2], 3) == (6, False)
    assert best_round([5, 4, 3, 3.5, 3.2, 2], 2) == (3, True)
    assert best_round([1, 2, 3], 50) == (1, False)


def test_ensemble_weights_and_votes(blobs):
    model = fit_ensemble(blobs, PARAMS, trees=5)
    assert len(model.weights) == 3 and all(0 < w <= 1 for w in model.weights)
    rows = model.predict(blobs.where("is_validation")).collect()
    assert np.mean([r["label"] == r["predicted_label"] for r in rows]) > 0.95
    assert all(r["prob_a"] + r["prob_b"] + r["prob_c"] == pytest.approx(1.0) for r in rows)


def test_search_is_repeatable_and_keeps_the_first_best(blobs):
    space = {"max_depth": (1, 2)}
    log, best = search.random_search(blobs, 2, PARAMS, space)
    again, _ = search.random_search(blobs, 2, PARAMS, space)
    rows = log.orderBy("number").collect()
    assert rows == again.orderBy("number").collect()
    top = max(rows, key=lambda r: (r["value"], -r["number"]))
    assert best.max_depth == top["params"]["max_depth"]
    metrics = {r["split"]: r for r in search.refit_best(blobs, best)[1].collect()}
    assert set(metrics) == {"training", "validation"} and metrics["validation"]["f1_macro"] > 0.9


def test_cross_validation_scores_every_row_once(blobs):
    predictions, summary, best, models = cross_validate(blobs.drop("is_validation"), "id", folds=3, max_iter=5)
    assert predictions.count() == 180 and predictions.select("id").distinct().count() == 180
    f1 = next(r for r in summary.collect() if r["metric"] == "f1_macro")
    assert len(f1["values"]) == 3 and best.first()["f1_macro"] == pytest.approx(max(f1["values"]))
    assert len(models) == 3


def test_batch_scores_equal_numpy(spark, blobs):
    w, b = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]]), np.array([0.1, 0.0, 0.0])
    rows = score_table(blobs.select("id", "x"), w, b, ["a", "b", "c"], "x", batch_size=7).collect()
    for r in rows:
        logits = w @ np.array(r["x"]) + b
        p = np.exp(logits) / np.exp(logits).sum()
        assert [r["prob_a"], r["prob_b"], r["prob_c"]] == pytest.approx(list(p))
        assert r["predicted_label"] == "abc"[int(p.argmax())]


def test_cut_model_equals_a_fit_of_that_many_rounds(spark, blobs):
    """The first trees of a seeded fit are the trees of a shorter fit: the cut predicts what a refit would."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from taxon.learning.boosting import _learner, cut

    data = blobs.select("features", (F.col("label") == "a").cast("double").alias("is_class"))
    params = TreeParams(max_depth=3, learning_rate=0.2, rounds=12, min_child_weight=1, gamma=0.0)
    long = _learner(params, 12, 180).fit(data)
    short = _learner(params, 5, 180).fit(data)
    cut5 = cut(long, 5)
    assert cut5.getNumTrees == 5 and cut(long, 12) is long
    a, b = (m.transform(data).select(vector_to_array("probability")[1].alias("p")).collect() for m in (cut5, short))
    assert [r.p for r in a] == pytest.approx([r.p for r in b], abs=1e-12)


@pytest.mark.parametrize("capacity", [3, 40, 20_000])
def test_heavy_terms_give_the_vocabulary_of_all_counts(spark, capacity):
    """Zipf-like texts over many partitions: the candidates hold the exact top terms, or the answer is None."""
    from taxon.operators import tfidf as T

    rng = np.random.default_rng(7)
    vocab = [f"w{i:03d}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    texts = [(i, " ".join(rng.choice(vocab, size=rng.integers(0, 40), p=p / p.sum()))) for i in range(600)]
    docs = spark.createDataFrame(texts + [(600, None), (601, "")], "doc_id long, description string").repartition(7)
    found = T.heavy_terms(docs, "description", 20, capacity=capacity)
    full = T.fit_idf(T.term_counts(docs, "doc_id", "description"), 602, 20).collect()
    if found is None:
        assert capacity < 20_000
    else:
        assert {r.term for r in full} <= {r.term for r in found.collect()}
    fitted = T.fit_idf(T.candidate_term_counts(docs, "doc_id", "description", 20), 602, 20).collect()
    assert sorted(map(tuple, fitted)) == sorted(map(tuple, full))


def test_bundle_saves_loads_and_names_features(spark):
    """Encoder, population scaler, named features and cut trees in one PipelineModel; loading changes nothing."""
    from pyspark.ml import PipelineModel

    from taxon.learning import bundle as B

    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        label = ["b", "a", "c"][i % 3]
        x = rng.normal(0, 1, 3) + {"a": 0, "b": 3, "c": -3}[label] * np.array([1, 0, 0])
        rows.append((i, label if i % 37 else None, float(x[0]), None if i % 11 == 0 else float(x[1]), int(x[2] > 0), i % 5 == 0))
    df = spark.createDataFrame(rows, "id long, label string, big double, noise double, flag int, is_validation boolean")
    model = B.fit_bundle(df, ["big", "noise", "flag"], params=TreeParams(max_depth=3, rounds=30, patience=5, min_child_weight=1))
    path = scratch_path(spark, "bundle")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    before = B.predict(model, df).select("id", "predicted_label", "confidence", "probs").collect()
    after = B.predict(again, df).select("id", "predicted_label", "confidence", "probs").collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    assert all(sum(r.probs) == pytest.approx(1.0) and r.confidence == max(r.probs) for r in after)
    assert np.mean([r.predicted_label == lab for r, (_, lab, *_x) in zip(sorted(after), rows) if lab is not None]) > 0.9
    assert B.feature_names(again) == ["big", "noise", "flag"]
    named = {r.feature: r.importance for r in B.importances(spark, again).collect()}
    assert max(named, key=named.get) == "big" and sum(named.values()) == pytest.approx(1.0)
    train = [r for r in rows if r[1] is not None and not r[5]]
    xs = np.array([r[2] for r in train])
    numbers = [float(x) for x in re.findall(r"\((-?[0-9.e-]+)D\)", again.stages[1].getStatement())]
    assert numbers[:2] == pytest.approx([xs.mean(), xs.std()], rel=1e-12)  # population deviation of the training rows
