"""Scaling, learning, ensembles and scoring (survey section 2.10).

The registered fits run over all rows with the published settings (1000 rounds, 50 without gain), the
search, its refit and the A/B included. Queries on one model share it: it is fitted and stored once for
the source files. The search runs ``SEARCH_TRIALS`` trials over all ranges, fewer than the library's
default of the published 50 (measured seconds in the README).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions import features as X
from taxon.functions import text
from taxon.learning import bundle as B
from taxon.learning import search
from taxon.learning.boosting import BoostedTreesModel, TreeParams, assemble, fit_boosted_trees
from taxon.learning.ensemble import fit_ensemble
from taxon.learning.folds import cross_validate
from taxon.learning.scaling import fit_scaler
from taxon.learning.scoring import score_table
from taxon.operators import experiments as E
from taxon.operators import ranking as R
from taxon.operators import splits as S
from taxon.operators import tfidf as T
from taxon.operators import votes
from taxon.operators.joins import attach_features
from taxon.plans.registry import query, r
from taxon.plans.views import CLASSES, MODELS, Views
from taxon.session import cut_lineage, scratch_path

SEARCH_TRIALS = 4
GROUPS = ["g0", "g1", "g2"]


def vectors(v: Views) -> DataFrame:
    """(vec_id, features, label, is_validation): all embeddings, stratified 80/20, stored once."""
    return v.stored("vectors", lambda: split_vectors(v))


def split_vectors(v: Views) -> DataFrame:
    labelled = v.table("embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("g"), (F.col("label") % 3).cast("string")).alias("label")
    )
    split = S.stratified_split(labelled, "vec_id")
    return split.select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        "label",
        (F.col("split") == "valid").alias("is_validation"),
    )


# ---- scaling

SCALED = ["num_languages", "num_statements", "statement_diversity", "num_identifiers", "en_page_length"]
SCALED_SOURCE = r"""(SELECT s.item, s.split, f.* FROM {split_items} s
                     JOIN {raw_features} f ON f.qid = regexp_extract(s.item, 'Q\d+', 0))"""


@query(
    "SELECT x.item, x.split, "
    + ", ".join(r(f"(x.{c} - t.m_{c}) / t.s_{c}", c) for c in SCALED)
    + f" FROM {SCALED_SOURCE} x, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    + f" FROM {SCALED_SOURCE} WHERE split = 'train') t"
)
def ml_standard_scale(v: Views):
    items = S.stratified_split(v.items.select("doc_id", "item", "label"), "doc_id")
    # fitted on and transformed: joined once, kept as a checkpoint
    featured = cut_lineage(attach_features(items, v.raw_features).select("item", "split", *SCALED))
    return fit_scaler(featured.where(F.col("split") == "train"), SCALED).transform(featured)


# ---- votes


def vote_output(df: DataFrame) -> DataFrame:
    return df.select("item", "predicted_label", "confidence", *[f"prob_{c}" for c in CLASSES])


def soft_vote_sql(weights: list[float]) -> str:
    total = sum(weights)
    case = " ".join(f"WHEN {i} THEN {w / total!r}" for i, w in enumerate(weights))
    sums = ", ".join(f"sum(probs[{c + 1}] * CAST(CASE model_idx {case} END AS DOUBLE))" for c in range(len(CLASSES)))
    names = ", ".join(f"'{c}'" for c in CLASSES)
    probs = ", ".join(r(f"round(p[{i + 1}], 12)", f"prob_{c}") for i, c in enumerate(CLASSES))
    return f"""
        SELECT item, [{names}][list_position(p, list_max(p))] AS predicted_label, {r('list_max(p)', 'confidence')}, {probs}
        FROM (SELECT item, list_transform([{sums}], lambda x: round(x, 12)) AS p FROM {{votes}} GROUP BY item)"""


@query(
    f"""SELECT item, [{', '.join(f"'{c}'" for c in CLASSES)}][list_filter(cls, lambda x: counts[x] = list_max(counts))[1]] AS predicted_label,
               {r('list_max(counts) / 3.0', 'confidence')},
               {', '.join(r(f'counts[{i + 1}] / 3.0', f'prob_{c}') for i, c in enumerate(CLASSES))}
        FROM (SELECT item, cls, list_transform([1, 2, 3, 4], lambda k: len(list_filter(cls, lambda x: x = k))) AS counts
              FROM (SELECT item, list(list_position(probs, list_max(probs)) ORDER BY model_idx) AS cls FROM {{votes}} GROUP BY item))"""
)
def vote_majority(v: Views):
    return vote_output(votes.majority_vote(v.model_probs, CLASSES))


VOTE_WEIGHTS = [0.5, 0.3, 0.2]


@query(soft_vote_sql(VOTE_WEIGHTS))
def vote_weighted(v: Views):
    return vote_output(votes.weighted_vote(v.model_probs, CLASSES, VOTE_WEIGHTS))


@query(soft_vote_sql([1.0, 1.0, 1.0]))
def vote_average(v: Views):
    return vote_output(votes.average_vote(v.model_probs, CLASSES, len(MODELS)))


# ---- learners


def checked(df: DataFrame) -> DataFrame:
    """Keyed rows with what must hold for any fit: classes from the domain, probabilities that sum to 1, arg-max."""
    names = F.array(*[F.lit(g) for g in GROUPS])
    best = F.array_max("probs")
    return df.select(
        "vec_id",
        "label",
        F.array_contains(names, F.col("predicted_label")).alias("in_domain"),
        (F.abs(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9).alias("sums_to_one"),
        ((F.array_min("probs") >= 0) & (F.abs(F.get("probs", F.array_position(names, F.col("predicted_label")).cast("int") - 1) - best) < 1e-9)).alias("is_best"),
    )


CHECKED_SQL = "SELECT vec_id, label, true AS in_domain, true AS sums_to_one, true AS is_best FROM {split_vectors}"


def fitted(v: Views) -> BoostedTreesModel:
    """The boosted trees of the vectors."""
    path = v.stored_path("trees", lambda path: fit_boosted_trees(vectors(v)).save(v.spark, path))
    return BoostedTreesModel.load(v.spark, path)


@query(f"{CHECKED_SQL} WHERE split = 'valid'")
def ml_boosted_trees(v: Views):
    return checked(fitted(v).predict(vectors(v).where("is_validation")))


@query(CHECKED_SQL)
def ml_predict_proba(v: Views):
    return checked(fitted(v).predict(vectors(v)))


@query()
def ml_feature_importance(v: Views):
    return R.top_importances(fitted(v).importances(v.spark), 20)


@query(f"{CHECKED_SQL} WHERE split = 'valid'")
def ml_ensemble(v: Views):
    data = vectors(v)
    voted = fit_ensemble(data).predict(data.where("is_validation"))
    return checked(voted.withColumn("probs", F.array(*[F.col(f"prob_{g}") for g in GROUPS])))


def searched(v: Views) -> DataFrame:
    """Trial log of the search, stored once."""
    return v.stored("trials", lambda: search.random_search(vectors(v), SEARCH_TRIALS, TreeParams())[0])


@query()
def ml_random_search(v: Views):
    return searched(v).select("number", "value", F.explode("params").alias("param", "setting"))


@query()
def ml_refit_best(v: Views):
    return search.refit_best(vectors(v), search.best_params(searched(v), TreeParams()))[1]


VALID_SQL = "(SELECT label FROM {split_vectors} WHERE split = 'valid')"


@query(
    f"""SELECT label AS class, count(*) AS support, true AS consistent FROM {VALID_SQL} GROUP BY label
        UNION ALL SELECT c, count(*), true FROM {VALID_SQL}, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) t(c) GROUP BY c"""
)
def ml_evaluate(v: Views):
    """Report on the validation rows; whether the F1 of each class follows from its precision and recall."""
    report = search.evaluate(fitted(v), vectors(v).where("is_validation"))
    p, q = F.col("precision"), F.col("recall")
    follows = F.abs(F.col("f1") - F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))) < 1e-9
    bounded = F.col("f1").between(0, 1)
    return report.select("class", "support", F.when(F.col("class").isin(GROUPS), follows & bounded).otherwise(bounded).alias("consistent"))


@query()
def ml_kfold_cv(v: Views):
    data = vectors(v).drop("is_validation")
    summary = cross_validate(data, "vec_id")[1]
    return summary.select("metric", "mean", "std", F.posexplode("values").alias("fold", "value"))


@query(
    """SELECT vec_id, concat('g', CAST(label % 3 AS VARCHAR)) AS label, m.model, true AS same
       FROM {embeddings}, (VALUES ('linear'), ('trees')) m(model)"""
)
def ml_model_roundtrip(v: Views):
    """Whether each prediction after loading equals the one before saving."""
    data = vectors(v)
    indexer = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc")
    indexer = indexer.fit(data)
    stages = [
        indexer,
        LogisticRegression(labelCol="label_id", maxIter=50, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels),
    ]
    pipeline_path, trees_path = scratch_path(v.spark, "pipeline"), scratch_path(v.spark, "trees")
    pipeline, trees = Pipeline(stages=stages).fit(data), fitted(v)
    pipeline.write().overwrite().save(pipeline_path)
    trees.save(v.spark, trees_path)
    pairs = {
        "linear": (pipeline.transform(data), PipelineModel.load(pipeline_path).transform(data)),
        "trees": (trees.predict(data), BoostedTreesModel.load(v.spark, trees_path).predict(data)),
    }
    out = []
    for name, (before, after) in pairs.items():
        earlier = before.select("vec_id", F.col("predicted_label").alias("earlier"))
        joined = after.select("vec_id", "label", "predicted_label").join(earlier, "vec_id")
        out.append(joined.select("vec_id", "label", F.lit(name).alias("model"), (F.col("earlier") == F.col("predicted_label")).alias("same")))
    return out[0].unionByName(out[1])


DIMENSIONS = 64
CENTRES_SQL = "SELECT label % 3 AS g, i, avg(CAST(embedding[i] AS DOUBLE)) AS w FROM {embeddings}, range(1, 65) t(i) GROUP BY label % 3, i"


@query(
    f"""SELECT vec_id, label, ['g0', 'g1', 'g2'][list_position(p, list_max(p))] AS predicted_label,
               {r('list_max(p)', 'confidence')}, {', '.join(r(f'p[{k + 1}]', f'prob_g{k}') for k in range(3))}
        FROM (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p
              FROM (SELECT vec_id, label, list(s ORDER BY g) AS z
                    FROM (SELECT e.vec_id, e.label, c.g, sum(CAST(e.embedding[c.i] AS DOUBLE) * c.w) - 0.5 * sum(c.w * c.w) AS s
                          FROM {{embeddings}} e, ({CENTRES_SQL}) c GROUP BY e.vec_id, e.label, c.g)
                    GROUP BY vec_id, label))"""
)
def udf_batch_score(v: Views):
    """A linear model outside the JVM: nearest class centre, as logits."""
    table = v.table("embeddings").select("vec_id", "label", "embedding")
    cells = table.select((F.col("label") % 3).alias("g"), F.posexplode("embedding").alias("i", "x"))
    centres = cells.groupBy("g").pivot("i", list(range(DIMENSIONS))).agg(F.avg(F.col("x").cast("double"))).orderBy("g")
    weights = np.array([list(row)[1:] for row in centres.collect()])  # a row for each of three classes
    scored = score_table(table, weights, -0.5 * np.square(weights).sum(axis=1), GROUPS, "embedding", batch_size=4096)
    return scored.drop("embedding")


TERMS = 100


@query()
def ml_feature_set_ab(v: Views):
    """Text-only columns against knowledge columns, same split, same learner."""
    items = S.stratified_split(
        v.items.select("doc_id", "item", "name", "description", "type", "subcategory", "label"), "doc_id", test_share=0.5
    )
    lengths = text.with_text_lengths(items).drop("name", "description")
    onehot = X.with_onehot_observed(X.with_onehot_fixed(lengths, "type", X.TYPES, "type"), "subcategory", "category")
    enriched = attach_features(onehot, v.raw_features)
    # the vocabulary is fitted on the training half only
    docs = items.select("doc_id", "description", "split")
    train = docs.where("split = 'train'")
    counts = cut_lineage(T.candidate_term_counts(docs, "doc_id", "description", TERMS, train))
    train_counts = counts.join(train.select("doc_id"), "doc_id", "left_semi")
    model = T.fit_idf(train_counts, train.agg(F.count(F.lit(1))).scalar(), TERMS)
    vectors_ = T.widened(docs, T.tfidf(counts, cut_lineage(model), "doc_id"), "doc_id", TERMS)
    table = cut_lineage(
        X.engineer(X.with_default_features(enriched))
        .join(vectors_, "doc_id")
        .withColumn("is_validation", F.col("split") == "valid")
    )
    basic = ["name_length", "desc_length", "name_word_count", "desc_word_count", "type_entity", "type_concept"]
    basic += sorted(c for c in table.columns if c.startswith("category_"))
    basic += [f"tfidf_{i}" for i in range(TERMS)]
    scored = []
    for name, columns in (("basic", basic), ("enriched", X.FEATURES_33)):
        data = cut_lineage(assemble(table, columns, ["item", "label", "is_validation"]))
        predicted = fit_boosted_trees(data, TreeParams(), features=columns, in_tasks=True).predict(data.where("is_validation"))
        scored.append(predicted.select("label", "predicted_label", F.lit(name).alias("model")))
    return E.feature_set_comparison(scored[0].unionByName(scored[1]), "basic", "enriched")


# ---- the published training path on the 33 engineered columns, as one saved bundle


def bundle_rows(v: Views) -> DataFrame:
    """Labelled items with their 33 features and the stratified 80/20 flag, stored once."""

    def build() -> DataFrame:
        items = S.stratified_split(v.items.select("doc_id", "item", "label"), "doc_id")
        featured = X.matrix_33(attach_features(items, v.raw_features), ["item", "label", "split"])
        return featured.withColumn("is_validation", F.col("split") == "valid")

    return v.stored("bundle-rows", build)


def bundled(v: Views) -> PipelineModel:
    """The bundle fitted at the published settings, saved once and read back as Spark's PipelineModel."""
    path = v.stored_path("bundle", lambda path: B.fit_bundle(bundle_rows(v), list(X.FEATURES_33)).write().save(path))
    return PipelineModel.load(path)


@query()
def ml_bundle_predictions(v: Views):
    """Item, label, predicted label, confidence and one probability per class from the loaded bundle."""
    scored = B.predict(bundled(v), bundle_rows(v))
    labels = bundled(v).stages[-1].getLabels()
    return scored.select("item", "label", "split", "predicted_label", "confidence", *[F.col("probs")[i].alias(f"prob_{c}") for i, c in enumerate(labels)])


@query()
def ml_bundle_importance(v: Views):
    """Importances of the bundle's trees by the names of the 33 features."""
    return R.top_importances(B.importances(v.spark, bundled(v)), 33)
