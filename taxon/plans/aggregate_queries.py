"""Aggregates, rankings, splits and text vectors (survey sections 2.5, 2.7, 2.9 and 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions import documents as D
from taxon.functions import features as X
from taxon.functions import labels as L
from taxon.functions import prompts, text
from taxon.operators import experiments as E
from taxon.operators import joins as J
from taxon.operators import metrics as M
from taxon.operators import profile as P
from taxon.operators import ranking as R
from taxon.operators import splits as S
from taxon.operators import tfidf as T
from taxon.operators.augment import augment_texts
from taxon.plans.registry import query, r
from taxon.plans.scalar_queries import ENRICHED_TEXT_SQL, LENGTHS_SQL
from taxon.plans.source_queries import DISTRIBUTION_SQL, OVERALL_SQL, split_tables
from taxon.plans.views import CLASSES, MODELS, Views, scores_by
from taxon.session import cut_lineage

# ---- distributions and profiles


@query(DISTRIBUTION_SQL)
def agg_class_distribution(v: Views):
    return P.class_distribution(S.tagged_union(*split_tables(v)))


@query(
    "SELECT subcategory, count(*) AS count, "
    + r("100.0 * count(*) / (SELECT count(*) FROM {items})", "pct")
    + " FROM {items} WHERE subcategory IS NOT NULL GROUP BY subcategory"
)
def agg_value_counts_pct(v: Views):
    return P.value_counts(v.items, "subcategory")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, "
        + ", ".join(
            [
                r(f"avg({c})", "mean"),
                r(f"quantile_cont({c}, 0.5)", "median"),
                r(f"min({c})", "min"),
                r(f"max({c})", "max"),
                f"count(CASE WHEN {c} <> 0 THEN 1 END) AS nonzero",
                r(f"100.0 * count(CASE WHEN {c} <> 0 THEN 1 END) / count(*)", "nonzero_pct"),
            ]
        )
        + " FROM {raw_features}"
        for c in D.RAW_COUNTS
    )
)
def agg_numeric_profile(v: Views):
    return P.numeric_profile(v.raw_features, D.RAW_COUNTS, accuracy=500)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(CASE WHEN {c} THEN 1 END) AS true_count, "
        + r(f"100.0 * count(CASE WHEN {c} THEN 1 END) / count(*)", "true_pct")
        + f", count(CASE WHEN NOT {c} THEN 1 END) AS false_count, "
        + r(f"100.0 * count(CASE WHEN NOT {c} THEN 1 END) / count(*)", "false_pct")
        + " FROM {raw_features}"
        for c in D.RAW_FLAGS
    )
)
def agg_bool_profile(v: Views):
    return P.boolean_profile(v.raw_features, D.RAW_FLAGS)


COVERED = ["num_languages", "num_statements", "en_page_length"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(CASE WHEN {c} > 0 THEN 1 END) AS covered, "
        + r(f"100.0 * count(CASE WHEN {c} > 0 THEN 1 END) / count(*)", "covered_pct")
        + " FROM {raw_features}"
        for c in COVERED
    )
)
def agg_coverage(v: Views):
    return P.coverage(v.raw_features, COVERED)


@query(
    "SELECT i.label, count(*) AS rows, "
    + ", ".join(r(f"avg(f.{c})", f"avg_{c}") for c in COVERED)
    + ", count(CASE WHEN f.has_country THEN 1 END) AS with_has_country, "
    + r("100.0 * count(CASE WHEN f.has_country THEN 1 END) / count(*)", "pct_has_country")
    + r" FROM {items} i LEFT JOIN {raw_features} f ON f.qid = regexp_extract(i.item, 'Q\d+', 0) GROUP BY i.label"
)
def agg_by_label(v: Views):
    enriched = J.attach_features(v.items.select("item", "label"), v.raw_features)
    return P.feature_means_by_label(enriched, COVERED, ["has_country"])


# ---- confidence

C = "confidence"


@query(
    "SELECT "
    + ", ".join(
        [
            r("avg(confidence)", "mean"),
            r("stddev_samp(confidence)", "std"),
            r("min(confidence)", "min"),
            r("max(confidence)", "max"),
            r("quantile_cont(confidence, 0.25)", "q25"),
            r("quantile_cont(confidence, 0.5)", "median"),
            r("quantile_cont(confidence, 0.75)", "q75"),
        ]
    )
    + " FROM {preds}"
)
def agg_confidence_stats(v: Views):
    return P.confidence_stats(v.preds, accuracy=250)


@query(
    "SELECT "
    + ", ".join([r(f"{f}({C})", n) for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))])
    + " FROM {preds}"
)
def agg_confidence_pop(v: Views):
    return P.confidence_stats_population(v.preds)


def by_sql(key: str, where: str = "") -> str:
    return (
        f"SELECT {key}, {r('avg(confidence)', 'mean')}, {r('stddev_samp(confidence)', 'std')}, count(*) AS count "
        f"FROM (SELECT *, label = predicted_label AS correct FROM {{preds}}) {where} GROUP BY {key}"
    )


@query(by_sql("predicted_label"))
def agg_confidence_by_class(v: Views):
    return P.confidence_by(v.preds, "predicted_label")


@query(by_sql("correct"))
def agg_confidence_by_correct(v: Views):
    return P.confidence_by(L.with_correct_flag(v.preds), "correct")


@query(by_sql("label", "WHERE correct"))
def agg_confidence_correct_class(v: Views):
    return P.confidence_by(v.preds.where(F.col("label") == F.col("predicted_label")), "label")


@query(
    f"""SELECT CAST(t AS DOUBLE) AS threshold, count(CASE WHEN confidence < t THEN 1 END) AS count,
               {r('100.0 * count(CASE WHEN confidence < t THEN 1 END) / count(*)', 'pct')}
        FROM {{preds}}, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.6 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE))) v(t)
        GROUP BY t"""
)
def agg_threshold_sweep(v: Views):
    return P.threshold_sweep(v.preds)


@query(
    """SELECT p.category, t.total, p.predicted_label, count(*) AS count
       FROM {preds} p
       JOIN (SELECT category, count(*) AS total FROM {preds} GROUP BY category ORDER BY total DESC, category LIMIT 10) t
         ON t.category = p.category
       WHERE p.category <> '' GROUP BY p.category, t.total, p.predicted_label"""
)
def agg_top_category_crosstab(v: Views):
    return P.top_key_crosstab(v.preds)


@query("SELECT type, predicted_label, count(*) AS count FROM {preds} WHERE type <> '' GROUP BY type, predicted_label")
def agg_type_crosstab(v: Views):
    return P.crosstab(v.preds, "type")


@query(
    f"""SELECT count(*) AS rows, count(CASE WHEN found THEN 1 END) AS found,
               {r('100.0 * count(CASE WHEN found THEN 1 END) / count(*)', 'found_pct')},
               {r('avg(length(original))', 'avg_length_before')},
               {r(f'avg(length({ENRICHED_TEXT_SQL}))', 'avg_length_after')}
        FROM {{enriched}}"""
)
def agg_enrichment_stats(v: Views):
    catalogue = v.view("catalogue").withColumn("original", F.col("description"))
    enriched = J.enrich_by_name(catalogue, v.view("lookup"))
    summary = text.truncated(F.col("summary"))
    after = enriched.withColumn(
        "description", prompts.enriched_description(F.col("description"), summary, F.col("languages"))
    )
    return P.enrichment_stats(after, "original", "description", "found")


# ---- metrics


@query(f"SELECT {r('avg(CASE WHEN label = predicted_label THEN 1 ELSE 0 END)', 'accuracy')} FROM {{preds}}")
def metric_accuracy(v: Views):
    return M.accuracy(v.preds)


@query(
    f"""SELECT class, {r('p', 'precision')}, {r('r', 'recall')}, {r('f', 'f1')}, CAST(support AS BIGINT) AS support
        FROM {{class_scores}}"""
)
def metric_per_class(v: Views):
    return M.per_class(v.preds)


@query(
    f"SELECT {r('avg(p)', 'precision_macro')}, {r('avg(r)', 'recall_macro')}, {r('avg(f)', 'f1_macro')} FROM {{class_scores}}"
)
def metric_macro(v: Views):
    return M.macro(v.preds)


WEIGHTED_SQL = ", ".join(
    r(f"sum({c} * support) / sum(support)", n)
    for c, n in (("p", "precision_weighted"), ("r", "recall_weighted"), ("f", "f1_weighted"))
)


@query(f"SELECT {WEIGHTED_SQL} FROM {{class_scores}}")
def metric_weighted(v: Views):
    return M.weighted(v.preds)


@query(f"SELECT cohen_kappa FROM ({OVERALL_SQL})")
def metric_kappa(v: Views):
    return M.kappa(v.preds)


CONFUSION_SQL = """
    SELECT a.class AS label, b.class AS predicted_label, coalesce(c.n, 0) AS count
    FROM {class_scores} a CROSS JOIN {class_scores} b
    LEFT JOIN {confusion} c ON c.label = a.class AND c.predicted_label = b.class"""


@query(CONFUSION_SQL)
def metric_confusion(v: Views):
    return M.confusion_matrix(v.preds)


@query(
    f"""SELECT label, predicted_label,
               {r('CASE WHEN sum(count) OVER (PARTITION BY label) = 0 THEN 0 ELSE count / CAST(sum(count) OVER (PARTITION BY label) AS DOUBLE) END', 'share')}
        FROM ({CONFUSION_SQL})"""
)
def metric_confusion_norm(v: Views):
    return M.confusion_matrix_normalised(v.preds)


REPORT_SQL = f"""
    SELECT class, {r('p', 'precision')}, {r('r', 'recall')}, {r('f', 'f1')}, CAST(support AS BIGINT) AS support
    FROM {{class_scores}}
    UNION ALL
    SELECT 'accuracy', NULL, NULL, {r('sum(tp) / sum(support)', 'f1')}, CAST(sum(support) AS BIGINT) FROM {{class_scores}}
    UNION ALL
    SELECT 'macro avg', {r('avg(p)', 'p')}, {r('avg(r)', 'r')}, {r('avg(f)', 'f')}, CAST(sum(support) AS BIGINT)
    FROM {{class_scores}}
    UNION ALL
    SELECT 'weighted avg', {WEIGHTED_SQL}, CAST(sum(support) AS BIGINT) FROM {{class_scores}}"""


@query(REPORT_SQL)
def metric_report(v: Views):
    return M.report(v.preds)


@query(
    f"""SELECT label, predicted_label AS misclassified_as, n AS count, CAST(errors AS BIGINT) AS total_errors,
               CAST(total AS BIGINT) AS total_samples, {r('100.0 * errors / total', 'error_rate')},
               {r('100.0 * n / errors', 'pct_of_errors')}
        FROM (SELECT c.*, sum(n) OVER (PARTITION BY label) AS total,
                     sum(CASE WHEN label <> predicted_label THEN n ELSE 0 END) OVER (PARTITION BY label) AS errors
              FROM {{confusion}} c)
        WHERE label <> predicted_label"""
)
def metric_error_breakdown(v: Views):
    return M.error_breakdown(v.preds)


ERRORS_SQL = """
    SELECT label, predicted_label, n, sum(n) OVER (PARTITION BY label) AS total,
           sum(CASE WHEN label <> predicted_label THEN n ELSE 0 END) OVER (PARTITION BY label) AS errors
    FROM {confusion}"""


def flat_sql(section: str, key: str, metrics: dict[str, str], source: str) -> str:
    """Rows of one section of the flat report, a statement for each metric."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, {r(x, 'value')} FROM {source} WHERE ({x}) IS NOT NULL"
        for m, x in metrics.items()
    )


SCORES = ["accuracy", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "cohen_kappa"]
PER_CLASS = {"precision": "p", "recall": "r", "f1": "f", "support": "support"}
PAIR = "concat(label, '>', predicted_label)"


@query(
    " UNION ALL ".join(
        [
            flat_sql("dataset", "'all'", {"size": "n"}, "(SELECT count(*) AS n FROM {preds})"),
            flat_sql("overall_metrics", "'all'", {m: m for m in SCORES}, f"({OVERALL_SQL})"),
            flat_sql("per_class_metrics", "class", PER_CLASS, "{class_scores}"),
            flat_sql(
                "error_analysis",
                "label",
                {"total_errors": "errors", "total_samples": "total", "error_rate": "100.0 * errors / total"},
                f"(SELECT DISTINCT label, errors, total FROM ({ERRORS_SQL}) WHERE errors > 0)",
            ),
            flat_sql("error_analysis", PAIR, {"count": "n"}, "(SELECT * FROM {confusion} WHERE label <> predicted_label)"),
            flat_sql("confusion_matrix", PAIR, {"count": "count"}, f"({CONFUSION_SQL})"),
            flat_sql(
                "confusion_matrix_normalized",
                PAIR,
                {"share": "CASE WHEN s = 0 THEN 0 ELSE count / CAST(s AS DOUBLE) END"},
                f"(SELECT *, sum(count) OVER (PARTITION BY label) AS s FROM ({CONFUSION_SQL}))",
            ),
            flat_sql("classification_report", "class", {"precision": "precision", "recall": "recall", "f1": "f1", "support": "support"}, f"({REPORT_SQL})"),
        ]
    )
)
def metric_full_report(v: Views):
    return M.flat_report(M.full_report(v.preds))


P_TRUE = "probs[CASE label WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 END]"
WEIGHTS_SQL = """
    SELECT label, count(*) AS count, (SELECT count(*) FROM {items}) / CAST(count(*) * (SELECT count(DISTINCT label) FROM {items}) AS DOUBLE) AS weight
    FROM {items} GROUP BY label"""


@query(f"SELECT {r(f'avg(-ln({P_TRUE}))', 'log_loss')} FROM {{preds}}")
def metric_log_loss(v: Views):
    return M.log_loss(v.preds, CLASSES)


@query(f"SELECT label, count, {r('weight', 'weight')} FROM ({WEIGHTS_SQL})")
def agg_class_weights(v: Views):
    return E.class_weights(v.items)


LOSS_SQL = f"""
    SELECT p.item, w.weight,
           CAST(0.9 AS DOUBLE) * w.weight * -ln({P_TRUE.replace('label', 'p.label')})
           + CAST(0.1 AS DOUBLE) / 4 * (SELECT sum(c.weight * -ln(p.probs[CASE c.label WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 END]))
                                        FROM ({WEIGHTS_SQL}) c) AS loss
    FROM {{preds}} p JOIN ({WEIGHTS_SQL}) w ON w.label = p.label"""


@query(f"SELECT {r('sum(loss) / sum(weight)', 'cross_entropy')} FROM ({LOSS_SQL})")
def metric_weighted_ce(v: Views):
    return M.weighted_cross_entropy(v.preds, CLASSES, E.class_weights(v.items))


@query(
    f"""SELECT {r('avg(power(1 - exp(-loss), 2) * loss)', 'focal_mean')},
               {r('sum(power(1 - exp(-loss), 2) * loss)', 'focal_sum')} FROM ({LOSS_SQL})"""
)
def metric_focal_loss(v: Views):
    return M.focal_loss(v.preds, CLASSES, E.class_weights(v.items))


# ---- comparisons

METRIC_SQL = {
    "accuracy": "sum(tp) / sum(support)",
    "f1_macro": "avg(f)",
    "f1_weighted": "sum(f * support) / sum(support)",
    "precision_macro": "avg(p)",
    "precision_weighted": "sum(p * support) / sum(support)",
    "recall_macro": "avg(r)",
    "recall_weighted": "sum(r * support) / sum(support)",
    "cohen_kappa": "(sum(tp) / sum(support) - sum(support * npred) / (sum(support) * sum(support)))"
    " / (1 - sum(support * npred) / (sum(support) * sum(support)))",
}


def metrics_long_sql(source: str, by: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT g, '{m}' AS metric, CAST({METRIC_SQL[m]} AS DOUBLE) AS value FROM ({scores_by(source, by)}) GROUP BY g"
        for m in names
    )


FOLD_PREDS = "(SELECT p.label, p.predicted_label, f.fold FROM {preds} p JOIN {fold_items} f ON f.item = p.item)"
FOLD_SQL = metrics_long_sql(FOLD_PREDS, "fold", list(METRIC_SQL))


def fold_predictions(v: Views) -> DataFrame:
    return S.stratified_folds(v.preds.select("doc_id", "label", "predicted_label"), "doc_id")


@query(
    f"""SELECT metric, {r('avg(value) OVER (PARTITION BY metric)', 'mean')},
               {r('stddev_pop(value) OVER (PARTITION BY metric)', 'std')}, CAST(g AS INTEGER) AS fold, {r('value', 'value')}
        FROM ({FOLD_SQL})"""
)
def agg_fold_summary(v: Views):
    summary = E.fold_summary(E.fold_metrics(fold_predictions(v)))
    return summary.select("metric", "mean", "std", F.posexplode("values").alias("fold", "value"))


@query(
    f"""SELECT CAST(g AS INTEGER) AS fold, {r('value', 'f1_macro')}
        FROM ({metrics_long_sql(FOLD_PREDS, 'fold', ['f1_macro'])}) ORDER BY value DESC, g LIMIT 1"""
)
def topk_best_fold(v: Views):
    return E.best_row(E.fold_metrics(fold_predictions(v)), "f1_macro", "fold").select("fold", "f1_macro")


MODEL_SPLITS = """(SELECT m.label, m.predicted_label, concat(m.model, '|', s.split) AS ms
                   FROM {model_preds} m JOIN {split_items} s ON s.item = m.item)"""
COMPARISON_METRICS = ["f1_macro", "f1_weighted", "accuracy", "precision_macro", "recall_macro"]


@query(
    "SELECT string_split(g, '|')[1] AS model, string_split(g, '|')[2] AS split, "
    + ", ".join(r(METRIC_SQL[m], m) for m in COMPARISON_METRICS)
    + f" FROM ({scores_by(MODEL_SPLITS, 'ms')}) GROUP BY g"
)
def agg_model_comparison(v: Views):
    split = S.stratified_split(v.model_probs, "doc_id")
    names = F.array(*[F.lit(m) for m in MODELS])
    long = split.select("label", "split", F.posexplode("model_probs").alias("model_idx", "probs"))
    scored = L.with_prediction(long.withColumn("model", F.get(names, F.col("model_idx"))), CLASSES)
    return E.model_comparison(scored)


@query(
    f"""SELECT metric, round(a, 4) AS basic, round(b, 4) AS enriched, round(b - a, 4) AS improvement,
               round((b - a) / a * 100, 4) AS relative_pct
        FROM (SELECT metric, max(CASE WHEN g = 'letters' THEN value END) AS a,
                     max(CASE WHEN g = 'words_a' THEN value END) AS b
              FROM ({metrics_long_sql('{model_preds}', 'model', COMPARISON_METRICS)}) GROUP BY metric)"""
)
def agg_feature_set_comparison(v: Views):
    return E.feature_set_comparison(v.model_preds, "letters", "words_a")


@query(
    f"""SELECT g AS model, {r('value', 'f1_macro')}, {r('value / sum(value) OVER ()', 'weight')}
        FROM ({metrics_long_sql('{model_preds}', 'model', ['f1_macro'])})"""
)
def agg_ensemble_weights(v: Views):
    return E.ensemble_weights(v.model_preds)


@query(
    f"""SELECT label, coalesce(max(CASE WHEN split = 'train' THEN pct END), 0.0) AS train,
               coalesce(max(CASE WHEN split = 'valid' THEN pct END), 0.0) AS valid
        FROM ({DISTRIBUTION_SQL}) GROUP BY label"""
)
def agg_distribution_wide(v: Views):
    return P.distribution_wide(S.tagged_union(*split_tables(v)), ["train", "valid"])


@query(
    "SELECT class, "
    + ", ".join(r(f"max(CASE WHEN g = '{m}' THEN f END)", m) for m in MODELS)
    + f" FROM ({scores_by('{model_preds}', 'model')}) GROUP BY class"
)
def agg_f1_wide(v: Views):
    return M.f1_wide(v.model_preds, MODELS)


# ---- top-k


@query(
    f"""SELECT item, predicted_label, {r(C, C)}, 'most' AS side
        FROM (SELECT * FROM {{preds}} ORDER BY confidence DESC, item LIMIT 10)
        UNION ALL
        SELECT item, predicted_label, {r(C, C)}, 'least' AS side
        FROM (SELECT * FROM {{preds}} ORDER BY confidence, item LIMIT 10)"""
)
def topk_confidence(v: Views):
    return R.most_and_least_confident(v.preds)


@query(
    f"""SELECT item, label, predicted_label, {r(C, C)}
        FROM (SELECT * FROM {{preds}} WHERE label <> predicted_label ORDER BY confidence, item LIMIT 10)"""
)
def topk_errors(v: Views):
    return R.least_confident_errors(v.preds)


# ---- splits and augmentation


@query("SELECT item, label, split FROM {split_items}")
def split_stratified(v: Views):
    return S.stratified_split(v.items.select("doc_id", "item", "label"), "doc_id").select("item", "label", "split")


@query("SELECT item, label, fold FROM {fold_items}")
def split_stratified_kfold(v: Views):
    return S.stratified_folds(v.items.select("doc_id", "item", "label"), "doc_id").select("item", "label", "fold")


COIN = "substring(md5(concat(CAST(doc_id AS VARCHAR), '|42')), 1, 1) >= '8'"


@query(
    f"""SELECT doc_id, label, 0 AS version, description AS text FROM {{items}}
        UNION ALL
        SELECT doc_id, label, 1 AS version,
               list_aggregate(list_transform(list_sort(list_transform(range(1, len(s) + 1),
                   lambda i: md5(concat(CAST(doc_id AS VARCHAR), '|42|', CAST(i - 1 AS VARCHAR))) || ':' || CAST(i AS VARCHAR))),
                   lambda h: s[CAST(string_split(h, ':')[2] AS BIGINT)]), 'string_agg', '. ') AS text
        FROM (SELECT doc_id, label, string_split(description, '. ') AS s FROM {{items}} WHERE {COIN})
        WHERE len(s) > 2"""
)
def udtf_augment_text(v: Views):
    texts = v.items.select("doc_id", "label", F.col("description").alias("text"))
    return augment_texts(texts, "doc_id")


# ---- text vectors

WORDS_SQL = r"regexp_extract_all(lower(description), '[\pL\pN_]{2,}')"
TERMS_SQL = f"""
    SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM (SELECT doc_id, {WORDS_SQL} AS w FROM {{items}})"""
TFIDF_CTE = f"""
    WITH terms AS ({TERMS_SQL}),
         vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS position
                   FROM (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 100)),
         tf AS (SELECT t.doc_id, t.term, v.position, count(*) AS tf FROM terms t JOIN vocab v ON v.term = t.term
                GROUP BY t.doc_id, t.term, v.position),
         idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {{items}})) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
                 FROM tf GROUP BY term),
         cells AS (SELECT doc_id, tf.term, position,
                          tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS tfidf
                   FROM tf JOIN idf ON idf.term = tf.term)"""


def tfidf_sql(body: str) -> str:
    return f"SELECT * FROM ({TFIDF_CTE} {body})"


@query(tfidf_sql(f"SELECT doc_id, term, CAST(position AS INTEGER) AS position, {r('tfidf', 'tfidf')} FROM cells"))
def text_tfidf_topn(v: Views):
    docs = v.items.select("doc_id", "description")
    counts = cut_lineage(T.candidate_term_counts(docs, "doc_id", "description"))
    return T.tfidf(counts, T.fit_idf(counts, docs.agg(F.count(F.lit(1))).scalar()), "doc_id")


@query(
    tfidf_sql(
        f"SELECT i.item, {LENGTHS_SQL}, "
        + ", ".join(f"CASE WHEN type = '{t}' THEN 1 ELSE 0 END AS type_{t}" for t in X.TYPES)
        + ", "
        + ", ".join(f"CASE WHEN subcategory = '{c}' THEN 1 ELSE 0 END AS category_{c}" for c in CLASSES)
        + ", "
        + ", ".join(r(f"coalesce(w.c{i}, 0)", f"tfidf_{i}") for i in range(100))
        + " FROM {items} i LEFT JOIN (SELECT doc_id, "
        + ", ".join(f"max(CASE WHEN position = {i} THEN tfidf END) AS c{i}" for i in range(100))
        + " FROM cells GROUP BY doc_id) w ON w.doc_id = i.doc_id"
    )
)
def feat_basic_set(v: Views):
    docs = v.items.select("doc_id", "description")
    counts = cut_lineage(T.candidate_term_counts(docs, "doc_id", "description"))
    vectors = T.widened(docs, T.tfidf(counts, T.fit_idf(counts, docs.agg(F.count(F.lit(1))).scalar()), "doc_id"), "doc_id")
    basic = text.with_text_lengths(v.items)
    basic = X.with_onehot_observed(basic, "type", "type")
    basic = X.with_onehot_observed(basic, "subcategory", "category")
    basic = basic.drop("name", "description", "type", "category", "subcategory", "label")
    return basic.join(vectors, "doc_id").drop("doc_id")
