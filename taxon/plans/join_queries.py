"""Joins and set operations (survey sections 2.4 and 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxon.functions import documents as D
from taxon.functions import prompts, text
from taxon.operators import joins as J
from taxon.operators import metrics as M
from taxon.operators.splits import tagged_union
from taxon.plans.registry import query, r
from taxon.plans.scalar_queries import ENRICHED_TEXT_SQL
from taxon.plans.source_queries import split_tables
from taxon.plans.views import Views


@query(
    "SELECT item, label, "
    + ", ".join(D.RAW_FEATURES)
    + r" FROM {items} i LEFT JOIN {raw_features} f ON f.qid = regexp_extract(i.item, 'Q\d+', 0)"
)
def join_features(v: Views):
    items = v.items.select("item", "label")
    return J.attach_features(items, v.raw_features).select("item", "label", *D.RAW_FEATURES)


@query(
    f"""SELECT p.item, i.name, i.label, p.predicted_label, {r('p.confidence', 'confidence')}
        FROM {{preds}} p JOIN {{items}} i ON i.item = p.item"""
)
def join_eval(v: Views):
    return J.evaluation_frame(v.items, v.preds)


@query(
    """SELECT count(*) AS truth_rows, count(p.item) AS matched_rows, count(*) - count(p.item) AS unmatched_rows
       FROM {items} i LEFT JOIN (SELECT item FROM {preds} WHERE type = 'entity') p ON p.item = i.item"""
)
def join_coverage_anti(v: Views):
    scored = v.preds.where(F.col("type") == "entity")
    return J.require_coverage(v.items, scored)


@query("SELECT item, name, summary, found, languages FROM {enriched}")
def join_lookup_enrich(v: Views):
    enriched = J.enrich_by_name(v.view("catalogue"), v.view("lookup"))
    return enriched.select("item", "name", "summary", "found", "languages")


@query(
    f"""SELECT count(*) AS matched_rows, {r('avg(length(original))', 'avg_length_before')},
               {r('avg(length(after_text))', 'avg_length_after')},
               count(CASE WHEN original <> after_text THEN 1 END) AS changed_rows
        FROM (SELECT original, {ENRICHED_TEXT_SQL} AS after_text FROM {{enriched}})"""
)
def join_before_after(v: Views):
    catalogue = v.view("catalogue")
    enriched = J.enrich_by_name(catalogue, v.view("lookup"))
    summary = text.truncated(F.col("summary"))
    after = enriched.withColumn(
        "description", prompts.enriched_description(F.col("description"), summary, F.col("languages"))
    )
    return J.compare_versions(catalogue, after, "item", "description")


@query(
    """SELECT c.item, b.qid
       FROM {catalogue} c
       LEFT JOIN (SELECT key, qid FROM (SELECT lower(p_name) AS key, concat('Q', CAST(p_partkey AS VARCHAR)) AS qid,
                         row_number() OVER (PARTITION BY lower(p_name)
                                            ORDER BY p_size, concat('Q', CAST(p_partkey AS VARCHAR))) AS rn FROM {part})
                  WHERE rn = 1) b ON b.key = lower(c.name)"""
)
def join_resolve_name_top1(v: Views):
    index = v.table("part").select(
        F.col("p_name").alias("label"),
        F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"),
        F.col("p_size").alias("rank"),
    )
    return J.resolve_names(v.view("catalogue"), index).select("item", "qid")


@query("SELECT label FROM {preds} UNION SELECT predicted_label FROM {preds}")
def set_label_union(v: Views):
    return M.label_domain(v.preds)


@query("SELECT item, label, CASE WHEN type = 'entity' THEN 'train' ELSE 'valid' END AS split FROM {items}")
def set_split_union(v: Views):
    return tagged_union(*split_tables(v)).select("item", "label", "split")
