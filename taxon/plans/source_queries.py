"""Sources, sinks and the lookup cache (survey section 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxon.operators import metrics as M
from taxon.operators import profile as P
from taxon.operators import ranking as R
from taxon.operators.splits import tagged_union
from taxon.plans.registry import query, r
from taxon.plans.views import DOCUMENTS_PER_TASK, Views
from taxon.session import scratch_path
from taxon.sources import documents, lookup_cache, sinks, tables

ITEM_COLUMNS = [*tables.REQUIRED_COLUMNS, "label"]


# an empty field reads as NULL
@query(
    """SELECT item, nullif(name, '') AS name, nullif(description, '') AS description, type,
              nullif(category, '') AS category, subcategory, label
       FROM {items}"""
)
def src_csv_roundtrip(v: Views):
    path = scratch_path(v.spark, "items-csv")
    # two files whose columns stand in different orders; descriptions hold line breaks
    items = v.items.select(*ITEM_COLUMNS)
    sinks.write_delimited(items.where(F.col("type") == "entity"), f"{path}/entity")
    sinks.write_delimited(items.where(F.col("type") != "entity").select(*reversed(ITEM_COLUMNS)), f"{path}/concept")
    return tables.read_csv(v.spark, [f"{path}/entity", f"{path}/concept"], multi_line=True)


@query(
    """SELECT subcategory AS label, type AS kind, count(*) AS count
       FROM {items} WHERE subcategory IS NOT NULL GROUP BY subcategory, type"""
)
def src_glob_union(v: Views):
    root = scratch_path(v.spark, "labels-csv")
    items = v.items.select("item", "type", F.col("subcategory").alias("label"))
    for kind in ("entity", "concept"):
        order = ["item", "label"] if kind == "entity" else ["label", "item"]
        sinks.write_delimited(items.where(F.col("type") == kind).select(*order), f"{root}/{kind}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("item", "label")])
    pooled = tables.read_labels(v.spark, [f"{root}/entity", f"{root}/concept"], schema=schema)
    kind = F.regexp_extract("file", "/(entity|concept)/[^/]*$", 1)
    return pooled.groupBy("label", kind.alias("kind")).count()


@query(
    """SELECT item, name, description, '' AS type, '' AS category, coalesce(subcategory, '') AS subcategory
       FROM {items}"""
)
def src_required_columns(v: Views):
    path = scratch_path(v.spark, "partial-csv")
    sinks.write_delimited(v.items.select("subcategory", "item", "description", "name"), path)
    partial = tables.read_csv(v.spark, path, multi_line=True)
    return tables.with_required_columns(partial).select(*tables.REQUIRED_COLUMNS)


@query(
    """SELECT qid, CAST(k + CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 0 END
                   + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_sitelinks,
              CAST(1 + p17 + p495 + p2596 + p625 + p131 + p27 + p361 + p214 + p345 + p1566 + p18 AS INTEGER) AS n_claims
       FROM {claim_flags}
       UNION ALL
       SELECT concat('Q', CAST(1000000000000 + n_nationkey AS VARCHAR)), 0, 0 FROM {nation}"""
)
def src_entity_json(v: Views):
    path = scratch_path(v.spark, "entities")
    # gzip shrinks the repetitive documents; a compressed file is read by one task, so files stay small
    v.entity_docs.write.option("maxRecordsPerFile", DOCUMENTS_PER_TASK).json(path, compression="gzip")
    entities = documents.read_entities(v.spark, path)
    return entities.select("qid", F.size("sitelinks").alias("n_sitelinks"), F.size("claims").alias("n_claims"))


@query(
    """SELECT title, 1 AS n_pages, CASE WHEN missing = 1 THEN '-1' ELSE CAST(page_id AS VARCHAR) END AS page_key
       FROM {page_counts}"""
)
def src_page_json(v: Views):
    path = scratch_path(v.spark, "pages")
    v.page_docs.write.json(path)
    pages = documents.read_pages(v.spark, path)
    return pages.select("title", F.size("pages").alias("n_pages"), F.get(F.map_keys("pages"), F.lit(0)).alias("page_key"))


@query(
    """SELECT *, 'csv' AS format FROM {raw_features} UNION ALL SELECT *, 'tsv' AS format FROM {raw_features}"""
)
def sink_csv_tsv(v: Views):
    features = v.raw_features
    out = []
    for name, sep in (("csv", ","), ("tsv", "\t")):
        path = scratch_path(v.spark, f"features-{name}")
        sinks.write_delimited(features, path, sep)
        out.append(tables.read_csv(v.spark, path, features.schema, sep).withColumn("format", F.lit(name)))
    return out[0].unionByName(out[1])


OVERALL_SQL = f"""
    SELECT {r('sum(tp) / sum(support)', 'accuracy')}, {r('avg(f)', 'f1_macro')},
           {r('sum(f * support) / sum(support)', 'f1_weighted')}, {r('avg(p)', 'precision_macro')},
           {r('sum(p * support) / sum(support)', 'precision_weighted')}, {r('avg(r)', 'recall_macro')},
           {r('sum(r * support) / sum(support)', 'recall_weighted')},
           {r('(sum(tp) / sum(support) - sum(support * npred) / (sum(support) * sum(support))) / (1 - sum(support * npred) / (sum(support) * sum(support)))', 'cohen_kappa')}
    FROM {{class_scores}}"""


@query(f"SELECT (SELECT count(*) FROM {{preds}}) AS dataset_size, o.* FROM ({OVERALL_SQL}) o")
def sink_json_report(v: Views):
    path = scratch_path(v.spark, "report")
    report = M.full_report(v.preds)
    sinks.write_json_report(report, path)
    stored = v.spark.read.schema(report.schema).json(path)
    return stored.select("dataset_size", "overall_metrics.*")


DISTRIBUTION_SQL = """
    SELECT split, label, count, total, round(100.0 * count / total, 2) AS pct
    FROM (SELECT split, label, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS total
          FROM (SELECT CASE WHEN type = 'entity' THEN 'train' ELSE 'valid' END AS split, label FROM {items})
          WHERE label IS NOT NULL GROUP BY split, label)"""


def split_tables(v: Views):
    """Train and valid tables as the distribution reports take them."""
    items = v.items
    return items.where(F.col("type") == "entity"), items.where(F.col("type") == "concept")


@query(
    f"""SELECT line FROM (VALUES ('CLASS DISTRIBUTION SUMMARY'), ('{"=" * 40}'), (''), ('')) t(line)
        UNION ALL
        SELECT concat(upper(split), ' SET') FROM ({DISTRIBUTION_SQL}) GROUP BY split
        UNION ALL
        SELECT concat('Total samples: ', CAST(max(total) AS VARCHAR)) FROM ({DISTRIBUTION_SQL}) GROUP BY split
        UNION ALL
        SELECT concat(label, ': ', CAST(count AS VARCHAR), ' samples (', CAST(pct AS VARCHAR), '%)')
        FROM ({DISTRIBUTION_SQL})"""
)
def sink_text_report(v: Views):
    path = scratch_path(v.spark, "distribution")
    distribution = P.class_distribution(tagged_union(*split_tables(v)))
    sinks.write_text_report(sinks.distribution_lines(distribution), path, ["split", "pos", "class"])
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query(f"SELECT item, predicted_label, {r('confidence', 'confidence')} FROM {{preds}}")
def sink_partition_by_class(v: Views):
    path = scratch_path(v.spark, "per-class")
    sinks.write_per_class(v.preds.select("item", "predicted_label", "confidence"), path)
    return v.spark.read.parquet(path)


@query(f"SELECT item, name, predicted_label, {r('confidence', 'confidence')} FROM {{preds}}")
def sink_submission(v: Views):
    return sinks.submission(v.preds)


@query(
    """SELECT item, predicted_label, '20250201_000000' AS snapshot FROM {preds}
       WHERE type = 'concept'"""
)
def src_latest_snapshot(v: Views):
    path = scratch_path(v.spark, "snapshots")
    stamp = F.when(F.col("type") == "concept", "20250201_000000").otherwise("20250101_000000")
    stamped = v.preds.select("item", "predicted_label", stamp.alias("snapshot"))
    stamped.write.partitionBy("snapshot").parquet(path)
    return tables.latest_snapshot(v.spark.read.parquet(path))


@query(
    """SELECT key, summary, found, languages FROM {cached}
       UNION ALL
       SELECT n.key, coalesce(substring(l.summary, 1, 500), ''), coalesce(l.found, false), coalesce(l.languages, 0)
       FROM (SELECT DISTINCT lower(name) AS key FROM {catalogue}) n
       LEFT JOIN {lookup} l ON l.key = n.key
       WHERE n.key NOT IN (SELECT key FROM {cached})"""
)
def cache_incremental_lookup(v: Views):
    path = scratch_path(v.spark, "lookup-cache")
    v.view("cached").write.parquet(path)
    return lookup_cache.append_missing(v.view("catalogue"), path, v.view("lookup"))


@query("SELECT item, name, label FROM {items} ORDER BY item LIMIT 3")
def limit_preview(v: Views):
    return R.preview(v.items.select("item", "name", "label"), "item", 3)
