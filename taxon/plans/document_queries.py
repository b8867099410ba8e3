"""JSON, map and array features of knowledge-base documents (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.functions import documents as D
from taxon.functions.text import entity_id_by_pattern
from taxon.operators.joins import lookup_join
from taxon.plans.registry import query
from taxon.plans.views import Views

BAD_ROWS = "SELECT concat('Q', CAST(1000000000000 + n_nationkey AS VARCHAR)) AS qid, {columns} FROM {{nation}}"


def over_entities(columns: dict[str, str], default: str = "0") -> str:
    """Oracle over good documents, with defaults for the unreadable ones."""
    good = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    bad = ", ".join(f"{default} AS {n}" for n in columns)
    return f"""
        SELECT f.qid, {good} FROM {{claim_features}} f JOIN {{claim_flags}} g ON g.qid = f.qid
        UNION ALL
        {BAD_ROWS.format(columns=bad).replace('{{', '{').replace('}}', '}')}"""


def as_int(expression: str) -> str:
    return f"CAST({expression} AS INTEGER)"


def entities(v: Views, *branches: str) -> DataFrame:
    """The stored documents with the named branches, both if none is named."""
    return D.parse_entity(v.entity_docs, branches=branches or tuple(D.BRANCH_SCHEMAS))


@query(over_entities({"num_languages": as_int("f.num_languages")}))
def json_count_keys_suffix(v: Views):
    return entities(v, "sitelinks").select("qid", D.keys_with_suffix(F.col("sitelinks")).alias("num_languages"))


@query(
    over_entities(
        {"title": "CASE WHEN f.event_type IN ('click', 'view') THEN concat('P', CAST(f.user_id AS VARCHAR)) ELSE '' END"},
        "''",
    )
)
def json_nested_get(v: Views):
    return entities(v, "sitelinks").select("qid", D.title_of(F.col("sitelinks")).alias("title"))


@query(over_entities({c: f"f.{c}" for c in D.FLAG_PROPERTIES}, "false"))
def json_has_key(v: Views):
    return entities(v, "claims").select("qid", *[D.has_key(F.col("claims"), p).alias(c) for c, p in D.FLAG_PROPERTIES.items()])


@query(over_entities({"num_statements": as_int("f.num_statements")}))
def json_sum_list_sizes(v: Views):
    return entities(v, "claims").select("qid", D.total_list_size(F.col("claims")).alias("num_statements"))


@query(over_entities({"statement_diversity": as_int("f.statement_diversity")}))
def json_key_count(v: Views):
    return entities(v, "claims").select("qid", D.key_count(F.col("claims")).alias("statement_diversity"))


@query(
    over_entities(
        {
            "training_cultural": as_int("f.num_cultural_properties"),
            "training_geographic": as_int("f.num_geographic_properties"),
            "serving_cultural": as_int("f.serving_cultural"),
            "serving_geographic": as_int("f.serving_geographic"),
        }
    )
)
def json_key_set_overlap(v: Views):
    claims = F.col("claims")
    return entities(v, "claims").select(
        "qid",
        D.keys_in_set(claims, D.TRAINING_SETS.cultural).alias("training_cultural"),
        D.keys_in_set(claims, D.TRAINING_SETS.geographic).alias("training_geographic"),
        D.keys_in_set(claims, D.SERVING_SETS.cultural).alias("serving_cultural"),
        D.keys_in_set(claims, D.SERVING_SETS.geographic).alias("serving_geographic"),
    )


@query(over_entities({"num_identifiers": as_int("f.num_identifiers")}))
def json_count_keys_exists(v: Views):
    return entities(v, "claims").select("qid", D.keys_with_external_id(F.col("claims")).alias("num_identifiers"))


@query(over_entities({"num_identifiers": as_int("f.serving_identifiers")}))
def json_count_keys_numeric(v: Views):
    return entities(v, "claims").select("qid", D.keys_numbered_above(F.col("claims")).alias("num_identifiers"))


PAGE_STATS_SQL = """
    SELECT title, CASE WHEN missing = 1 THEN CAST(0 AS BIGINT) ELSE page_length END AS en_page_length,
           CASE WHEN missing = 1 THEN CAST(0 AS BIGINT) ELSE n_categories END AS num_categories,
           CASE WHEN missing = 1 THEN CAST(0 AS BIGINT) ELSE n_links END AS num_external_links"""


@query(
    f"""{PAGE_STATS_SQL}, 'training' AS preset, false AS located FROM {{page_counts}}
        UNION ALL
        {PAGE_STATS_SQL}, 'serving' AS preset, missing = 0 AND located = 1 AS located FROM {{page_counts}}"""
)
def json_page_stats(v: Views):
    pages = D.parse_pages(v.page_docs)
    columns = ["title", "en_page_length", "num_categories", "num_external_links", "preset", "located"]
    training = D.with_page_stats(pages, D.existing_page(F.col("pages")))
    first = D.first_page(F.col("pages"))
    serving = D.with_page_stats(pages, first).withColumn("located", first["coordinates"].isNotNull())
    return (
        training.withColumns({"preset": F.lit("training"), "located": F.lit(False)})
        .select(*columns)
        .unionByName(serving.withColumn("preset", F.lit("serving")).select(*columns))
    )


@query("SELECT title, CAST(CASE WHEN missing = 1 THEN 0 ELSE n_languages END AS INTEGER) AS languages FROM {page_counts}")
def json_langlinks_count(v: Views):
    return D.parse_pages(v.page_docs).select("title", D.langlink_count(F.col("pages")).alias("languages"))


def raw_features(entity_docs: DataFrame, page_docs: DataFrame) -> DataFrame:
    """All raw features of every entity, from its own document and that of its page."""
    found = D.parse_entity(entity_docs).withColumn("title", D.title_of(F.col("sitelinks")))
    features = D.with_claim_features(found).drop("raw", "sitelinks", "claims")
    pages = D.parse_pages(page_docs)
    stats = D.with_page_stats(pages, D.existing_page(F.col("pages"))).drop("raw", "pages")
    return lookup_join(features, stats, "title").na.fill(0)


DEFAULTS = {c: "CAST(0 AS BIGINT)" for c in D.RAW_COUNTS} | {c: "false" for c in D.RAW_FLAGS}


@query(
    BAD_ROWS.format(columns=", ".join(f"{e} AS {c}" for c, e in DEFAULTS.items() if c not in ("en_page_length", "num_categories", "num_external_links")))
    .replace("{{", "{")
    .replace("}}", "}")
    + """ UNION ALL
        SELECT qid, num_languages, num_interwiki_links, num_statements, num_cultural_properties,
               num_geographic_properties, num_identifiers, statement_diversity, has_coordinates, has_country,
               has_culture_property, has_origin_country
        FROM {claim_features}"""
)
def json_safe_defaults(v: Views):
    counts = [c for c in D.RAW_COUNTS if c not in ("en_page_length", "num_categories", "num_external_links")]
    features = D.with_claim_features(entities(v))
    # the oracle matches UNION columns by position
    order = [
        "num_languages",
        "num_interwiki_links",
        "num_statements",
        "num_cultural_properties",
        "num_geographic_properties",
        "num_identifiers",
        "statement_diversity",
    ]
    assert sorted(order) == sorted(counts)
    return features.select("qid", *order, *D.RAW_FLAGS)


@query(
    "SELECT concat('http://www.wikidata.org/entity/', qid) AS item, "
    + ", ".join(D.RAW_FEATURES)
    + " FROM {raw_features} UNION ALL "
    + "SELECT concat('http://www.wikidata.org/entity/Q', CAST(1000000000000 + n_nationkey AS VARCHAR)), "
    + ", ".join(DEFAULTS[c] for c in D.RAW_FEATURES)
    + " FROM {nation}"
)
def raw_features_from_json(v: Views):
    uri = F.concat(F.lit("http://www.wikidata.org/entity/"), "qid")
    documents = v.entity_docs.select(uri.alias("item"), "raw")
    keyed = documents.withColumn("qid", entity_id_by_pattern(F.col("item")))
    return raw_features(keyed, v.page_docs).select("item", *D.RAW_FEATURES)
