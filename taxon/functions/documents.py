"""Counts and flags from knowledge-base entity documents and page documents.

Both document kinds arrive as one JSON string per row. They are parsed once into typed
maps and every feature is a higher-order expression on the parsed value, so nothing is
exploded and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITELINKS_SCHEMA = "map<string, struct<title: string>>"
CLAIMS_SCHEMA = "map<string, array<struct<mainsnak: struct<datatype: string>>>>"
BRANCH_SCHEMAS = {"sitelinks": SITELINKS_SCHEMA, "claims": CLAIMS_SCHEMA}
PAGE_MAP_SCHEMA = (
    "map<string, struct<length: bigint, missing: string, coordinates: string, "
    "categories: array<string>, extlinks: array<string>, langlinks: array<string>>>"
)
PAGE_SCHEMA = f"struct<query: struct<pages: {PAGE_MAP_SCHEMA}>>"


@dataclass(frozen=True)
class PropertySets:
    """Property ids that count as cultural or geographic."""

    cultural: tuple[str, ...]
    geographic: tuple[str, ...]


# The two published presets.
TRAINING_SETS = PropertySets(
    cultural=("P17", "P495", "P2596", "P2012", "P1532", "P27", "P1376", "P361", "P279", "P31"),
    geographic=("P17", "P495", "P131", "P276", "P27", "P1376", "P159", "P625"),
)
SERVING_SETS = PropertySets(
    cultural=("P17", "P495", "P2596", "P27", "P1412", "P37", "P103", "P361", "P131", "P625"),
    geographic=("P17", "P131", "P625", "P30", "P47", "P150", "P36", "P1376"),
)

# Properties behind the four flags.
FLAG_PROPERTIES = {
    "has_coordinates": "P625",
    "has_country": "P17",
    "has_culture_property": "P2596",
    "has_origin_country": "P495",
}


def parse_entity(df: DataFrame, raw: str = "raw", qid: str = "qid", branches: tuple[str, ...] = tuple(BRANCH_SCHEMAS)) -> DataFrame:
    """Add the maps of ``branches`` (``sitelinks`` and ``claims``); empty maps stand in for anything unreadable.

    A branch that is not asked for is skipped by the JSON reader and never built.
    """
    fields = ", ".join(f"{b}: {BRANCH_SCHEMAS[b]}" for b in branches)
    entity = F.try_element_at(F.from_json(raw, f"struct<entities: map<string, struct<{fields}>>>")["entities"], F.col(qid))
    parsed = df.withColumn("_entity", entity)
    # a branch of the wrong kind (an empty list for a map) is NULL and leaves the other alone
    maps = {b: F.coalesce(F.col("_entity")[b], F.from_json(F.lit("{}"), BRANCH_SCHEMAS[b])) for b in branches}
    return parsed.withColumns(maps).drop("_entity")


def parse_pages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the ``pages`` map (page id to page), empty for an unreadable document."""
    return df.withColumn(
        "pages",
        F.coalesce(
            F.from_json(raw, PAGE_SCHEMA)["query"]["pages"],
            F.from_json(F.lit("{}"), PAGE_MAP_SCHEMA),
        ),
    )


def keys_with_suffix(m: Column, suffix: str = "wiki") -> Column:
    return F.size(F.filter(F.map_keys(m), lambda k: k.endswith(suffix)))


def title_of(sitelinks: Column, site: str = "enwiki") -> Column:
    """Title of the page on one site, empty when there is none."""
    return F.coalesce(F.try_element_at(sitelinks, F.lit(site))["title"], F.lit(""))


def has_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def total_list_size(m: Column) -> Column:
    """Sum of the lengths of all lists in the map."""
    return F.aggregate(F.map_values(m), F.lit(0), lambda acc, v: acc + F.coalesce(F.size(v), F.lit(0)))


def key_count(m: Column) -> Column:
    return F.size(m)


def keys_in_set(m: Column, keys: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(F.map_keys(m), F.array(*[F.lit(k) for k in keys])))


def keys_with_external_id(claims: Column) -> Column:
    """Properties that hold at least one external identifier."""
    return F.size(
        F.map_filter(
            claims,
            lambda k, v: k.startswith("P")
            & F.coalesce(F.exists(v, lambda c: c["mainsnak"]["datatype"] == "external-id"), F.lit(False)),
        )
    )


def keys_numbered_above(claims: Column, bound: int = 200) -> Column:
    """Properties whose number exceeds the bound (the serving-side identifier rule)."""
    return F.size(
        F.filter(
            F.map_keys(claims),
            lambda k: k.rlike("^P[0-9]+$") & (F.substring(k, 2, 18).try_cast("bigint") > bound),
        )
    )


def _list_size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def existing_page(pages: Column) -> Column:
    """Last page of the document that exists (the id ``-1`` marks a missing one)."""
    present = F.map_values(F.map_filter(pages, lambda k, v: k != "-1"))
    return F.try_element_at(present, F.lit(-1))


def first_page(pages: Column) -> Column:
    """First page, NULL when it is flagged as missing."""
    page = F.get(F.map_values(pages), F.lit(0))
    return F.when(page["missing"].isNull(), page)


def with_page_stats(df: DataFrame, page: Column) -> DataFrame:
    """Length and list sizes of one page, zeros for a missing one."""
    return df.withColumns(
        {
            "en_page_length": F.coalesce(page["length"], F.lit(0)).cast("bigint"),
            "num_categories": _list_size(page["categories"]).cast("bigint"),
            "num_external_links": _list_size(page["extlinks"]).cast("bigint"),
        }
    )


def langlink_count(pages: Column) -> Column:
    """Language links of the last page listed."""
    return _list_size(F.try_element_at(F.map_values(pages), F.lit(-1))["langlinks"])


def with_claim_features(df: DataFrame, sets: PropertySets = TRAINING_SETS, numbered_ids: bool = False) -> DataFrame:
    """All features that the entity document alone determines."""
    claims, sitelinks = F.col("claims"), F.col("sitelinks")
    identifiers = keys_numbered_above(claims) if numbered_ids else keys_with_external_id(claims)
    counts = {
        "num_languages": keys_with_suffix(sitelinks),
        "num_interwiki_links": F.lit(0),
        "num_statements": total_list_size(claims),
        "num_cultural_properties": keys_in_set(claims, sets.cultural),
        "num_geographic_properties": keys_in_set(claims, sets.geographic),
        "num_identifiers": identifiers,
        "statement_diversity": key_count(claims),
    }
    flags = {name: has_key(claims, prop) for name, prop in FLAG_PROPERTIES.items()}
    return df.withColumns({k: v.cast("bigint") for k, v in counts.items()} | flags)


# The 14 raw features, in their published order.
RAW_FEATURES = [
    "num_languages",
    "en_page_length",
    "num_interwiki_links",
    "num_categories",
    "has_coordinates",
    "num_external_links",
    "num_statements",
    "num_cultural_properties",
    "num_geographic_properties",
    "has_country",
    "has_culture_property",
    "has_origin_country",
    "num_identifiers",
    "statement_diversity",
]
RAW_FLAGS = [c for c in RAW_FEATURES if c.startswith("has_")]
RAW_COUNTS = [c for c in RAW_FEATURES if not c.startswith("has_")]
