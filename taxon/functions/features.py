"""Engineered numeric features over the raw knowledge counts and flags.

Each family is one projection, so Catalyst folds a whole chain of them into a single
code-generated stage above the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.functions.text import with_text_lengths

# Raw columns that the feature matrices start from.
ENRICHED_COLUMNS = [
    "num_languages",
    "en_page_length",
    "num_statements",
    "num_categories",
    "num_external_links",
    "num_identifiers",
    "statement_diversity",
    "num_cultural_properties",
    "num_geographic_properties",
    "has_coordinates",
    "has_country",
    "has_culture_property",
    "has_origin_country",
]
# One-hot vocabularies of the text-only feature set.
TYPES = ["entity", "concept"]
TOP_CATEGORIES = [
    "music",
    "films",
    "sports",
    "literature",
    "visual arts",
    "architecture",
    "media",
    "history",
    "politics",
    "food",
]
LOGGED = [
    "num_languages",
    "en_page_length",
    "num_statements",
    "num_categories",
    "num_external_links",
    "num_identifiers",
    "statement_diversity",
]
# Numerator and denominator of each ratio (the denominator is raised by 1).
RATIOS = {
    "cultural_ratio": ("num_cultural_properties", "statement_diversity"),
    "geographic_ratio": ("num_geographic_properties", "statement_diversity"),
    "identifier_ratio": ("num_identifiers", "num_statements"),
    "categories_per_page": ("num_categories", "en_page_length"),
    "external_links_per_page": ("num_external_links", "en_page_length"),
}
ADVANCED_RATIOS = {
    "statements_per_language": ("num_statements", "num_languages"),
    "identifiers_per_language": ("num_identifiers", "num_languages"),
    "categories_per_language": ("num_categories", "num_languages"),
    "cultural_density": ("num_cultural_properties", "num_statements"),
    "geographic_density": ("num_geographic_properties", "num_statements"),
}
INTERACTIONS = {
    "languages_x_statements": ("log_num_languages", "log_num_statements"),
    "languages_x_page_length": ("log_num_languages", "log_en_page_length"),
    "has_country_x_languages": ("has_country", "log_num_languages"),
    "has_country_x_statements": ("has_country", "log_num_statements"),
    "cultural_x_geographic": ("num_cultural_properties", "num_geographic_properties"),
}
THREE_WAY_INTERACTIONS = {
    "lang_x_stmt_x_country": ("log_num_languages", "log_num_statements", "has_country"),
    "cultural_x_geo_x_lang": ("num_cultural_properties", "num_geographic_properties", "log_num_languages"),
}
# Weights of the composite scores.
COMPOSITES = {
    "global_reach_score": {
        "log_num_languages": 0.5,
        "log_en_page_length": 0.3,
        "log_num_external_links": 0.2,
    },
    "cultural_specificity_score": {
        "num_cultural_properties": 2.0,
        "num_geographic_properties": 1.5,
        "has_country": 1.0,
        "has_origin_country": 1.0,
        "has_culture_property": 2.0,
    },
    "info_richness_score": {
        "log_num_statements": 0.4,
        "log_statement_diversity": 0.4,
        "log_num_identifiers": 0.2,
    },
    "page_quality_score": {
        "log_en_page_length": 0.4,
        "log_num_categories": 0.3,
        "log_num_external_links": 0.3,
    },
}
# The 33 columns of the tuned model, in order.
FEATURES_33 = [
    "log_num_languages",
    "log_en_page_length",
    "log_num_categories",
    "log_num_external_links",
    "log_num_statements",
    "log_num_identifiers",
    "log_statement_diversity",
    "num_cultural_properties",
    "num_geographic_properties",
    "has_coordinates",
    "has_country",
    "has_culture_property",
    "has_origin_country",
    *RATIOS,
    *INTERACTIONS,
    *COMPOSITES,
    "is_highly_global",
    "is_niche",
    "has_long_page",
    "has_many_statements",
    "num_languages_squared",
    "cultural_specificity_squared",
]


def _num(name: str) -> Column:
    return F.col(name).cast("double")


def _flag(condition: Column) -> Column:
    """0/1 with missing input counted as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def _product(names: tuple[str, ...]) -> Column:
    out = _num(names[0])
    for name in names[1:]:
        out = out * _num(name)
    return out


def _weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + _num(name) * weight
    return out


def with_onehot_fixed(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """One 0/1 column per value of a fixed vocabulary."""
    return df.withColumns({f"{prefix}_{v.replace(' ', '_')}": _flag(F.col(column) == v) for v in values})


def observed_values(df: DataFrame, column: str, max_values: int = 1000) -> list[str]:
    """Distinct values that become columns; refuses a column too wide to be categorical."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} distinct values: not a categorical column")
    return sorted(r[0] for r in rows)


def with_onehot_observed(df: DataFrame, column: str, prefix: str, max_values: int = 1000) -> DataFrame:
    """One 0/1 column per value present in the data; a NULL row is 0 throughout."""
    values = observed_values(df, column, max_values)
    return df.withColumns({f"{prefix}_{v}": _flag(F.col(column) == v) for v in values})


def with_default_features(df: DataFrame, columns: list[str] = ENRICHED_COLUMNS) -> DataFrame:
    """Make every raw column present and non-null; absent counts become 1, the rest 0."""
    out = {}
    for c in columns:
        if c in df.columns:
            out[c] = F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
        else:
            out[c] = F.lit(1 if c.startswith("num_") else 0).cast("bigint")
    return df.withColumns(out)


def with_logs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(_num(c)) for c in LOGGED})


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]] = RATIOS) -> DataFrame:
    return df.withColumns({name: _num(a) / (_num(b) + 1) for name, (a, b) in ratios.items()})


def with_interactions(df: DataFrame, products: dict[str, tuple[str, ...]] = INTERACTIONS) -> DataFrame:
    return df.withColumns({name: _product(factors) for name, factors in products.items()})


def with_composites(df: DataFrame) -> DataFrame:
    return df.withColumns({name: _weighted(weights) for name, weights in COMPOSITES.items()})


def with_rule_scores(df: DataFrame) -> DataFrame:
    """Hand-made score of each class."""
    languages, cultural = F.col("num_languages"), F.col("num_cultural_properties")
    return df.withColumns(
        {
            "exclusivity_score": _flag(languages < 15) * 2
            + _num("has_country") * 1.5
            + _num("has_origin_country") * 1.5
            + _flag(cultural > 2),
            "representativeness_score": _flag(languages >= 15) * _flag(languages < 50) * 2
            + _flag(cultural > 0) * 1.5,
            "agnostic_score": (_flag(languages > 50) * 2 + _flag(_num("has_country") == 0) + _flag(cultural == 0)).cast(
                "double"
            ),
        }
    )


def with_threshold_flags(df: DataFrame) -> DataFrame:
    languages = F.col("num_languages")
    return df.withColumns(
        {
            "is_highly_global": _flag(languages > 20),
            "is_niche": _flag(languages < 10),
            "has_long_page": _flag(F.col("en_page_length") > 10000),
            "has_many_statements": _flag(F.col("num_statements") > 30),
        }
    )


def with_reach_flags(df: DataFrame) -> DataFrame:
    languages = F.col("num_languages")
    return df.withColumns(
        {
            "is_very_global": _flag(languages > 50),
            "is_moderately_global": _flag(languages.between(15, 50)),
        }
    )


def with_squares(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "num_languages_squared": F.pow("log_num_languages", F.lit(2)),
            "cultural_specificity_squared": F.pow("cultural_specificity_score", F.lit(2)),
        }
    )


def with_more_polynomials(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "num_languages_cubed": F.pow("log_num_languages", F.lit(3)),
            "global_reach_squared": F.pow("global_reach_score", F.lit(2)),
        }
    )


def with_language_bins(df: DataFrame) -> DataFrame:
    languages = F.col("num_languages")
    return df.withColumns(
        {
            "lang_bin_low": _flag(languages < 10),
            "lang_bin_mid": _flag((languages >= 10) & (languages < 30)),
            "lang_bin_high": _flag(languages >= 30),
        }
    )


def finite(c: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    bad = c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly these columns in this order as doubles, missing values as 0."""
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"feature columns missing: {', '.join(absent)}")
    return df.select(*keep, *[F.coalesce(_num(c), F.lit(0.0)).alias(c) for c in features])


def engineer(df: DataFrame) -> DataFrame:
    """All families behind the 33-column matrix."""
    for family in (with_logs, with_ratios, with_interactions, with_composites, with_threshold_flags, with_squares):
        df = family(df)
    return df


def matrix_33(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return select_features(engineer(df), FEATURES_33, keep)


def with_basic_features(df: DataFrame) -> DataFrame:
    """The 29 columns that need no model fit: lengths, fixed one-hots, defaulted raw columns.

    Lengths already present are kept: take them before a join, so that it moves no texts.
    """
    if "name_length" not in df.columns:
        df = with_text_lengths(df)
    df = with_onehot_fixed(df, "type", TYPES, "type")
    df = with_onehot_fixed(df, "category", TOP_CATEGORIES, "cat")
    return with_default_features(df)


BASIC_29 = [
    "name_length",
    "desc_length",
    "name_word_count",
    "desc_word_count",
    *[f"type_{v}" for v in TYPES],
    *[f"cat_{v.replace(' ', '_')}" for v in TOP_CATEGORIES],
    *ENRICHED_COLUMNS,
]
FEATURES_73 = [
    *BASIC_29,
    *[f"log_{c}" for c in LOGGED],
    *RATIOS,
    *ADVANCED_RATIOS,
    *INTERACTIONS,
    *THREE_WAY_INTERACTIONS,
    *COMPOSITES,
    "exclusivity_score",
    "representativeness_score",
    "agnostic_score",
    "is_highly_global",
    "is_niche",
    "has_long_page",
    "has_many_statements",
    "is_very_global",
    "is_moderately_global",
    "num_languages_squared",
    "num_languages_cubed",
    "cultural_specificity_squared",
    "global_reach_squared",
    "lang_bin_low",
    "lang_bin_mid",
    "lang_bin_high",
]


def matrix_73(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Basic and engineered columns together, every value finite."""
    df = engineer(with_basic_features(df))
    df = with_ratios(df, ADVANCED_RATIOS)
    df = with_interactions(df, THREE_WAY_INTERACTIONS)
    for family in (with_rule_scores, with_reach_flags, with_more_polynomials, with_language_bins):
        df = family(df)
    # only fractions can be NaN or infinite; counts and flags are merely filled
    kinds = dict(df.dtypes)
    clean = [finite(F.col(c)) if kinds[c] == "double" else F.coalesce(_num(c), F.lit(0.0)) for c in FEATURES_73]
    return df.select(*keep, *[value.alias(c) for c, value in zip(FEATURES_73, clean)])
