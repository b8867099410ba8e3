"""Column expressions (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxon.functions import features as X
from taxon.functions import labels as L
from taxon.functions import prompts, text
from taxon.operators.joins import attach_features, enrich_by_name
from taxon.operators.labels import alphabetical_ids, with_alphabetical_id, with_label_of_id
from taxon.plans.registry import query, r
from taxon.plans.views import CLASSES, Views

# ---- strings


@query(r"SELECT uri, nullif(regexp_extract(uri, 'Q\d+', 0), '') AS qid FROM {uris}")
def str_extract_id_regex(v: Views):
    return v.view("uris").withColumn("qid", text.entity_id_by_pattern(F.col("uri")))


@query(
    """SELECT uri, CASE WHEN contains(uri, 'wikidata.org') THEN string_split(uri, '/')[-1] END AS qid FROM {uris}"""
)
def str_extract_id_tail(v: Views):
    return v.view("uris").withColumn("qid", text.entity_id_by_tail(F.col("uri")))


@query("SELECT item, coalesce(subcategory, '') AS subcategory, CAST(doc_id AS VARCHAR) AS doc_id FROM {items}")
def str_fill_cast(v: Views):
    return text.with_filled(v.items.select("item", "subcategory", "doc_id"), ["subcategory", "doc_id"])


PADDED_SQL = "concat(' ', chr(9), {c}, ' ', chr(10), chr(13), ' ')"


@query(
    f"""SELECT item, trim({PADDED_SQL.format(c='name')}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12))) AS name,
               trim({PADDED_SQL.format(c='description')}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12))) AS description
        FROM {{items}}"""
)
def str_strip(v: Views):
    padded = {c: F.concat(F.lit(" \t"), c, F.lit(" \n\r ")) for c in ("name", "description")}
    return text.with_stripped(v.items.withColumns(padded).select("item", *padded), list(padded))


LENGTHS_SQL = r"""
    CAST(length(name) AS INTEGER) AS name_length, CAST(length(description) AS INTEGER) AS desc_length,
    CAST(len(list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')) AS INTEGER) AS name_word_count,
    CAST(len(list_filter(string_split_regex(description, '\s+'), lambda w: w <> '')) AS INTEGER) AS desc_word_count"""


@query(f"SELECT item, {LENGTHS_SQL} FROM {{items}}")
def feat_text_lengths(v: Views):
    return text.with_text_lengths(v.items).select(
        "item", "name_length", "desc_length", "name_word_count", "desc_word_count"
    )


SOURCES = [f"src{i}" for i in range(20)]


@query(
    "SELECT item, "
    + ", ".join(f"CASE WHEN type = '{t}' THEN 1 ELSE 0 END AS type_{t}" for t in X.TYPES)
    + ", "
    + ", ".join(f"CASE WHEN category = '{s}' THEN 1 ELSE 0 END AS cat_{s}" for s in SOURCES)
    + " FROM {items}"
)
def feat_onehot_fixed(v: Views):
    out = X.with_onehot_fixed(v.items, "type", X.TYPES, "type")
    out = X.with_onehot_fixed(out, "category", SOURCES, "cat")
    return out.select("item", *[f"type_{t}" for t in X.TYPES], *[f"cat_{s}" for s in SOURCES])


@query(
    "SELECT item, "
    + ", ".join(f"CASE WHEN subcategory = '{c}' THEN 1 ELSE 0 END AS subcategory_{c}" for c in CLASSES)
    + " FROM {items}"
)
def feat_onehot_observed(v: Views):
    out = X.with_onehot_observed(v.items.select("item", "subcategory"), "subcategory", "subcategory")
    return out.drop("subcategory")


# ---- engineered features


@query(
    """SELECT qid, num_languages, CAST(1 AS BIGINT) AS num_statements, CAST(0 AS BIGINT) AS statement_diversity,
              CAST(0 AS BIGINT) AS has_coordinates, CASE WHEN has_country THEN CAST(1 AS BIGINT) ELSE 0 END AS has_country
       FROM {raw_features}"""
)
def feat_default_missing(v: Views):
    known = v.raw_features.select("qid", "num_languages", "has_country")
    columns = ["num_languages", "num_statements", "statement_diversity", "has_coordinates", "has_country"]
    return X.with_default_features(known, columns).select("qid", *columns)


def flag(c: str) -> str:
    return f"CAST({c} AS INTEGER)"


LOG_SQL = {f"log_{c}": f"ln(1 + {c})" for c in X.LOGGED}
RATIO_SQL = {n: f"{a} / CAST({b} + 1 AS DOUBLE)" for n, (a, b) in X.RATIOS.items()}
ADVANCED_RATIO_SQL = {n: f"{a} / CAST({b} + 1 AS DOUBLE)" for n, (a, b) in X.ADVANCED_RATIOS.items()}
INTERACTION_SQL = {
    "languages_x_statements": "ln(1 + num_languages) * ln(1 + num_statements)",
    "languages_x_page_length": "ln(1 + num_languages) * ln(1 + en_page_length)",
    "has_country_x_languages": f"{flag('has_country')} * ln(1 + num_languages)",
    "has_country_x_statements": f"{flag('has_country')} * ln(1 + num_statements)",
    "cultural_x_geographic": "num_cultural_properties * num_geographic_properties",
}
THREE_WAY_SQL = {
    "lang_x_stmt_x_country": f"ln(1 + num_languages) * ln(1 + num_statements) * {flag('has_country')}",
    "cultural_x_geo_x_lang": "num_cultural_properties * num_geographic_properties * ln(1 + num_languages)",
}
REACH = "(0.5 * ln(1 + num_languages) + 0.3 * ln(1 + en_page_length) + 0.2 * ln(1 + num_external_links))"
SPECIFICITY = (
    f"(2.0 * num_cultural_properties + 1.5 * num_geographic_properties + {flag('has_country')}"
    f" + {flag('has_origin_country')} + 2.0 * {flag('has_culture_property')})"
)
COMPOSITE_SQL = {
    "global_reach_score": REACH,
    "cultural_specificity_score": SPECIFICITY,
    "info_richness_score": "0.4 * ln(1 + num_statements) + 0.4 * ln(1 + statement_diversity) + 0.2 * ln(1 + num_identifiers)",
    "page_quality_score": "0.4 * ln(1 + en_page_length) + 0.3 * ln(1 + num_categories) + 0.3 * ln(1 + num_external_links)",
}
RULE_SQL = {
    "exclusivity_score": f"CASE WHEN num_languages < 15 THEN 2 ELSE 0 END + 1.5 * {flag('has_country')}"
    f" + 1.5 * {flag('has_origin_country')} + CASE WHEN num_cultural_properties > 2 THEN 1 ELSE 0 END",
    "representativeness_score": "CASE WHEN num_languages >= 15 AND num_languages < 50 THEN 2 ELSE 0 END"
    " + CASE WHEN num_cultural_properties > 0 THEN 1.5 ELSE 0 END",
    "agnostic_score": "CASE WHEN num_languages > 50 THEN 2 ELSE 0 END + CASE WHEN has_country THEN 0 ELSE 1 END"
    " + CASE WHEN num_cultural_properties = 0 THEN 1 ELSE 0 END",
}
THRESHOLD_SQL = {
    "is_highly_global": "num_languages > 20",
    "is_niche": "num_languages < 10",
    "has_long_page": "en_page_length > 10000",
    "has_many_statements": "num_statements > 30",
}
REACH_FLAG_SQL = {
    "is_very_global": "num_languages > 50",
    "is_moderately_global": "num_languages >= 15 AND num_languages <= 50",
}
SQUARE_SQL = {
    "num_languages_squared": "ln(1 + num_languages) * ln(1 + num_languages)",
    "cultural_specificity_squared": f"{SPECIFICITY} * {SPECIFICITY}",
}
POLYNOMIAL_SQL = {
    "num_languages_cubed": "ln(1 + num_languages) * ln(1 + num_languages) * ln(1 + num_languages)",
    "global_reach_squared": f"{REACH} * {REACH}",
}
BIN_SQL = {
    "lang_bin_low": "num_languages < 10",
    "lang_bin_mid": "num_languages >= 10 AND num_languages < 30",
    "lang_bin_high": "num_languages >= 30",
}


def doubles(*families: dict[str, str]) -> str:
    return ", ".join(r(e, n) for family in families for n, e in family.items())


def flags(*families: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS INTEGER) AS {n}" for family in families for n, e in family.items())


@query(f"SELECT qid, {doubles(LOG_SQL)} FROM {{raw_features}}")
def feat_log1p(v: Views):
    return X.with_logs(v.raw_features).select("qid", *LOG_SQL)


@query(f"SELECT qid, {doubles(RATIO_SQL)} FROM {{raw_features}}")
def feat_ratios(v: Views):
    return X.with_ratios(v.raw_features).select("qid", *RATIO_SQL)


@query(f"SELECT qid, {doubles(ADVANCED_RATIO_SQL)} FROM {{raw_features}}")
def feat_ratios_adv(v: Views):
    return X.with_ratios(v.raw_features, X.ADVANCED_RATIOS).select("qid", *ADVANCED_RATIO_SQL)


@query(f"SELECT qid, {doubles(INTERACTION_SQL)} FROM {{raw_features}}")
def feat_interactions(v: Views):
    return X.with_interactions(X.with_logs(v.raw_features)).select("qid", *INTERACTION_SQL)


@query(f"SELECT qid, {doubles(THREE_WAY_SQL)} FROM {{raw_features}}")
def feat_interactions3(v: Views):
    logs = X.with_logs(v.raw_features)
    return X.with_interactions(logs, X.THREE_WAY_INTERACTIONS).select("qid", *THREE_WAY_SQL)


@query(f"SELECT qid, {doubles(COMPOSITE_SQL)} FROM {{raw_features}}")
def feat_composites(v: Views):
    return X.with_composites(X.with_logs(v.raw_features)).select("qid", *COMPOSITE_SQL)


@query(f"SELECT qid, {doubles(RULE_SQL)} FROM {{raw_features}}")
def feat_rule_scores(v: Views):
    return X.with_rule_scores(v.raw_features).select("qid", *RULE_SQL)


@query(f"SELECT qid, {flags(THRESHOLD_SQL, REACH_FLAG_SQL)} FROM {{raw_features}}")
def feat_threshold_flags(v: Views):
    out = X.with_reach_flags(X.with_threshold_flags(v.raw_features))
    return out.select("qid", *THRESHOLD_SQL, *REACH_FLAG_SQL)


@query(f"SELECT qid, {doubles(SQUARE_SQL, POLYNOMIAL_SQL)} FROM {{raw_features}}")
def feat_polynomials(v: Views):
    scored = X.with_composites(X.with_logs(v.raw_features))
    return X.with_more_polynomials(X.with_squares(scored)).select("qid", *SQUARE_SQL, *POLYNOMIAL_SQL)


@query(f"SELECT qid, {flags(BIN_SQL)} FROM {{raw_features}}")
def feat_bins(v: Views):
    return X.with_language_bins(v.raw_features).select("qid", *BIN_SQL)


RAW_SQL = {c: (flag(c) if c.startswith("has_") else c) for c in X.ENRICHED_COLUMNS}


def flags_as_doubles(family: dict[str, str]) -> dict[str, str]:
    return {n: f"CASE WHEN {e} THEN 1 ELSE 0 END" for n, e in family.items()}


SQL_33 = {
    **RAW_SQL,
    **LOG_SQL,
    **RATIO_SQL,
    **INTERACTION_SQL,
    **COMPOSITE_SQL,
    **flags_as_doubles(THRESHOLD_SQL),
    **SQUARE_SQL,
}


@query("SELECT qid, " + ", ".join(r(SQL_33[c], c) for c in X.FEATURES_33) + " FROM {raw_features}")
def feat_matrix_33(v: Views):
    return X.matrix_33(v.raw_features, ["qid"])


BASIC_SQL = {
    "name_length": "length(name)",
    "desc_length": "length(description)",
    "name_word_count": r"len(list_filter(string_split_regex(name, '\s+'), lambda w: w <> ''))",
    "desc_word_count": r"len(list_filter(string_split_regex(description, '\s+'), lambda w: w <> ''))",
    **{f"type_{t}": f"CASE WHEN type = '{t}' THEN 1 ELSE 0 END" for t in X.TYPES},
    **{f"cat_{c.replace(' ', '_')}": f"CASE WHEN category = '{c}' THEN 1 ELSE 0 END" for c in X.TOP_CATEGORIES},
}
SQL_73 = {
    **BASIC_SQL,
    **SQL_33,
    **ADVANCED_RATIO_SQL,
    **THREE_WAY_SQL,
    **RULE_SQL,
    **flags_as_doubles(REACH_FLAG_SQL),
    **POLYNOMIAL_SQL,
    **flags_as_doubles(BIN_SQL),
}


@query(
    "SELECT item, "
    + ", ".join(r(SQL_73[c], c) for c in X.FEATURES_73)
    + r""" FROM (SELECT i.*, f.* FROM {items} i JOIN {raw_features} f ON f.qid = regexp_extract(i.item, 'Q\d+', 0))"""
)
def feat_matrix_73(v: Views):
    items = text.with_text_lengths(v.items).drop("name", "description")
    return X.matrix_73(attach_features(items, v.raw_features), ["item"])


@query("SELECT qid, " + ", ".join(r(SQL_33[c], c) for c in ("is_niche", "cultural_ratio", "num_languages")) + " FROM {raw_features}")
def feat_align(v: Views):
    return X.select_features(X.engineer(v.raw_features), ["is_niche", "cultural_ratio", "num_languages"], ["qid"])


# ---- prompts

FIELDS = ("name", "description", "type", "category", "subcategory")
STRIP_SQL = "trim({}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12)))"


def cols(*names: str):
    return [F.col(n) for n in names]


@query(f"SELECT item, {STRIP_SQL.format('''concat(name, '. ', description)''')} AS prompt FROM {{items}}")
def text_prompt_v1(v: Views):
    return v.items.select("item", prompts.prompt_plain(*cols("name", "description")).alias("prompt"))


def prompt_sql(present: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {present.format(c=f)} <> '' THEN concat('{f.capitalize()}: ', {f}) END" for f in FIELDS[1:]
    )
    return f"concat(concat_ws('. ', concat('Item: ', name), {parts}), '.')"


@query(f"SELECT item, {prompt_sql('{c}')} AS prompt FROM {{items}}")
def text_prompt_v2(v: Views):
    filled = text.with_filled(v.items, list(FIELDS))
    return filled.select("item", prompts.prompt_fields(*cols(*FIELDS)).alias("prompt"))


@query(f"SELECT item, {prompt_sql('trim({c})')} AS prompt FROM {{items}}")
def text_prompt_infer(v: Views):
    return v.items.select("item", prompts.prompt_fields_lenient(*cols(*FIELDS)).alias("prompt"))


@query(
    "SELECT item, "
    + STRIP_SQL.format(
        "concat('Classify the cultural specificity of this item:', chr(10), 'Name: ', name, chr(10), 'Description: ',"
        " description, chr(10), 'Category: ', category, chr(10), 'Type: ', type)"
    )
    + " AS prompt FROM {items}"
)
def text_prompt_v3(v: Views):
    return v.items.select("item", prompts.prompt_template(*cols("name", "description", "category", "type")).alias("prompt"))


@query(
    """SELECT item, concat(concat_ws('. ', concat('Item: ', name), concat('Description: ', original),
              CASE type WHEN 'entity' THEN 'Type: Named Entity (specific instance)'
                        WHEN 'concept' THEN 'Type: General Concept (abstract/general)' END,
              CASE WHEN category <> '' THEN concat('Category: ', category) END,
              CASE WHEN subcategory <> '' THEN concat('Subcategory: ', subcategory) END,
              CASE WHEN languages > 50 THEN '[Global reach: 50+ languages]'
                   WHEN languages > 20 THEN concat('[International: ', CAST(languages AS VARCHAR), ' languages]')
                   WHEN languages > 0 AND languages < 5 THEN concat('[Regional: ', CAST(languages AS VARCHAR), ' languages]')
              END),
              '. Task: Classify cultural specificity as agnostic, representative, or exclusive.') AS prompt
       FROM {enriched}"""
)
def text_prompt_enhanced(v: Views):
    enriched = enrich_by_name(v.view("catalogue"), v.view("lookup"))
    prompt = prompts.prompt_enhanced(*cols(*FIELDS, "languages"))
    return enriched.select("item", prompt.alias("prompt"))


ENRICHED_TEXT_SQL = """concat_ws(' ', original,
    CASE WHEN summary <> '' THEN concat('Wikipedia: ', substring(summary, 1, 500)) END,
    CASE WHEN languages > 50 THEN 'Available in 50+ languages.'
         WHEN languages > 20 THEN concat('Available in ', CAST(languages AS VARCHAR), ' languages.') END)"""


@query(f"SELECT item, {ENRICHED_TEXT_SQL} AS description FROM {{enriched}}")
def text_enrich_description(v: Views):
    enriched = enrich_by_name(v.view("catalogue"), v.view("lookup"))
    summary = text.truncated(F.col("summary"))
    return enriched.select(
        "item", prompts.enriched_description(F.col("description"), summary, F.col("languages")).alias("description")
    )


@query("SELECT key, substring(summary, 1, 500) AS summary FROM {lookup}")
def str_truncate(v: Views):
    return v.view("lookup").select("key", text.truncated(F.col("summary")).alias("summary"))


# ---- labels and probabilities

LANGUAGE_IDS = {c: i for i, c in enumerate(CLASSES)}


@query(
    """SELECT item, CAST(CASE label WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 END AS INTEGER) AS label_id,
              label AS decoded_label
       FROM {items}"""
)
def label_encode_map(v: Views):
    encoded = v.items.select("item", L.label_to_id(F.col("label"), LANGUAGE_IDS).alias("label_id"))
    return encoded.withColumn("decoded_label", L.id_to_label(F.col("label_id"), LANGUAGE_IDS))


@query(
    """SELECT i.item, CAST(c.label_id AS INTEGER) AS label_id, i.label AS decoded_label
       FROM {items} i
       JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM {items})) c
         ON c.label = i.label"""
)
def label_encode_alpha(v: Views):
    encoded = with_alphabetical_id(v.items.select("item", "label")).select("item", "label_id")
    return with_label_of_id(encoded, alphabetical_ids(v.items)).select("item", "label_id", "decoded_label")


PROB_SQL = ", ".join(r(f"probs[{i + 1}]", f"prob_{c}") for i, c in enumerate(CLASSES))


@query(f"SELECT item, {PROB_SQL} FROM {{preds}}")
def prob_expand(v: Views):
    return L.with_class_probabilities(v.preds, CLASSES).select("item", *[f"prob_{c}" for c in CLASSES])


SOFTMAX_SQL = ", ".join(
    r(f"exp(0.1 * hits[{i + 1}]) / list_sum(list_transform(hits, lambda h: exp(0.1 * h)))", f"prob_{c}")
    for i, c in enumerate(CLASSES)
)


@query(f"SELECT item, {SOFTMAX_SQL} FROM {{preds}}")
def prob_softmax(v: Views):
    logits = F.transform("hits", lambda h: h * F.lit(0.1))
    scored = v.preds.select("item", logits.alias("logits")).select("item", L.softmax(F.col("logits")).alias("probs"))
    return L.with_class_probabilities(scored, CLASSES).drop("probs")


@query(f"SELECT item, predicted_label, {r('confidence', 'confidence')} FROM {{preds}}")
def prob_argmax(v: Views):
    return L.with_prediction(v.preds.select("item", "probs"), CLASSES).drop("probs")


@query("SELECT item, label = predicted_label AS correct FROM {preds}")
def pred_correct_flag(v: Views):
    return L.with_correct_flag(v.preds).select("item", "correct")


@query(f"SELECT item, predicted_label, {r('confidence', 'confidence')} FROM {{preds}} WHERE confidence < 0.7")
def filter_low_confidence(v: Views):
    return L.low_confidence(v.preds).select("item", "predicted_label", "confidence")


@query("SELECT item, label, predicted_label FROM {preds} WHERE label <> predicted_label")
def filter_errors(v: Views):
    return L.misclassified(v.preds).select("item", "label", "predicted_label")
