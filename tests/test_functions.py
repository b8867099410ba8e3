import json
import math

import pytest
from pyspark.sql import functions as F

from taxon.functions import documents as D
from taxon.functions import features as X
from taxon.functions import labels as L
from taxon.functions import prompts as P
from taxon.functions import text as T
from taxon.operators import votes as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


# ---- text


@pytest.mark.parametrize(
    "uri,by_pattern,by_tail",
    [
        ("http://www.wikidata.org/entity/Q42", "Q42", "Q42"),
        ("http://www.wikidata.org/wiki/Property:P31", None, "Property:P31"),
        ("https://example.org/Q7/Q8", "Q7", None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_entity_ids(spark, uri, by_pattern, by_tail):
    df = spark.createDataFrame([(uri,)], "u string")
    row = df.select(T.entity_id_by_pattern(F.col("u")).alias("p"), T.entity_id_by_tail(F.col("u")).alias("t")).first()
    assert (row["p"], row["t"]) == (by_pattern, by_tail)


@pytest.mark.parametrize("value,words", [("", 0), (None, 0), ("  ", 0), ("a", 1), (" a\tb\n\nc  ", 3), ("a b", 2)])
def test_word_count(spark, value, words):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(T.word_count(F.col("s"))).first()[0] == words


def test_strip_and_fill(spark):
    df = spark.createDataFrame([(" \t a b \r\n\x0b\x0c", None)], "s string, n int")
    assert df.select(T.strip(F.col("s")), T.filled(F.col("n"))).first() == ("a b", "")


def test_truncation_counts_characters(spark):
    assert len(one(spark, T.truncated(F.col("s")), s="é" * 600)) == 500


# ---- prompts


def prompt_row(spark, **changes):
    row = dict(name="Fado", description="Music", type="concept", category="music", subcategory="genre", languages=30)
    row.update(changes)
    return spark.createDataFrame(
        [tuple(row.values())],
        "name string, description string, type string, category string, subcategory string, languages int",
    )


FIELDS = ["name", "description", "type", "category", "subcategory"]


def built(df, fn, *columns):
    return df.select(fn(*[F.col(c) for c in columns])).first()[0]


def test_prompts_with_all_fields(spark):
    df = prompt_row(spark)
    full = "Item: Fado. Description: Music. Type: concept. Category: music. Subcategory: genre."
    assert built(df, P.prompt_plain, "name", "description") == "Fado. Music"
    assert built(df, P.prompt_fields, *FIELDS) == full
    assert built(df, P.prompt_fields_lenient, *FIELDS) == full
    assert built(df, P.prompt_template, "name", "description", "category", "type").split("\n") == [
        "Classify the cultural specificity of this item:",
        "Name: Fado",
        "Description: Music",
        "Category: music",
        "Type: concept",
    ]


def test_blank_fields(spark):
    df = prompt_row(spark, description="  ", category="", subcategory=None)
    assert built(df, P.prompt_fields, *FIELDS) == "Item: Fado. Description:   . Type: concept."
    assert built(df, P.prompt_fields_lenient, *FIELDS) == "Item: Fado. Type: concept."


@pytest.mark.parametrize(
    "languages,tag",
    [
        (51, "[Global reach: 50+ languages]"),
        (50, "[International: 50 languages]"),
        (21, "[International: 21 languages]"),
        (20, None),
        (5, None),
        (4, "[Regional: 4 languages]"),
        (1, "[Regional: 1 languages]"),
        (0, None),
        (None, None),
    ],
)
def test_reach_tags(spark, languages, tag):
    prompt = built(prompt_row(spark, type="other", category="", languages=languages), P.prompt_enhanced, *FIELDS, "languages")
    parts = ["Item: Fado", "Description: Music", "Subcategory: genre"] + ([tag] if tag else [])
    assert prompt == ". ".join(parts) + ". Task: Classify cultural specificity as agnostic, representative, or exclusive."


def test_type_gloss_and_empty_description(spark):
    prompt = built(prompt_row(spark, type="entity", description=""), P.prompt_enhanced, *FIELDS, "languages")
    assert prompt.startswith("Item: Fado. Description: . Type: Named Entity (specific instance). Category: music")


@pytest.mark.parametrize(
    "summary,languages,text",
    [
        ("S.", 51, "Music Wikipedia: S. Available in 50+ languages."),
        ("S.", 21, "Music Wikipedia: S. Available in 21 languages."),
        ("", 20, "Music"),
    ],
)
def test_enriched_description(spark, summary, languages, text):
    df = prompt_row(spark, languages=languages).withColumn("summary", F.lit(summary))
    assert built(df, P.enriched_description, "description", "summary", "languages") == text


# ---- labels, probabilities, votes


def test_argmax_ties_go_to_the_first(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.25] * 4,), ([0.1, 0.2, 0.7],)], "p array<double>")
    assert [r[0] for r in df.select(L.argmax(F.col("p"))).collect()] == [1, 0, 2]


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "l array<double>")
    a, b = [r[0] for r in df.select(L.softmax(F.col("l"))).collect()]
    assert a == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)]) and b == [0.5, 0.5]


def test_label_maps(spark):
    df = spark.createDataFrame([("cultural exclusive",), ("unknown",)], "l string")
    ids = [r[0] for r in df.select(L.label_to_id(F.col("l"))).collect()]
    assert ids == [2, None]
    assert one(spark, L.id_to_label(F.col("i")), i=1) == "cultural representative"
    assert L.slug("cultural agnostic") == "cultural_agnostic"


CLASSES = ["a", "b", "c"]


def vote(spark, fn, *models):
    df = spark.createDataFrame([([list(m) for m in models],)], "model_probs array<array<double>>")
    return fn(df).first()


def test_majority_tie_goes_to_the_earliest_model(spark):
    a, b, c = (0.8, 0.1, 0.1), (0.1, 0.8, 0.1), (0.1, 0.1, 0.8)
    row = vote(spark, lambda d: V.majority_vote(d, CLASSES), c, a, b)
    assert row["predicted_label"] == "c" and row["confidence"] == pytest.approx(1 / 3)
    row = vote(spark, lambda d: V.majority_vote(d, CLASSES), c, b, a, b)
    assert row["predicted_label"] == "b" and row["prob_b"] == 0.5 and row["prob_a"] == 0.25
    row = vote(spark, lambda d: V.majority_vote(d, CLASSES), c, a, a, c)
    assert row["predicted_label"] == "c" and row["confidence"] == 0.5


def test_soft_votes(spark):
    models = [(0.6, 0.3, 0.1), (0.2, 0.5, 0.3)]
    row = vote(spark, lambda d: V.weighted_vote(d, CLASSES, [1, 3]), *models)
    assert row["predicted_label"] == "b" and row["prob_a"] == pytest.approx(0.3) and row["prob_b"] == pytest.approx(0.45)
    row = vote(spark, lambda d: V.average_vote(d, CLASSES, 2), *models)
    assert row["prob_a"] == pytest.approx(0.4) and row["predicted_label"] == "a"


# ---- features


def raw(spark, **changes):
    row = {c: 0 for c in X.ENRICHED_COLUMNS} | changes
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} bigint" for c in row))


@pytest.mark.parametrize("n", [0, 9, 10, 14, 15, 20, 21, 29, 30, 49, 50, 51])
def test_language_cut_offs(spark, n):
    row = X.with_language_bins(X.with_reach_flags(X.with_threshold_flags(X.with_rule_scores(raw(spark, num_languages=n))))).first()
    assert row["is_highly_global"] == (n > 20) and row["is_niche"] == (n < 10)
    assert row["is_very_global"] == (n > 50) and row["is_moderately_global"] == (15 <= n <= 50)
    assert (row["lang_bin_low"], row["lang_bin_mid"], row["lang_bin_high"]) == (n < 10, 10 <= n < 30, n >= 30)
    assert row["exclusivity_score"] == (2 if n < 15 else 0)
    assert row["representativeness_score"] == (2 if 15 <= n < 50 else 0)
    assert row["agnostic_score"] == (2 if n > 50 else 0) + 2


def test_missing_and_absent_raw_features(spark):
    df = spark.createDataFrame([(None, True)], "num_languages int, has_country boolean")
    row = X.with_default_features(df).first()
    assert row["num_languages"] == 0 and row["has_country"] == 1
    assert row["num_statements"] == 1 and row["statement_diversity"] == 0 and row["has_coordinates"] == 0
    assert row["en_page_length"] == 0


def test_finite_and_alignment(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(X.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]
    assert X.select_features(df, ["x"]).columns == ["x"]
    with pytest.raises(ValueError, match="y, z"):
        X.select_features(df, ["x", "y", "z"])


def test_onehot_of_missing_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string")
    rows = X.with_onehot_observed(df, "t", "t").select("t_a", "t_b").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError, match="more than 1"):
        X.observed_values(df, "t", 1)


def test_matrix_widths(spark):
    items = raw(spark, num_languages=3).selectExpr("*", "'n m' AS name", "'d' AS description", "'entity' AS type", "'food' AS category")
    wide = X.matrix_73(items)
    assert len(wide.columns) == 73 and len(X.matrix_33(items).columns) == 33
    row = wide.first()
    assert row["name_word_count"] == 2 and row["cat_food"] == 1 and row["type_entity"] == 1
    assert row["num_languages_cubed"] == pytest.approx(math.log(4) ** 3)


# ---- documents


def entity(spark, *rows):
    return D.parse_entity(spark.createDataFrame(list(rows), "qid string, raw string"))


def features_of(spark, raw_json, qid="Q1", **options):
    return D.with_claim_features(entity(spark, (qid, raw_json)), **options).first()


DOC = {
    "entities": {
        "Q1": {
            "sitelinks": {"enwiki": {"title": "T"}, "dewiki": {"title": "U"}, "commonswiki": {}, "enwikiquote": {}},
            "claims": {
                "P17": [{"mainsnak": {"datatype": "wikibase-item"}}],
                "P214": [{"mainsnak": {"datatype": "external-id"}}] * 2,
                "P999": [{"mainsnak": {"datatype": "string"}}, {"mainsnak": {"datatype": "external-id"}}],
                "P200": [{}],
                "X5": [{"mainsnak": {"datatype": "external-id"}}],
            },
        }
    }
}


def test_claim_features(spark):
    row = features_of(spark, json.dumps(DOC))
    assert row["num_languages"] == 3 and row["num_statements"] == 7 and row["statement_diversity"] == 5
    assert row["num_identifiers"] == 2 and row["has_country"] and not row["has_coordinates"]
    assert row["num_cultural_properties"] == row["num_geographic_properties"] == 1
    assert features_of(spark, json.dumps(DOC), numbered_ids=True)["num_identifiers"] == 2


@pytest.mark.parametrize("bad", ["{}", "[]", "junk", "", None, '{"entities": []}', '{"entities": {"Q2": {}}}'])
def test_unreadable_documents_give_defaults(spark, bad):
    row = features_of(spark, bad)
    assert row["num_languages"] == row["num_statements"] == row["num_identifiers"] == 0 and not row["has_country"]


def test_one_bad_branch_leaves_the_other(spark):
    doc = {"entities": {"Q1": {"sitelinks": [], "claims": DOC["entities"]["Q1"]["claims"]}}}
    row = features_of(spark, json.dumps(doc))
    assert row["num_languages"] == 0 and row["num_statements"] == 7
    doc = {"entities": {"Q1": {"sitelinks": DOC["entities"]["Q1"]["sitelinks"], "claims": []}}}
    row = features_of(spark, json.dumps(doc))
    assert row["num_languages"] == 3 and row["num_statements"] == 0


def pages(spark, doc):
    return D.parse_pages(spark.createDataFrame([(json.dumps(doc),)], "raw string"))


def test_page_stats(spark):
    missing = {"missing": "", "title": "x"}
    real = {"length": 12, "categories": [{"title": "a"}] * 3, "extlinks": [{"*": "u"}], "langlinks": [{}, {}]}
    both = pages(spark, {"query": {"pages": {"-1": missing, "7": real}}})
    row = D.with_page_stats(both, D.existing_page(F.col("pages"))).first()
    assert (row["en_page_length"], row["num_categories"], row["num_external_links"]) == (12, 3, 1)
    assert both.select(D.langlink_count(F.col("pages"))).first()[0] == 2
    first = D.with_page_stats(both, D.first_page(F.col("pages"))).first()
    assert first["en_page_length"] == 0
    empty = pages(spark, {"query": {"pages": []}})
    assert D.with_page_stats(empty, D.existing_page(F.col("pages"))).first()["en_page_length"] == 0


def test_unicode_white_space_and_null_fields(spark):
    pad = chr(160) + chr(0x2003)
    df = spark.createDataFrame([(f"{pad}a{pad}b{pad}", None)], "s string, n string")
    assert df.select(T.strip(F.col("s")), T.word_count(F.col("s"))).first() == (f"a{pad}b", 2)
    n = F.col("n")
    got = df.select(P.prompt_template(F.lit("x"), n, n, F.lit("t")), P.prompt_fields(n, n, n, n, n), P.prompt_enhanced(F.lit("x"), n, n, n, n, F.lit(10))).first()
    assert got[0].split("\n")[1:] == ["Name: x", "Description: ", "Category: ", "Type: t"]
    assert got[1].startswith("Item: .") and got[2].startswith("Item: x. Description: . ")
