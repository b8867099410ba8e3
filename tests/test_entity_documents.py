"""Entity documents at size: spread over tasks, parsed by branch, stored as compressed JSON."""

import pytest
from conftest import SF_DIR

import __spark_entry__  # noqa: F401  (registers the queries)
from taxon.functions import documents as D
from taxon.plans import registry, views
from taxon.session import scratch_root

RAWS = [
    '{"entities":{"Q1":{"sitelinks":{"enwiki":{"title":"A"}},"claims":{"P31":[{"mainsnak":{"datatype":"x"}}]}}}}',
    '{"entities":{"Q1":{"sitelinks":[],"claims":{"P31":[]}}}}',
    '{"entities":{"Q1":{"sitelinks":{"enwiki":{"title":"A"}},"claims":[]}}}',
    '{"entities":{"Q2":{"claims":{"P31":[]}}}}',
    '{"entities":{"Q1":{"claims":{"P31":null}',
    "junk",
    None,
]


def test_one_branch_is_read_as_with_both(spark):
    rows = spark.createDataFrame([("Q1", raw) for raw in RAWS], "qid string, raw string")
    both = [r.asDict() for r in D.parse_entity(rows).collect()]
    for branch in ("sitelinks", "claims"):
        one = D.parse_entity(rows, branches=(branch,))
        assert one.columns == ["qid", "raw", branch]
        assert [r[branch] for r in one.collect()] == [r[branch] for r in both]


def test_a_query_on_claims_does_not_build_the_site_links(spark):
    plan = registry.QUERIES["json_key_count"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "sitelinks" not in plan


def test_documents_of_one_file_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "DOCUMENTS_PER_TASK", 100)
    v = views.Views(spark, SF_DIR)
    facts, nations = v.view("facts").count(), v.table("nation").count()
    docs = v._entity_docs()
    assert docs.rdd.getNumPartitions() >= facts // 100
    assert docs.count() == facts + nations


@pytest.mark.parametrize("k, times, expected", [(1, 2, 2), (1, 0, 0), (1, -3, 0), (0, 5, None)])
def test_statement_lists(spark, k, times, expected):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(k, times)], "k int, times int")
    member = views._present(F.col("k") > 0, "P1", views._statements("string", F.col("times")))
    raw = F.concat(F.lit('{"entities":{"Q1":{"claims":{'), F.coalesce(member, F.lit("")), F.lit("}}}}"))
    claims = D.parse_entity(row.select(F.lit("Q1").alias("qid"), raw.alias("raw"))).first()["claims"]
    assert (len(claims["P1"]) if claims else None) == expected


def test_entity_snapshot_is_compressed(spark):
    from pathlib import Path

    before = set(Path(scratch_root(spark)).glob("entities-*"))
    assert registry.QUERIES["src_entity_json"](spark, SF_DIR).count() > 0
    (new,) = set(Path(scratch_root(spark)).glob("entities-*")) - before
    files = [f.name for f in new.iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
