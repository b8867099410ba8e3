import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxon.operators.profile import class_distribution
from taxon.session import scratch_path, scratch_root
from taxon.sources import lookup_cache, sinks, tables

ITEMS = [
    ("u1", 'a "quoted", name', "two\nlines", "entity", "music", None, "x"),
    ("u2", " padded ", "back\\slash", "concept", "films", "s", "y"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, tables.ITEM_SCHEMA)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_quotes_and_line_breaks_survive(spark, items, sep):
    path = scratch_path(spark, "t")
    sinks.write_delimited(items, path, sep)
    assert sorted(map(tuple, tables.read_csv(spark, path, sep=sep, multi_line=True).collect())) == ITEMS


def test_labels_are_pooled_and_checked(spark, items):
    paths = [scratch_path(spark, "t") for _ in range(2)]
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("label", T.StringType())])
    sinks.write_delimited(items.select("item", "label"), paths[0])
    sinks.write_delimited(items.select("item", F.when(F.col("label") == "x", "x").alias("label")), paths[1])
    assert sorted(r["label"] for r in tables.read_labels(spark, paths, schema=schema).collect()) == ["x", "x", "y"]
    with pytest.raises(ValueError, match="no CSV path"):
        tables.read_labels(spark, [])
    other = scratch_path(spark, "t")
    sinks.write_delimited(items.select("item"), other)
    with pytest.raises(ValueError, match="not found"):
        tables.read_labels(spark, [other], schema=schema)


def test_columns_go_by_name_in_every_file(spark):
    root = scratch_path(spark, "t")
    spark.createDataFrame([("X", "i1", "n1")], "label string, item string, name string").write.option("header", True).csv(f"{root}/a")
    spark.createDataFrame([("i2", "Y")], "item string, label string").write.option("header", True).csv(f"{root}/b")
    rows = tables.read_csv(spark, [f"{root}/a", f"{root}/b"]).collect()
    assert {(r["item"], r["name"], r["label"]) for r in rows} == {("i1", "n1", "X"), ("i2", None, "Y")}
    assert sorted(r["label"] for r in tables.read_labels(spark, [f"{root}/*"]).collect()) == ["X", "Y"]
    spark.createDataFrame([("i3", "notalabel")], "item string, other string").write.option("header", True).csv(f"{root}/c")
    with pytest.raises(ValueError, match="column label not found in .*/c/"):
        tables.read_labels(spark, [f"{root}/a", f"{root}/c"])


def test_absent_columns_are_reported_by_the_reader(spark):
    root = scratch_path(spark, "t")
    spark.createDataFrame([("n", "i")], "name string, item string").write.option("header", True).csv(root)
    df = tables.read_csv(spark, root)
    assert df.columns == ["item", "name"]
    assert tables.with_required_columns(df).first().asDict() == {c: {"item": "i", "name": "n"}.get(c, "") for c in ["item", "name", *tables.REQUIRED_COLUMNS[2:]]}


def test_required_columns(spark):
    df = spark.createDataFrame([("u", None)], "item string, name string")
    assert tables.with_required_columns(df).first().asDict() == {"item": "u", **{c: "" for c in tables.REQUIRED_COLUMNS[1:]}}


def test_latest_snapshot_reads_only_its_files(spark, items):
    path = scratch_path(spark, "t")
    stamped = items.withColumn("snapshot", F.when(F.col("label") == "x", "20250101_000000").otherwise("20250102_000000"))
    stamped.write.partitionBy("snapshot").parquet(path)
    latest = tables.latest_snapshot(spark.read.parquet(path))
    assert [r["item"] for r in latest.collect()] == ["u2"]
    assert "PartitionFilters: [isnotnull(snapshot" in latest._jdf.queryExecution().executedPlan().toString()


def test_cache_grows_once_per_key(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([("rome", "R", True, 3)], "key string, summary string, found boolean, languages bigint").write.parquet(path)
    source = spark.createDataFrame([("oslo", "x" * 900, True, 7)], "key string, summary string, found boolean, languages bigint")
    items = spark.createDataFrame([("Rome",), ("Oslo",), ("OSLO",), ("Nowhere",), (None,)], "name string")
    for _ in range(2):  # the second pass finds nothing to add
        cache = {r["key"]: r for r in lookup_cache.append_missing(items, path, source).collect()}
        assert sorted(cache) == ["nowhere", "oslo", "rome"]
    assert len(cache["oslo"]["summary"]) == 500 and cache["nowhere"]["found"] is False and cache["nowhere"]["languages"] == 0
    assert spark.read.parquet(path).count() == 3


def test_text_report_layout(spark):
    df = spark.createDataFrame(
        [("train", "b")] * 3 + [("train", "a")] + [("valid", "a")] + [("valid", None)], "split string, label string"
    )
    path = scratch_path(spark, "t")
    sinks.write_text_report(sinks.distribution_lines(class_distribution(df)), path, ["split", "pos", "class"])
    assert [r[0] for r in spark.read.text(path).collect()] == [
        "CLASS DISTRIBUTION SUMMARY",
        "=" * 40,
        "",
        "TRAIN SET",
        "Total samples: 4",
        "a: 1 samples (25.0%)",
        "b: 3 samples (75.0%)",
        "",
        "VALID SET",
        "Total samples: 1",
        "a: 1 samples (100.0%)",
    ]


def test_one_folder_per_class(spark, items):
    path = scratch_path(spark, "t")
    sinks.write_per_class(items.withColumnRenamed("label", "predicted_label"), path)
    assert {d for d in os.listdir(path) if "=" in d} == {"predicted_label=x", "predicted_label=y"}


def stub_session(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_scratch_folder_follows_the_session():
    assert scratch_path(stub_session("yarn", "hdfs:///shared/"), "t").startswith("hdfs:///shared/t-")
    assert scratch_root(stub_session("local[2]", None)) == scratch_root(stub_session("local[2]", None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(stub_session("yarn", None))


def test_stamped_names_sort_by_time():
    from datetime import datetime

    assert sinks.stamped("p", datetime(2025, 1, 2, 3, 4, 5)) == "p_20250102_030405"
