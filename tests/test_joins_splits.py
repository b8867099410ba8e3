from collections import Counter

import pytest
from pyspark.sql import functions as F

from taxon.operators import joins as J
from taxon.operators.augment import augment_texts
from taxon.operators.labels import alphabetical_ids
from taxon.operators.splits import seeded_hash, stratified_folds, stratified_split


def skewed(spark, rows=2000):
    """A third of the rows share one key, a tenth have none, and full copies occur."""
    ids = spark.range(0, rows, 1, 8)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))
    )
    return ids.select(key.alias("key"), (F.col("id") % 5).alias("payload"))


def lookup(spark):
    rows = [("hot", 1)] + [(f"k{i}", i) for i in range(0, 97, 2)] + [("unused", -1)]
    return spark.createDataFrame(rows, "key string, value int")


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_runs_no_job_and_stays_plain(spark, how):
    left, right = skewed(spark), lookup(spark)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    joined = J.lookup_join(left, right, "key", how)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before and plan.count("Join") == 1
    assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, left.join(right, "key", how).collect()))


def test_too_many_classes_are_refused(spark):
    df = spark.range(12).select(F.col("id").cast("string").alias("label"))
    assert alphabetical_ids(df, max_classes=12).count() == 12
    with pytest.raises(Exception, match="more than 11 classes"):
        alphabetical_ids(df, max_classes=11).collect()


def test_coverage_counts_and_failure(spark):
    truth = spark.createDataFrame([("a",), ("b",)], "item string")
    pred = spark.createDataFrame([("a",), ("a",), ("z",)], "item string")
    assert tuple(J.require_coverage(truth, pred).first()) == (2, 1, 1)
    assert [r[0] for r in J.unmatched(truth, pred).collect()] == ["b"]
    with pytest.raises(Exception, match="no item occurs in both"):
        J.require_coverage(truth, spark.createDataFrame([("z",)], "item string")).collect()


def test_best_entity_per_label(spark):
    index = spark.createDataFrame(
        [("Rome", "Q9", 2), ("rome", "Q1", 1), ("ROME", "Q5", 1), ("Oslo", "Q3", 7)], "label string, qid string, rank int"
    )
    items = spark.createDataFrame([("x", "ROME"), ("y", "Paris")], "item string, name string")
    got = {r["item"]: r["qid"] for r in J.resolve_names(items, index).collect()}
    assert got == {"x": "Q1", "y": None}


# published class counts and the sizes of their 20 % split
PUBLISHED = {"agnostic": 1872, "representative": 2691, "exclusive": 1688}
PUBLISHED_VALID = {"agnostic": 375, "representative": 538, "exclusive": 338}


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame(list(PUBLISHED.items()), "label string, n int")
    df = df.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    return df.withColumn("id", F.concat("label", F.col("i").cast("string"))).cache()


@pytest.mark.parametrize("digits", [1, 4])
def test_split_sizes_are_the_published_ones(labelled, digits):
    split = stratified_split(labelled, "id", digits=digits)
    sizes = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label, n in PUBLISHED_VALID.items():
        assert sizes[label, "valid"] == n and sizes[label, "train"] == PUBLISHED[label] - n


def test_split_takes_the_smallest_hashes_and_is_repeatable(labelled):
    split = stratified_split(labelled, "id").withColumn("h", seeded_hash("id", 42))
    rows = split.where("label = 'exclusive'").select("split", "h").collect()
    valid = [r["h"] for r in rows if r["split"] == "valid"]
    train = [r["h"] for r in rows if r["split"] == "train"]
    assert max(valid) < min(train)
    again = stratified_split(labelled.repartition(5), "id").where("split = 'valid'").select("id")
    assert again.exceptAll(split.where("split = 'valid'").select("id")).count() == 0
    other = stratified_split(labelled, "id", seed=7).where("split = 'valid'").select("id")
    assert other.exceptAll(again).count() > 0


@pytest.mark.parametrize("folds", [2, 5, 7])
def test_folds_are_balanced_per_class_and_in_total(labelled, folds):
    counts = stratified_folds(labelled, "id", folds=folds).groupBy("label", "fold").count().collect()
    total = Counter()
    for label in PUBLISHED:
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == folds and max(sizes) - min(sizes) <= 1
    for r in counts:
        total[r["fold"]] += r["count"]
    assert sum(total.values()) == 6251 and max(total.values()) - min(total.values()) <= 1


def test_tiny_classes_and_missing_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, label string")
    folds = {r["id"]: r["fold"] for r in stratified_folds(df, "id", folds=5).collect()}
    assert folds[4] is None and len({folds[i] for i in (1, 2, 3)}) == 3
    split = {r["id"]: r["split"] for r in stratified_split(df, "id", test_share=0.5).collect()}
    assert split[4] is None and sorted(split[i] for i in (1, 2, 3)) == ["train", "valid", "valid"]


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit("a").alias("label"))
    parts = stratified_split(df, "id").where("id = -1").select("split").distinct().count()
    assert parts == 1


def test_augmentation_keeps_every_original(spark):
    df = spark.createDataFrame([(i, f"l{i % 3}", "One. Two. Three. Four" if i % 2 else "Short. Text") for i in range(60)], "id int, label string, text string")
    out = augment_texts(df, "id").collect()
    originals = [r for r in out if r["version"] == 0]
    copies = [r for r in out if r["version"] == 1]
    assert len(originals) == 60 and 0 < len(copies) < 30
    for r in copies:
        assert sorted(r["text"].split(". ")) == ["Four", "One", "Three", "Two"]
        assert r["label"] == f"l{r['id'] % 3}"
