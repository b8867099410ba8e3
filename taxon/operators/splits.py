"""Stratified splits and folds by a seeded hash of the key.

Within a class, rows are ordered by the hash and cut at exact ranks. Finding a cut needs
no ordering of the class: bucket counts locate the bucket that holds it, and only that
bucket is looked at row by row. The cuts (a few per class) then go to the data, so the
wide rows are not shuffled and no task sees a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taxon.operators.labels import MAX_CLASSES, bounded_classes
from taxon.session import cut_lineage

BUCKET_DIGITS = 4  # 65536 buckets per class


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def bucket_counts(df: DataFrame, label: str, key: str, seed: int, digits: int) -> DataFrame:
    """Rows per class and leading hash digits: at most ``16 ** digits`` rows per class."""
    labelled = df.where(F.col(label).isNotNull())
    bucket = F.substring(seeded_hash(key, seed), 1, digits).alias("bucket")
    # kept as a checkpoint: sizes, ends and cuts all start from it without another scan
    return cut_lineage(labelled.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("c")))


def class_sizes(buckets: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> DataFrame:
    return bounded_classes(buckets.groupBy(label).agg(F.sum("c").alias("n")), max_classes)


def hash_cuts(
    df: DataFrame, buckets: DataFrame, ends: DataFrame, label: str, key: str, seed: int, digits: int
) -> DataFrame:
    """(label, cuts): the hash at which each part of a class ends.

    ``ends`` holds (label, part, end): the parts of each class in order with the rank at
    which they end. ``key`` must be unique; copies of a key share a hash and stay together.
    """
    upto = F.sum("c").over(W.partitionBy(label).orderBy("bucket"))
    located = (
        buckets.withColumn("upto", upto)
        .join(ends, label)
        .where((F.col("upto") - F.col("c") < F.col("end")) & (F.col("end") <= F.col("upto")))
        .select(label, "part", "bucket", (F.col("end") - (F.col("upto") - F.col("c"))).alias("rest"))
    )
    hashed = df.select(label, seeded_hash(key, seed).alias("h")).withColumn("bucket", F.substring("h", 1, digits))
    # only rows of the located buckets remain; copies of a hash collapse into one
    candidates = (
        hashed.join(F.broadcast(located), [label, "bucket"])
        .groupBy(label, "part", "rest", "h")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    reached = F.sum("c").over(W.partitionBy(label, "part").orderBy("h"))
    cut = candidates.withColumn("reached", reached).where(F.col("reached") >= F.col("rest"))
    found = cut.groupBy(label, "part").agg(F.min("h").alias("cut"))
    # a part without rows ends before every hash
    all_parts = ends.join(found, [label, "part"], "left").withColumn("cut", F.coalesce("cut", F.lit("")))
    return all_parts.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "cut"))), lambda p: p["cut"]).alias("cuts")
    )


def _with_part(df: DataFrame, cuts: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Add ``part``, the number of cuts before the row; NULL for a row without a label.

    There is a row of cuts for each class, and the number of classes is bounded.
    """
    joined = df.join(F.broadcast(cuts), label, "left")
    h = seeded_hash(key, seed)
    part = F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c < h)))
    return joined.withColumn("part", part).drop("cuts")


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add ``split``: ``ceil(share * rows)`` rows are valid, spread by largest remainder."""
    buckets = bucket_counts(df, label, key, seed, digits)
    sizes = class_sizes(buckets, label)
    # windows over one row per class
    whole = W.partitionBy(F.lit(1))
    quota = F.col("n") * F.lit(test_share)
    parts = sizes.withColumns({"base": F.floor(quota), "remainder": F.round(quota - F.floor(quota), 9)})
    missing = F.ceil(F.sum("n").over(whole) * F.lit(test_share)) - F.sum("base").over(whole)
    order = F.row_number().over(whole.orderBy(F.desc("remainder"), label))
    ends = parts.withColumns({"missing": missing, "order": order}).select(
        label,
        F.lit(0).alias("part"),
        (F.col("base") + (F.col("order") <= F.col("missing")).cast("int")).alias("end"),
    )
    cuts = hash_cuts(df, buckets, ends, label, key, seed, digits)
    tagged = _with_part(df, cuts, label, key, seed)
    split = F.when(F.col("part") == 0, F.lit("valid")).when(F.col("part") > 0, F.lit("train"))
    return tagged.withColumn("split", split).drop("part")


def stratified_folds(
    df: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Add ``fold``: balanced to within one row per class and in total.

    The classes, in label order, deal their rows out to the folds in turn, each class
    starting where the one before it stopped; that fixes how many rows a class gives to a
    fold. Which rows is decided by the hash.
    """
    buckets = bucket_counts(df, label, key, seed, digits)
    sizes = class_sizes(buckets, label)
    # windows over one row per class
    before = W.partitionBy(F.lit(1)).orderBy(label).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = F.pmod(F.col("fold") - F.col("offset"), F.lit(folds))
    dealt = F.greatest(F.lit(0), F.ceil((F.col("n") - first) / F.lit(folds)))
    per_fold = offsets.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).withColumn(
        "dealt", dealt
    )
    ends = per_fold.select(
        label, F.col("fold").alias("part"), F.sum("dealt").over(W.partitionBy(label).orderBy("fold")).alias("end")
    )
    cuts = hash_cuts(df, buckets, ends, label, key, seed, digits)
    return _with_part(df, cuts, label, key, seed).withColumnRenamed("part", "fold")


def tagged_union(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Both tables in one, each row tagged with its split."""
    return train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))
