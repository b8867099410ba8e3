"""Exact quantiles without a buffer of all distinct values: distributed selection by histogram refinement.

The built-in exact percentile keeps every distinct value in one buffer. Here each wanted rank starts with
a bracket, the key's whole range of values. One aggregation per round counts the rows of every open bracket
in ``BUCKETS`` equal-width buckets, with each bucket's smallest and largest value; the bucket that holds the
rank becomes the new bracket (bounded by those actual values, so every round narrows it), and the rows below
it are added to the rank's offset. A bracket closes once it holds at most ``accuracy`` rows or one value;
then only its rows are ordered, a window of at most ``accuracy`` rows. Nothing can miss, so there is no
failure path; rounds go on until every bracket is closed (each round divides a bracket's width by
``BUCKETS``, and a bracket of one value closes at once).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 20_000
BUCKETS = 1024
MAX_KEYS = 10_000


def exact_quantiles(df: DataFrame, key: str, value: str, probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """(key, prob, quantile) with linear interpolation between neighbouring ranks; null values are left out.

    ``key`` takes few values fixed by the caller (feature names; at most ``MAX_KEYS``), so the brackets,
    a few per key and prob, are broadcast and their bucket counts come to the driver.
    """
    spark = df.sparkSession
    probs = sorted(probs)
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).limit(MAX_KEYS + 1).collect()
    if len(stats) > MAX_KEYS:
        raise ValueError(f"{key} has more than {MAX_KEYS} values")
    key_type = df.schema[key].dataType

    # bracket id -> [key, rank, lo, hi, rows below lo, rows inside]
    brackets: dict[int, list] = {}
    wanted: dict[tuple, tuple[int, int, float]] = {}
    for s in stats:
        ranks: dict[int, int] = {}
        for p in probs:
            position = (s["n"] - 1) * p
            left, right = math.floor(position), math.ceil(position)
            for rank in (left, right):
                if rank not in ranks:
                    ranks[rank] = len(brackets)
                    brackets[len(brackets)] = [s["k"], rank, s["lo"], s["hi"], 0, s["n"]]
            wanted[(s["k"], p)] = (ranks[left], ranks[right], position - left)

    def table(ids: list[int]) -> DataFrame:
        data = [(i, brackets[i][0], float(brackets[i][2]), float(brackets[i][3])) for i in ids]
        schema = T.StructType([
            T.StructField("id", T.IntegerType()), T.StructField("kb", key_type),
            T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
        ])
        return F.broadcast(spark.createDataFrame(data, schema))  # a few rows per key and prob

    def open_ids() -> list[int]:
        return [i for i, b in brackets.items() if b[5] > accuracy and b[2] < b[3]]

    while ids := open_ids():
        width = (F.col("hi") - F.col("lo")) / BUCKETS
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(BUCKETS - 1)).cast("int")
        inside = rows.join(table(ids), rows["k"].eqNullSafe(F.col("kb")))
        inside = inside.where(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("id", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by_id: dict[int, list] = {}
        for r in counts:
            by_id.setdefault(r["id"], []).append(r)
        for i in ids:
            b = brackets[i]
            offset = b[1] - b[4]
            for r in sorted(by_id.get(i, []), key=lambda r: r["b"]):
                if offset < r["c"]:
                    b[2], b[3], b[5] = r["lo"], r["hi"], r["c"]
                    break
                offset -= r["c"]
                b[4] += r["c"]

    # closed brackets: one value, or at most ``accuracy`` rows ordered in a window
    chosen: dict[int, float] = {i: b[2] for i, b in brackets.items() if b[2] >= b[3]}
    small = [i for i, b in brackets.items() if b[2] < b[3]]
    if small:
        inside = rows.join(table(small), rows["k"].eqNullSafe(F.col("kb")))
        inside = inside.where(F.col("v").between(F.col("lo"), F.col("hi"))).select("id", "v")
        offsets = spark.createDataFrame([(i, brackets[i][1] - brackets[i][4]) for i in small], "id int, offset long")
        ordered = inside.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("v")) - 1)
        for r in ordered.join(F.broadcast(offsets), "id").where(F.col("place") == F.col("offset")).select("id", "v").collect():
            chosen[r["id"]] = r["v"]

    out = [(k, p, chosen[lft] + (chosen[rgt] - chosen[lft]) * frac) for (k, p), (lft, rgt, frac) in wanted.items()]
    schema = T.StructType([T.StructField(key, key_type), T.StructField("prob", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    return spark.createDataFrame(out, schema)
