import random
import statistics

import numpy as np
import pytest

from taxon.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def check(spark, groups, accuracy):
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "k", "v", PROBS, accuracy).collect()}
    assert len(got) == len(groups) * len(PROBS)
    for k, values in groups.items():
        for p in PROBS:
            assert got[k, p] == pytest.approx(np.quantile([v for v in values if v is not None], p), abs=1e-12)


@pytest.mark.parametrize("accuracy", [100, 1000, 100_000])
def test_matches_numpy_below_and_above_the_sketch_size(spark, accuracy):
    rng = random.Random(1)
    check(
        spark,
        {
            "smooth": [rng.random() for _ in range(3000)],
            "few values": [float(rng.randrange(5)) for _ in range(3000)],
            "one hot value": [0.0] * 2000 + [rng.gauss(0, 1) for _ in range(1000)],
            "constant": [7.0] * 500,
        },
        accuracy,
    )


def test_tiny_groups_and_missing_values(spark):
    check(spark, {"one": [3.0], "two": [1.0, 2.0], "gap": [1.0, None, 5.0, 2.0]}, 20_000)


def test_median_of_even_count(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)], "k string, v double")
    assert exact_quantiles(df, "k", "v", [0.5]).first()["quantile"] == statistics.median([1, 2, 3, 4])


def test_small_windows_on_many_values_refine_until_exact(spark):
    """accuracy 10 on 100,000 values: brackets narrow by bucket counts until at most ten rows are ordered."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 60_000), rng.exponential(1e-9, 30_000), np.full(10_000, 2.5)])
    df = spark.createDataFrame([("x", float(v)) for v in values], "k string, v double").repartition(8)
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "k", "v", [0.0, 0.1, 0.31, 0.5, 0.9, 0.97, 1.0], 10).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), abs=1e-15)
