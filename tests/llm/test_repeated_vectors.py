"""Neighbours in tables that repeat ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

hilbert_search = pytest.importorskip("taxon.llm.hilbert_search")


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def found(table, **setting):
    got = hilbert_search.search(table, F.col("vec_id") % 20 == 0, setting=hilbert_search.Curves(**setting)).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("block", [2048, 32])
def test_repeated_ids_count_once(spark, block):
    vectors = np.random.default_rng(5).normal(size=(120, 8)).tolist()
    rows = list(enumerate(vectors))
    plain = found(table_of(spark, rows), block=block)
    assert len(plain) == 6 * 20 or block < 2048
    assert found(table_of(spark, rows * 2), block=block) == plain
    assert found(table_of(spark, rows + rows[7:8] * 99), block=block) == plain


def test_differing_rows_of_an_id(spark):
    vectors = np.random.default_rng(6).normal(size=(60, 8)).tolist()
    greater = [(k, [v[0] + 1, *v[1:]]) for k, v in enumerate(vectors)]
    longer = [(3, vectors[3] + [1.0])] * 100
    rows = list(enumerate(vectors))
    assert found(table_of(spark, longer + greater + rows)) == found(table_of(spark, rows))
