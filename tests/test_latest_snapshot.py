"""The last snapshot of partitioned tables with null and padded folder names."""

from taxon.sources.tables import latest_snapshot


def test_null_snapshot_is_not_the_last(spark, tmp_path):
    rows = [("2024-01", 1), ("2024-02", 2), ("2024-02", 3), (None, 4)]
    spark.createDataFrame(rows, "snapshot string, n int").write.partitionBy("snapshot").parquet(f"{tmp_path}/t")
    got = latest_snapshot(spark.read.parquet(f"{tmp_path}/t"))
    assert sorted(r.n for r in got.collect()) == [2, 3]


def test_folder_names_that_print_otherwise(spark, tmp_path):
    for name, n in [("005", 1), ("007", 2)]:
        spark.createDataFrame([(n,)], "n int").write.parquet(f"{tmp_path}/t/snapshot={name}")
    got = latest_snapshot(spark.read.parquet(f"{tmp_path}/t"))
    assert [(r.snapshot, r.n) for r in got.collect()] == [(7, 2)]
