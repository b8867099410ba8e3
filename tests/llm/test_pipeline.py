"""The corpus pipeline, stage by stage."""

import pytest
from conftest import SF_DIR

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        if name != "source_mixing":
            assert 0.8 * before <= docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_every_stage(spark):
    """Nulls in any column, empty texts, repeated rows and columns with clashing names."""
    good = " ".join(f"the {x}{y}er of" for x in "abcdefgh" for y in "klmnopq")
    other = " ".join(f"and {x}{y}ing in" for x in "rstuvwxy" for y in "abcdefg")
    rows = [
        (1, good, "en", "a", 10, "x"), (2, good, None, None, None, None), (3, None, "en", "a", 0, "x"), (4, "", "de", "", 0, "x"),
        (5, other, "en", "b", 9, "x"), (5, other, "en", "b", 9, "x"), (None, other + " " + good, "en", "a", 3, "x"), (7, "!!! 123", "en", "a", 1, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        seen.append(sorted((r.doc_id or 0) for r in docs.collect()))
    # the null-id row (unlike the others) and one of the two equal rows with id 5 pass the near_dedup stage
    assert seen[0] == seen[1] == [0, 1, 2, 5, 5] and seen[2] == [0, 1, 5] and set(seen[3]) <= {0, 1, 5}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id or 0 for r in packed} == set(seen[3])
