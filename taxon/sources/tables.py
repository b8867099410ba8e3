"""Item tables in CSV and snapshot folders."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of an item table.
REQUIRED_COLUMNS = ["item", "name", "description", "type", "category", "subcategory"]
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of rows without a partition value
ITEM_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [*REQUIRED_COLUMNS, "label"]])


def headers(spark: SparkSession, path: str | list[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by the column names in their first line, in one distributed pass; a header has no line break."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = (
        lines.where("file_block_start = 0")
        .withColumn("row", F.monotonically_increasing_id())
        .groupBy("file_path")
        .agg(F.min_by("value", "row").alias("line"))
        .orderBy("file_path")
    )
    found: dict[tuple[str, ...], list[str]] = {}
    for file, line in first.collect():  # a row for each file
        names = next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), [])
        found.setdefault(tuple(names), []).append(file)
    return found


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = ITEM_SCHEMA,
    sep: str = ",",
    multi_line: bool = False,
    required: tuple[str, ...] = (),
    file: str | None = None,
) -> DataFrame:
    """Delimited text with a header and quoted fields; columns go by name, whatever their order in a file.

    The result has the columns of ``schema`` that occur in any file, NULL for files without them; a file
    that lacks a ``required`` one is an error that names it. ``file`` adds the path of each row's file.
    Fields with line breaks need ``multi_line``, which reads each file in one task; convert large ones
    to Parquet once.
    """
    types = {f.name: f.dataType for f in schema.fields}
    groups = headers(spark, path, sep)
    for names, files in groups.items():
        for column in required:
            if column not in names:
                raise ValueError(f"column {column} not found in {files[0]}")
    present = [c for c in schema.names if any(c in names for names in groups)]
    parts = []
    for names, files in groups.items():
        own = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names])
        reader = spark.read.schema(own).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        rows = reader.option("multiLine", multi_line).csv(files)
        columns = [F.col(f"`{c}`") if c in names else F.lit(None).cast(types[c]).alias(c) for c in present]
        parts.append(rows.select(*columns, *([F.col("_metadata.file_path").alias(file)] if file else [])))
    if not parts:
        names = T.StructType([*schema.fields, *([T.StructField(file, T.StringType())] if file else [])])
        return spark.createDataFrame([], names)
    return reduce(DataFrame.unionByName, parts)


def read_labels(spark: SparkSession, paths: list[str], label: str = "label", schema: T.StructType = ITEM_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Pooled non-null labels of several files or patterns, with the file each came from."""
    if not paths:
        raise ValueError("no CSV path given")
    if label not in schema.names:
        raise ValueError(f"column {label} is not in the schema")
    rows = read_csv(spark, paths, schema, multi_line=multi_line, required=(label,), file="file")
    return rows.select(label, "file").where(F.col(label).isNotNull())


def with_required_columns(df: DataFrame, columns: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Absent columns are added and missing strings filled, both with the empty string."""
    absent = {c: F.lit("") for c in columns if c not in df.columns}
    return df.withColumns(absent).na.fill("")


def latest_snapshot(df: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Rows of the lexicographically last snapshot; nulls are none.

    On a table partitioned by ``snapshot`` the last one is found among the folder names, read with the type
    of the column, and the filter prunes the others before anything is read; any other table is scanned for
    the maximum.
    """
    folders = {unquote(m[1]) for f in df.inputFiles() if (m := re.search(rf"/{re.escape(snapshot)}=([^/]+)/", f))} - {NULL_FOLDER}
    values = [F.lit(name).try_cast(df.schema[snapshot].dataType).cast("string") for name in sorted(folders)]
    last = F.greatest(*values, *values[:1]) if values else df.agg(F.max(F.col(snapshot).cast("string"))).scalar()
    return df.where(F.col(snapshot).cast("string") == last)
