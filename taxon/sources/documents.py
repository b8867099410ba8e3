"""Snapshots of knowledge-base documents, one JSON document per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxon.functions import documents as D

SNAPSHOT_SCHEMA = "qid string, raw string"
PAGE_SNAPSHOT_SCHEMA = "title string, raw string"


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity snapshot as JSON lines of (qid, raw), parsed into maps."""
    return D.parse_entity(spark.read.schema(SNAPSHOT_SCHEMA).json(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshot as JSON lines of (title, raw), parsed into the page map."""
    return D.parse_pages(spark.read.schema(PAGE_SNAPSHOT_SCHEMA).json(path))
