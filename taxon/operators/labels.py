"""Label ids taken from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from taxon.operators.joins import lookup_join

MAX_CLASSES = 10_000


def bounded_classes(classes: DataFrame, max_classes: int = MAX_CLASSES) -> DataFrame:
    """A table with a row for each class; fails at run time beyond ``max_classes`` rows.

    The bound is what allows the table to be ordered in one task and broadcast.
    """
    count = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    many = F.raise_error(F.lit(f"more than {max_classes} classes"))
    return classes.withColumn("_ok", F.when(count <= max_classes, True).otherwise(many.cast("boolean"))).where("_ok").drop("_ok")


def alphabetical_ids(df: DataFrame, label: str = "label", max_classes: int = MAX_CLASSES) -> DataFrame:
    """(label, label_id): ids from 0 in label order. One row per class."""
    # the window runs over the class table, never over data rows
    order = W.partitionBy(F.lit(1)).orderBy(label)
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    return bounded_classes(classes, max_classes).withColumn("label_id", F.row_number().over(order) - 1)


def with_alphabetical_id(df: DataFrame, label: str = "label") -> DataFrame:
    return lookup_join(df, F.broadcast(alphabetical_ids(df, label)), label)


def with_label_of_id(df: DataFrame, ids: DataFrame, label: str = "label") -> DataFrame:
    """Inverse of the encoding: the label that belongs to each ``label_id``."""
    return lookup_join(df, ids.select("label_id", F.col(label).alias("decoded_label")), "label_id")
