"""Writers for result tables and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBMISSION_COLUMNS = ["item", "name", "predicted_label", "confidence"]


def stamped(name: str, now: datetime | None = None) -> str:
    """Output name with the time of writing, e.g. ``predictions_20250101_120000``."""
    return f"{name}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Every task writes its own file; quotes inside a field are doubled."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        # white space at the ends of a field is data
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json_report(report: DataFrame, path: str) -> None:
    """A report is one nested row."""
    report.write.mode("overwrite").json(path)


def write_text_report(lines: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Lines of a bounded report (a few per class) as one file in the given order."""
    lines.coalesce(1).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def write_per_class(df: DataFrame, path: str, predicted: str = "predicted_label") -> None:
    """One folder per predicted class. Tasks write where they stand: no shuffle, so a class
    with most of the rows is still written by every task."""
    df.write.mode("overwrite").partitionBy(predicted).parquet(path)


def submission(df: DataFrame) -> DataFrame:
    return df.select(*SUBMISSION_COLUMNS)


def distribution_lines(distribution: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Text report of the class distribution: lines in the order (split, pos, class)."""

    def fixed(*lines) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), line.alias("line")) for i, line in enumerate(lines)]))

    # the distribution is one row per split and class
    top = distribution.agg(F.count(F.lit(1))).select(
        F.lit("").alias(split), fixed(F.lit("CLASS DISTRIBUTION SUMMARY"), F.lit("=" * 40))
    )
    heads = (
        distribution.groupBy(split)
        .agg(F.first("total").alias("total"))
        .select(
            split,
            fixed(
                F.lit(""),
                F.concat(F.upper(split), F.lit(" SET")),
                F.concat(F.lit("Total samples: "), F.col("total").cast("string")),
            ),
        )
    )
    per_class = distribution.select(
        split,
        F.lit(3).alias("pos"),
        F.concat(
            label, F.lit(": "), F.col("count").cast("string"), F.lit(" samples ("), F.col("pct").cast("string"), F.lit("%)")
        ).alias("line"),
        F.col(label).alias("class"),
    )
    titles = top.unionByName(heads).withColumn("class", F.lit(""))
    return titles.unionByName(per_class)
