"""Standard scaling with the population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per feature, fitted on one table and applied to any."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """A projection with literals; a constant feature is only centred."""
        return df.withColumns(
            {c: (F.col(c).cast("double") - m) / (self.deviations[c] or 1.0) for c, m in self.means.items()}
        )


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    # two numbers per feature come back, whatever the number of rows
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features],
    ).first()
    return Scaler({c: row[f"m_{c}"] for c in features}, {c: row[f"s_{c}"] for c in features})
