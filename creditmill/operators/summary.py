"""Summaries of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.numeric import as_double, to_bool

GROUPED_COLUMNS = ("income_bucket", "credit_score_tier", "employment_stability")


def _cells(features: DataFrame) -> DataFrame:
    """Counts per combination of the three code columns.

    Their domains are fixed (4 x 5 x 2), so one combined-before-shuffle pass
    reduces any number of rows to a few dozen; all summaries are sums over it.
    """
    label = as_double(features, "loan_status")
    risky = to_bool(features, "is_high_risk")
    return features.groupBy(*GROUPED_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(risky).alias("risk_known"),
        F.sum(risky.cast("bigint")).alias("high_risk"),
        F.count(label).alias("labelled"),
        F.sum(label).alias("approved"),
    )


def summarise(features: DataFrame) -> DataFrame:
    """One row: size, high-risk count and share, approved count and share."""
    width = len(features.columns)
    return _cells(features).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.lit(width).alias("column_count"),
        F.coalesce(F.sum("high_risk"), F.lit(0)).alias("high_risk_rows"),
        F.try_divide(F.sum("high_risk"), F.sum("risk_known")).alias("high_risk_share"),
        F.coalesce(F.sum("approved"), F.lit(0.0)).alias("approved_rows"),
        F.try_divide(F.sum("approved"), F.sum("labelled")).alias("approved_share"),
    )


def value_counts(features: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (
        features.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def summary_counts(features: DataFrame) -> DataFrame:
    """The three frequency tables in long form, from a single pass."""
    long = _cells(features).select(
        "rows",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("column_name"), F.col(name).alias("value"))
                    for name in GROUPED_COLUMNS
                ]
            )
        ).alias("cell"),
    )
    return (
        long.where(F.col("cell.value").isNotNull())
        .groupBy("cell.column_name", "cell.value")
        .agg(F.sum("rows").alias("count"))
        .orderBy("column_name", F.desc("count"), "value")
    )
