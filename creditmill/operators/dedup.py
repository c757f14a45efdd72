"""First occurrence wins, and only what is not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditmill.config import FINGERPRINT_COLUMNS

KEYS = list(FINGERPRINT_COLUMNS)


def distinct_fingerprints(df: DataFrame) -> DataFrame:
    return df.select(*KEYS).distinct()


def first_occurrences(rows: DataFrame, order: str = "row_no", keys: list[str] = KEYS) -> DataFrame:
    """The earliest row of each fingerprint, one row also where the order has ties.

    Spark's window group limit keeps one row per fingerprint and task before the shuffle, so a
    fingerprint shared by a third of all rows arrives as one row per task, and the rows are evaluated once.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_occurrence", number).where("_occurrence = 1").select(*rows.columns)


def new_occurrences(
    rows: DataFrame, stored: DataFrame, order: str = "row_no", keys: list[str] = KEYS
) -> DataFrame:
    """The earliest row of each fingerprint that is not among the stored ones.

    First occurrences are partitioned by their keys already, so only the stored keys are shuffled to meet them.
    """
    return first_occurrences(rows, order, keys).join(stored.select(*keys), keys, "left_anti").select(*rows.columns)
