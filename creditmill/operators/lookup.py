"""Lookups by key and by attribute.

Each is a filter the parquet reader can use. ``matching`` is the set form: give
it all wanted keys at once instead of calling a lookup in a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(rows: DataFrame) -> DataFrame:
    """One of the few rows that a key has, the first by all columns that have an order."""
    return rows.orderBy(*[f.name for f in rows.schema if f.dataType.typeName() != "map"]).limit(1)


def get_by_id(table: DataFrame, key: str) -> DataFrame:
    return _first(table.where(F.col("id") == key))


def get_features(features: DataFrame, applicant_id: str) -> DataFrame:
    return _first(features.where(F.col("applicant_id") == applicant_id))


def get_explanation(explanations: DataFrame, prediction_id: str) -> DataFrame:
    return _first(explanations.where(F.col("prediction_id") == prediction_id))


def get_applicant_predictions(predictions: DataFrame, applicant_id: str) -> DataFrame:
    return predictions.where(F.col("applicant_id") == applicant_id)


def get_champion_model(models: DataFrame) -> DataFrame:
    """The champion; of several, the one trained last, then the smallest id."""
    return models.where(F.col("is_champion")).orderBy(F.desc("trained_at"), "id").limit(1)


def list_rows(table: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows by id."""
    return table.orderBy("id").limit(limit)


def matching(table: DataFrame, column: str, keys: DataFrame, key: str | None = None) -> DataFrame:
    """All rows whose column is among the keys of another frame."""
    wanted = keys.select(F.col(key or column).alias(column))
    return table.join(wanted, column, "left_semi")
