"""Batch scoring: every application by every model of a table of models, in one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.operators.policy import risk_tier

# Fixed value: the confidence from which an application is approved.
LEAST_CONFIDENCE = 0.5


def score_all(rows: DataFrame, models: Mapping[str, Column], key: str) -> DataFrame:
    """(key, model_id, approval_probability, predicted_outcome, risk_tier) for every row and model.

    ``models`` maps an id to the probability of the label 1, an expression over ``rows``. The rows are read once and
    nothing is shuffled. The risk is what is missing to certainty of approval.
    """
    made = F.array(*[F.struct(F.lit(name).alias("model_id"), p.alias("p")) for name, p in models.items()])
    scored = rows.select(key, F.explode(made).alias("m")).select(key, "m.*")
    p = F.round("p", 4)
    return scored.select(
        key,
        "model_id",
        p.cast("decimal(6,4)").alias("approval_probability"),
        F.when(p >= LEAST_CONFIDENCE, "approved").otherwise("rejected").alias("predicted_outcome"),
        risk_tier(1.0 - p).alias("risk_tier"),
    )
