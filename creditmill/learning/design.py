"""The rows that models are fitted on: a label and standardised inputs.

One rule holds for all models: an input that is missing or not finite counts as the mean of the training rows,
that is as zero after standardising.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "loan_status"
INPUTS = (
    "person_age",
    "person_income",
    "person_emp_exp",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
    "previous_loan_defaults_on_file",
    "homeownership_score",
    "intent_risk_score",
    "composite_risk_score",
)


def number(name: str) -> Column:
    """An input as a finite double or null; booleans are 0 and 1."""
    value = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(F.abs(value) < float("inf"), value)


def label(name: str = LABEL) -> Column:
    """0, 1 or null."""
    value = F.expr(f"try_cast(`{name}` AS int)")
    return F.when(value.isin(0, 1), value)


@dataclass(frozen=True)
class Scale:
    """Means and deviations of the inputs over the training rows."""

    inputs: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def standardised(self, rows: DataFrame, *kept: str) -> DataFrame:
        """The kept columns and every input standardised, under its own name."""
        return rows.select(*kept, *[self.column(name).alias(name) for name in self.inputs])

    def column(self, name: str) -> Column:
        at = self.inputs.index(name)
        return F.coalesce((number(name) - self.means[at]) / self.deviations[at], F.lit(0.0))


def fit_scale(rows: DataFrame, inputs: Sequence[str] = INPUTS) -> Scale:
    """One pass; an input without spread, or without any value, has deviation one."""
    row = rows.agg(
        *[F.avg(number(name)).alias(f"m_{name}") for name in inputs],
        *[F.stddev_pop(number(name)).alias(f"d_{name}") for name in inputs],
    ).first()
    means = tuple(row[f"m_{name}"] or 0.0 for name in inputs)
    return Scale(tuple(inputs), means, tuple(row[f"d_{name}"] or 1.0 for name in inputs))


def labelled(rows: DataFrame, name: str = LABEL) -> DataFrame:
    """Rows with a 0/1 label, which becomes ``y``."""
    return rows.withColumn("y", label(name)).where(F.col("y").isNotNull())
