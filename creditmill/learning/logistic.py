"""Logistic regression by Newton steps; each step is one aggregate of the Gram matrix and the gradient.

What meets on the driver is the triangle of a (inputs + 1)-square matrix, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.learning.design import Scale
from creditmill.session import staged

#: Newton steps, as many for any data.
STEPS = 8
#: Weight of the squared coefficients per row; it keeps dependent inputs solvable and leaves the intercept free.
RIDGE = 1e-6


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


@dataclass(frozen=True)
class Linear:
    """log odds = intercept + sum of coefficient x standardised input."""

    inputs: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def log_odds(self) -> Column:
        total = F.lit(self.intercept)
        for name, c in zip(self.inputs, self.coefficients):
            total = total + c * F.col(name)
        return total

    def probability(self) -> Column:
        return sigmoid(self.log_odds())

    def attributions(self) -> Column:
        """A map from input to coefficient x input.

        Standardised inputs are centred on the training mean, so entries and intercept add up to the log odds.
        """
        return F.create_map(*[x for name, c in zip(self.inputs, self.coefficients) for x in (F.lit(name), c * F.col(name))])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", self.intercept), *zip(self.inputs, self.coefficients)]
        return spark.createDataFrame(rows, "input string, coefficient double")


def fit(rows: DataFrame, scale: Scale, steps: int = STEPS) -> Linear:
    """Coefficients of standardised rows with a label ``y``; the rows are written once and read once a step."""
    names = scale.inputs
    beta = np.zeros(len(names) + 1)
    with staged(rows.select("y", *names), "logistic-rows") as own:
        for _ in range(steps):
            n, gradient, gram = _moments(own, names, beta)
            if not n:
                raise ValueError("logistic regression needs labelled rows")
            penalty = RIDGE * n * np.diag([0.0] + [1.0] * len(names))
            beta = beta + np.linalg.solve(gram + penalty, gradient - penalty @ beta)
    return Linear(tuple(names), float(beta[0]), tuple(beta[1:].tolist()))


def _moments(rows: DataFrame, names: Sequence[str], beta: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    model = Linear(tuple(names), float(beta[0]), tuple(beta[1:].tolist()))
    x = [F.lit(1.0), *[F.col(name) for name in names]]
    at = rows.withColumn("_p", model.probability())
    at = at.withColumns({"_w": F.col("_p") * (1 - F.col("_p")), "_e": F.col("y") - F.col("_p")})
    size = len(x)
    row = at.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("_e") * x[i]).alias(f"g_{i}") for i in range(size)],
        *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"h_{i}_{j}") for i in range(size) for j in range(i, size)],
    ).first()
    gram = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = row[f"h_{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"g_{i}"] or 0.0 for i in range(size)]), gram
