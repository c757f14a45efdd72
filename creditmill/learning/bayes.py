"""Gaussian naive Bayes from sufficient statistics, and its cross-validation in one pass.

Counts, sums and sums of squares per class add up, so the statistics of all folds come from one aggregate and
the model that never saw a fold is the total less that fold.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.learning.design import Scale
from creditmill.operators.ranks import totals_before

#: Added to every variance, in units of the input's variance over all rows.
SMOOTHING = 1e-9
CLASSES = (0, 1)


@dataclass(frozen=True)
class Statistics:
    """Rows, and per input the sum and the sum of squares, of one class."""

    n: int
    sums: tuple[float, ...]
    squares: tuple[float, ...]

    def minus(self, other: Statistics) -> Statistics:
        pairs = zip(self.sums, other.sums), zip(self.squares, other.squares)
        return Statistics(self.n - other.n, *(tuple(a - b for a, b in p) for p in pairs))

    def plus(self, other: Statistics) -> Statistics:
        return Statistics(
            self.n + other.n,
            tuple(a + b for a, b in zip(self.sums, other.sums)),
            tuple(a + b for a, b in zip(self.squares, other.squares)),
        )

    @property
    def means(self) -> tuple[float, ...]:
        return tuple(s / self.n for s in self.sums)

    @property
    def variances(self) -> tuple[float, ...]:
        return tuple(max(q / self.n - (s / self.n) ** 2, 0.0) + SMOOTHING for s, q in zip(self.sums, self.squares))


@dataclass(frozen=True)
class NaiveBayes:
    """A model table in standardised inputs: prior, means and variances of both classes."""

    inputs: tuple[str, ...]
    classes: Mapping[int, Statistics]

    def __post_init__(self):
        if any(self.classes[c].n == 0 for c in CLASSES):
            raise ValueError("naive Bayes needs rows of both classes")

    def prior(self, c: int) -> float:
        return self.classes[c].n / sum(s.n for s in self.classes.values())

    def log_odds(self) -> Column:
        """log P(1 | x) - log P(0 | x) of a row of standardised inputs."""
        total = F.lit(self.prior(1)) / F.lit(self.prior(0))
        total = F.log(total)
        no, yes = self.classes[0], self.classes[1]
        for name, m0, v0, m1, v1 in zip(self.inputs, no.means, no.variances, yes.means, yes.variances):
            x = F.col(name)
            total = total + (0.5 * F.log(F.lit(v0) / F.lit(v1)) + (x - m0) * (x - m0) / (2 * v0) - (x - m1) * (x - m1) / (2 * v1))
        return total

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.log_odds()))

    def linear(self) -> tuple[float, tuple[float, ...]]:
        """Intercept and coefficients of the log odds when both classes share their pooled variances."""
        no, yes = self.classes[0], self.classes[1]
        coefficients, n = [], no.n + yes.n
        intercept = 0.0
        for m0, v0, m1, v1 in zip(no.means, no.variances, yes.means, yes.variances):
            pooled = (no.n * v0 + yes.n * v1) / n
            coefficients.append((m1 - m0) / pooled)
            intercept -= (m1 * m1 - m0 * m0) / (2 * pooled)
        return intercept, tuple(coefficients)

    def table(self, spark: SparkSession) -> DataFrame:
        """(class, input, rows, prior, mean, variance)."""
        rows = [
            (c, name, s.n, self.prior(c), m, v)
            for c, s in self.classes.items()
            for name, m, v in zip(self.inputs, s.means, s.variances)
        ]
        return spark.createDataFrame(rows, "class int, input string, rows bigint, prior double, mean double, variance double")


def statistics(rows: DataFrame, inputs: tuple[str, ...], group: str | None = None) -> dict[tuple, Statistics]:
    """{(group, class): statistics} of standardised rows with a label ``y``; one pass, combined before the shuffle."""
    keys = ["y"] if group is None else [group, "y"]
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(name).alias(f"s_{name}") for name in inputs],
        *[F.sum(F.col(name) * F.col(name)).alias(f"q_{name}") for name in inputs],
    )
    return {
        (None if group is None else r[group], r["y"]): Statistics(
            r["n"], tuple(r[f"s_{name}"] for name in inputs), tuple(r[f"q_{name}"] for name in inputs)
        )
        for r in found.collect()
    }


def _nothing(inputs) -> Statistics:
    return Statistics(0, (0.0,) * len(inputs), (0.0,) * len(inputs))


def fit(rows: DataFrame, scale: Scale) -> NaiveBayes:
    """A model of standardised rows with a label ``y``."""
    found = statistics(rows, scale.inputs)
    return NaiveBayes(scale.inputs, {c: found.get((None, c), _nothing(scale.inputs)) for c in CLASSES})


def fit_without_each_fold(rows: DataFrame, scale: Scale, fold: str = "fold") -> dict[int, NaiveBayes]:
    """For every fold the model of all other folds; the rows are read once."""
    found = statistics(rows, scale.inputs, fold)
    total = {c: _nothing(scale.inputs) for c in CLASSES}
    for (_, c), own in found.items():
        total[c] = total[c].plus(own)
    folds = sorted({f for f, _ in found})
    return {
        f: NaiveBayes(scale.inputs, {c: total[c].minus(found.get((f, c), _nothing(scale.inputs))) for c in CLASSES})
        for f in folds
    }


def out_of_fold(rows: DataFrame, models: Mapping[int, NaiveBayes], fold: str = "fold") -> DataFrame:
    """``rows`` with ``probability`` by the model that never saw the row's fold."""
    chosen = F.lit(None).cast("double")
    for number, model in models.items():
        chosen = F.when(F.col(fold) == number, model.probability()).otherwise(chosen)
    return rows.withColumn("probability", chosen)


def fold_scores(scored: DataFrame, fold: str = "fold", cut: float = 0.5) -> DataFrame:
    """(fold, rows, accuracy, precision, recall, f1_weighted, auc) of rows with ``y`` and ``probability``.

    Rows are counted per fold and score before the shuffle; ranks are taken by ranges of scores.
    """
    values = (
        scored.select(fold, "y", F.round("probability", 9).alias("score"))
        .groupBy(fold, "score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )
    yes = F.col("score") >= cut
    with totals_before(values, "score", ["neg"], [fold]) as ranked:
        won = F.col("pos").cast("decimal(38,0)") * (2 * F.col("before_neg") + F.col("neg"))
        counts = ranked.groupBy(fold).agg(
            F.sum(F.when(yes, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(yes, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~yes, F.col("pos")).otherwise(0)).alias("fn"),
            F.sum(F.when(~yes, F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(won).alias("won"),
        ).collect()
    rows = []
    for r in counts:
        tp, fp, fn, tn = r["tp"], r["fp"], r["fn"], r["tn"]
        n, pos, neg = tp + fp + fn + tn, tp + fn, fp + tn
        f1_yes = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        f1_no = 2 * tn / (2 * tn + fp + fn) if tn + fp + fn else 0.0
        rows.append(
            (
                r[fold],
                n,
                (tp + tn) / n,
                tp / (tp + fp) if tp + fp else None,
                tp / pos if pos else None,
                (f1_yes * pos + f1_no * neg) / n,
                float(r["won"]) / (2 * pos * neg) if pos and neg else None,
            )
        )
    schema = "fold int, rows bigint, accuracy double, precision double, recall double, f1_weighted double, auc double"
    return scored.sparkSession.createDataFrame(rows, schema)
