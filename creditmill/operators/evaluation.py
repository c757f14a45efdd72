"""Scores of models, retrieval and human ratings.

The stored tables have columns for these results; the formulas are this
package's own. Everything is counted per class, group or score value before the
shuffle, so what is moved does not grow with the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.operators.ranks import totals_before
from creditmill.session import stage


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def classification_metrics(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """Accuracy, precision, recall and class-weighted F1 of 0/1 labels; one row."""
    cells = (
        rows.select(label.cast("int").alias("y"), predicted.cast("int").alias("p"))
        .dropna()
        .agg(
            F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
            F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
            F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
            F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    f1_yes = F.coalesce(_share(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    f1_no = F.coalesce(_share(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    return cells.select(
        total.alias("rows"),
        _share(tp + tn, total).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(f1_yes * (tp + fn) + f1_no * (tn + fp), total).alias("f1_weighted"),
    )


def roc_auc(rows: DataFrame, label: Column, score: Column) -> DataFrame:
    """Area under the ROC curve by average ranks, ties counted half; one row.

    Scores keep all their digits; the running count is taken by ranges of scores.
    """
    values = (
        rows.select(label.cast("int").alias("y"), score.cast("double").alias("score"))
        .dropna()
        .groupBy("score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )
    with totals_before(values, "score", ["neg"]) as ranked:
        # Halves are counted doubled, so that the sum is exact whatever its order.
        won = F.col("pos").cast("decimal(38,0)") * (2 * F.col("before_neg") + F.col("neg"))
        totals = ranked.agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    pairs = 2 * (totals["pos"] or 0) * (totals["neg"] or 0)
    auc = float(totals["won"] / pairs) if pairs else None
    return rows.sparkSession.createDataFrame([(auc,)], "auc double")


def fairness_by_group(
    rows: DataFrame, group: str, label: Column, predicted: Column
) -> DataFrame:
    """Per group: rate of positive predictions, true and false positive rate.

    The selection rates are the entries of a ``demographic_parity`` map, the
    other two those of ``equalized_odds``.
    """
    y, p = label.cast("int"), predicted.cast("int")
    return (
        rows.where(F.col(group).isNotNull() & y.isNotNull() & p.isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            _share(F.sum(p), F.count(F.lit(1))).alias("selection_rate"),
            _share(F.count_if((y == 1) & (p == 1)), F.count_if(y == 1)).alias("true_positive_rate"),
            _share(F.count_if((y == 0) & (p == 1)), F.count_if(y == 0)).alias("false_positive_rate"),
        )
    )


def fairness_gaps(groups: DataFrame) -> DataFrame:
    """Largest minus smallest group rate; equalized odds takes the wider of its two gaps."""

    def gap(rate: str) -> Column:
        return F.max(rate) - F.min(rate)

    return groups.agg(
        gap("selection_rate").alias("demographic_parity"),
        F.greatest(gap("true_positive_rate"), gap("false_positive_rate")).alias("equalized_odds"),
    )


def rater_agreement(ratings: DataFrame, score: str, panel: Sequence[str] | None = None) -> DataFrame:
    """Cohen's kappa of every pair of evaluators, on the items both rated.

    The evaluators are those of the data, or those of ``panel`` only. An evaluator's repeated ratings of an item count as one,
    their mean rounded half up; null scores are none. Ratings are shuffled once, by item. An item's ratings are gathered in its row, as many as it has evaluators,
    and paired there; no row meets another one. All later steps work on counts per pair and score. Kappa
    is null when chance alone would give full agreement.
    """
    rated = ratings.where(F.col(score).isNotNull() & F.col("evaluator_id").isNotNull())
    if panel is not None:
        rated = rated.where(F.col("evaluator_id").isin(*panel))
    kind = ratings.schema[score].dataType
    placed = rated.select("explanation_id", "evaluator_id", score).repartition("explanation_id")
    once = placed.groupBy("explanation_id", "evaluator_id").agg(F.round(F.avg(score)).cast(kind).alias("x"))
    gathered = once.groupBy("explanation_id").agg(F.sort_array(F.collect_list(F.struct("evaluator_id", "x"))).alias("own"))
    later = F.flatten(
        F.transform(
            "own",
            lambda r, i: F.transform(
                F.slice("own", i + 2, F.size("own")),
                lambda o: F.struct(
                    r["evaluator_id"].alias("rater_a"), o["evaluator_id"].alias("rater_b"), r["x"].alias("a"), o["x"].alias("b")
                ),
            ),
        )
    )
    pair = ["rater_a", "rater_b"]
    # At most pairs of evaluators times pairs of scores, and read three times below.
    cells = stage(
        gathered.select(F.explode(later).alias("pair"))
        .select("pair.*")
        .groupBy(*pair, "a", "b")
        .agg(F.count(F.lit(1)).alias("n")),
        "rating-cells",
    )
    totals = cells.groupBy(*pair).agg(
        F.sum("n").alias("items"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"),
    )
    rows = cells.groupBy(*pair, F.col("a").alias("score")).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(*pair, F.col("b").alias("score")).agg(F.sum("n").alias("col_n"))
    chance = (
        rows.join(columns, [*pair, "score"])
        .groupBy(*pair)
        .agg(F.sum(F.col("row_n") * F.col("col_n")).alias("by_chance"))
    )
    observed = F.col("agreed") / F.col("items")
    expected = F.coalesce("by_chance", F.lit(0)) / (F.col("items") * F.col("items"))
    return totals.join(chance, pair, "left").select(
        *pair,
        "items",
        _share(observed - expected, 1.0 - expected).alias("kappa"),
    )


def krippendorff_alpha(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """Krippendorff's alpha for interval scores, any number of raters and missing ratings; one row.

    A rater's repeated ratings of an item count as one, their mean. Disagreement within items and overall
    follows from sums of scores and their squares, so nothing is paired: ratings are shuffled once, by item, items are
    combined where they lie and one row reaches the end. Null without two ratings of some item or without any spread.
    """
    own = (
        ratings.where(F.col(score).isNotNull())
        .select(item, rater, score)
        .repartition(item)
        .groupBy(item, rater)
        .agg(F.avg(score).alias("x"))
    )
    units = own.groupBy(item).agg(
        F.count(F.lit(1)).alias("m"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    ).where("m > 1")
    within = 2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)
    totals = units.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("m").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(within).alias("within"),
    )
    overall = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)
    return totals.select("items", (1.0 - F.try_divide(F.col("within"), overall)).alias("alpha"))


def rubric_means(ratings: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean rubric scores of both systems under comparison."""
    return ratings.groupBy("is_rag_system").agg(
        F.count(F.lit(1)).alias("assessments"), *[F.avg(name).alias(name) for name in scores]
    )


def precision_at_k(ranked: DataFrame, relevant: Column, query: str, k: int) -> DataFrame:
    """Share of relevant results among the first k of each query."""
    return (
        ranked.where(F.col("rank") <= k)
        .groupBy(query)
        .agg(_share(F.count_if(relevant), F.lit(k)).alias("precision_at_k"))
    )


def mean_reciprocal_rank(ranked: DataFrame, relevant: Column, query: str) -> DataFrame:
    """Mean over queries of 1 / rank of the first relevant result (0 without one)."""
    firsts = ranked.groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    return firsts.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )
