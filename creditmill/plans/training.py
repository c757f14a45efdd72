"""Train models on stored features, describe them in the model table and score all applicants into predictions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.learning import bayes, logistic, scoring, trees
from creditmill.learning.design import INPUTS, Scale, fit_scale, label, labelled
from creditmill.operators import evaluation, policy, splits
from creditmill.session import staged
from creditmill.sources.store import LoanStore
from creditmill.sources.tables import APPLICANTS, FEATURES, MODELS, PREDICTIONS

#: Inputs named with a prediction.
TOP_INPUTS = 3


@dataclass(frozen=True)
class Trained:
    """What a model needs to score: a probability and, for linear models, attributions, over rows of inputs and bins."""

    probability: Column
    attributions: Column | None
    hyperparameters: Mapping[str, object]


def _bayes(rows: DataFrame, scale: Scale) -> Trained:
    return Trained(bayes.fit(rows, scale).probability(), None, {"smoothing": bayes.SMOOTHING})


def _tree(rows: DataFrame, scale: Scale) -> Trained:
    return Trained(trees.value(trees.fit_tree(rows, scale)), None, {"depth": trees.DEPTH, "bins": trees.BINS})


def _forest(rows: DataFrame, scale: Scale) -> Trained:
    nodes = trees.fit_forest(rows, scale, "id")
    return Trained(trees.forest_probability(nodes), None, {"depth": trees.DEPTH, "trees": trees.TREES, "inputs_per_node": trees.INPUTS_PER_NODE})


def _boosted(rows: DataFrame, scale: Scale) -> Trained:
    return Trained(trees.fit_boosted(rows, scale).probability(), None, {"rounds": trees.ROUNDS, "rate": trees.RATE, "ridge": trees.RIDGE})


def _logistic(rows: DataFrame, scale: Scale) -> Trained:
    model = logistic.fit(rows, scale)
    return Trained(model.probability(), model.attributions(), {"steps": logistic.STEPS, "ridge": logistic.RIDGE})


ALGORITHMS: dict[str, Callable[[DataFrame, Scale], Trained]] = {
    "logistic_regression": _logistic,
    "decision_tree": _tree,
    "random_forest": _forest,
    "gradient_boosting": _boosted,
    "naive_bayes": _bayes,
}


def training_rows(store: LoanStore) -> DataFrame:
    """Stored applicants with their features: id, inputs, label and gender."""
    applicants = store.current(APPLICANTS.name)
    derived = store.current(FEATURES.name)
    own = [n for n in INPUTS if n in APPLICANTS.columns]
    other = [n for n in INPUTS if n not in APPLICANTS.columns]
    met = applicants.select("id", "person_gender", "loan_status", *own).join(derived.select(F.col("applicant_id").alias("id"), *other), "id")
    return met


def _with_bins(rows: DataFrame, scale: Scale) -> DataFrame:
    return rows.withColumn("bins", F.array(*[trees.bin_of(F.col(name)) for name in scale.inputs]))


def out_of_fold(rows: DataFrame, scale: Scale, algorithm: str, folds: int = splits.FOLDS) -> DataFrame:
    """``rows`` with the probability of a model that never saw the row's fold.

    Naive Bayes takes one pass for all folds and a tree one pass a level; the other models are fitted once per fold.
    """
    if algorithm == "naive_bayes":
        return bayes.out_of_fold(rows, bayes.fit_without_each_fold(rows, scale))
    if algorithm == "decision_tree":
        models = [trees.value(nodes) for nodes in trees.fit_without_each_fold(rows, scale, folds)]
    else:
        models = [ALGORITHMS[algorithm](rows.where(F.col("fold") != number), scale).probability for number in range(folds)]
    chosen = F.lit(None).cast("double")
    for number, probability in enumerate(models):
        chosen = F.when(F.col("fold") == number, probability).otherwise(chosen)
    return rows.withColumn("probability", chosen)


def model_row(scored: DataFrame, algorithm: str, hyperparameters: Mapping[str, object], run_ts: datetime) -> tuple:
    """Means of the fold scores and the fairness of the out-of-fold decisions, as a row of the model table."""
    means = bayes.fold_scores(scored).agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1_weighted", "auc")]).first()
    groups = evaluation.fairness_by_group(scored, "person_gender", F.col("y"), F.col("probability") >= scoring.LEAST_CONFIDENCE)
    found = [r.asDict() for r in groups.collect()]
    parity = {r["person_gender"]: r["selection_rate"] for r in found if r["selection_rate"] is not None}
    odds = {
        f"{r['person_gender']}_{rate}": r[rate] for r in found for rate in ("true_positive_rate", "false_positive_rate") if r[rate] is not None
    }
    return (algorithm, True, json.dumps(hyperparameters, sort_keys=True), *means, odds, parity, run_ts)


def train_and_score(
    store: LoanStore, algorithms: tuple[str, ...] = tuple(ALGORITHMS), batch_id: str | None = None, run_ts: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """(models, predictions) as stored: a row per algorithm with cross-validated scores, and every applicant by every model.

    The model of the highest cross-validated AUC is the champion, of equal ones the first by name. Inputs are standardised once, into
    a scratch table that the passes of the fits read, and so are the out-of-fold probabilities of a model; no rows are collected and the driver holds coefficients, splits and the bounded sums they come from.
    """
    run_ts = run_ts or datetime.now(timezone.utc)
    batch_id = batch_id or f"trained-{run_ts:%Y%m%dT%H%M%S%f}"
    spark = store.spark
    with ExitStack() as kept:
        stored = kept.enter_context(staged(training_rows(store), "training"))
        scale = fit_scale(labelled(stored))
        inputs = scale.standardised(stored.withColumns({"y": label(), "fold": splits.fold(F.col("id"))}), "id", "y", "person_gender", "fold")
        every = _with_bins(kept.enter_context(staged(inputs, "training-inputs")), scale)
        rows = every.where("y is not null")
        made, models = [], {}
        for algorithm in algorithms:
            model = ALGORITHMS[algorithm](rows, scale)
            models[algorithm] = model
            unseen = out_of_fold(rows, scale, algorithm).select("fold", "y", "person_gender", "probability")
            with staged(unseen, "out-of-fold") as scored:
                made.append(model_row(scored, algorithm, model.hyperparameters, run_ts))
        best = min(made, key=lambda r: (-(r[7] if r[7] is not None else -1.0), r[0]))[0]
        described = spark.createDataFrame(
            [(*r, r[0] == best) for r in made],
            "algorithm string, is_from_scratch boolean, hyperparameters string, cv_accuracy double, cv_precision double, cv_recall double, "
            "cv_f1_weighted double, cv_auc_roc double, equalized_odds map<string,double>, demographic_parity map<string,double>, "
            "trained_at timestamp, is_champion boolean",
        )
        stored_models = store.append(MODELS.name, described, f"{batch_id}-models", run_ts)
        ids = {r["algorithm"]: r["id"] for r in stored_models.select("algorithm", "id").collect()}
        scored = scoring.score_all(every, {ids[a]: m.probability for a, m in models.items()}, "id").withColumnRenamed("id", "applicant_id")
        linear = [(ids[a], m.attributions) for a, m in models.items() if m.attributions is not None]
        for model_id, attributions in linear:
            told = every.select(F.col("id").alias("applicant_id"), F.lit(model_id).alias("model_id"), attributions.alias("shap_values"))
            scored = scored.join(told, ["applicant_id", "model_id"], "left").withColumn(
                "top_shap_features", policy.top_attributions(F.col("shap_values"), TOP_INPUTS)
            )
        return stored_models, store.append(PREDICTIONS.name, scored, f"{batch_id}-predictions", run_ts)
