"""Fitted models against plain versions, and under other partitionings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditmill.learning import bayes, logistic, scoring, trees
from creditmill.learning.design import fit_scale, labelled
from creditmill.operators.splits import fold

NAMES = ("a", "b", "c")


def table(seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 2), r.choice([0.0, 1.0]), r.gauss(5, 1)
        y = int(r.random() < 1 / (1 + math.exp(-(1.2 * a - b + 0.3 * (c - 5)))))
        rows.append((i, a, bool(b), c, str(y)))
    rows += [(n, None, None, None, "1"), (n + 1, float("nan"), True, float("inf"), "0"), (n + 2, 1.0, False, 5.0, None), (n + 3, 1.0, False, 5.0, "7")]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "k bigint, a double, b boolean, c double, loan_status string")


@pytest.fixture(scope="module")
def train(rows):
    own = labelled(rows)
    scale = fit_scale(own, NAMES)
    return scale.standardised(own, "k", "y"), scale


def matrix(train):
    found = sorted(train[0].collect(), key=lambda r: r.k)
    return [r.k for r in found], np.array([[r[n] for n in NAMES] for r in found]), np.array([r.y for r in found])


def test_missing_inputs_count_as_the_mean(train):
    keys, x, y = matrix(train)
    assert keys[-2:] == [400, 401] and len(keys) == 402
    assert (x[-2] == 0).all() and x[-1][0] == 0 and x[-1][2] == 0
    assert abs(x[:400, 0].mean()) < 0.01


def plain_newton(x, y):
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = logistic.RIDGE * len(x) * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (y - p) - penalty @ beta)
    return beta


def test_logistic_regression_equals_a_plain_fit_under_any_partitioning(train):
    own, scale = train
    _, x, y = matrix(train)
    wanted = plain_newton(x, y)
    for parts in (own.repartition(1), own.repartition(7)):
        found = logistic.fit(parts, scale)
        assert np.abs(np.array([found.intercept, *found.coefficients]) - wanted).max() < 1e-6


def test_dependent_inputs_are_solved(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2, i % 2) for i in range(60)], "k int, a double, b double, y int")
    scale = fit_scale(rows, ("a", "b"))
    found = logistic.fit(scale.standardised(rows, "y"), scale)
    assert all(math.isfinite(c) for c in found.coefficients) and abs(found.coefficients[0] - found.coefficients[1]) < 1e-6


def test_attributions_add_up_to_the_log_odds(train):
    own, scale = train
    model = logistic.fit(own, scale)
    gap = F.aggregate(F.map_values(model.attributions()), F.lit(model.intercept), lambda a, x: a + x) - model.log_odds()
    assert own.select(F.max(F.abs(gap))).first()[0] < 1e-12


def test_folds_equal_separate_fits(train):
    own, scale = train
    folded = own.withColumn("fold", fold(F.col("k")))
    models = bayes.fit_without_each_fold(folded, scale)
    assert sorted(models) == [0, 1, 2, 3, 4]
    for number, model in models.items():
        alone = bayes.fit(folded.where(F.col("fold") != number), scale)
        for c in (0, 1):
            assert model.classes[c].n == alone.classes[c].n
            assert np.allclose(model.classes[c].means, alone.classes[c].means, atol=1e-12)
            assert np.allclose(model.classes[c].variances, alone.classes[c].variances, atol=1e-12)
    scores = bayes.fold_scores(bayes.out_of_fold(folded, models)).collect()
    assert sum(r["rows"] for r in scores) == 402 and all(r.auc > 0.7 for r in scores)


def test_bayes_needs_both_classes(train):
    own, scale = train
    with pytest.raises(ValueError):
        bayes.fit(own.where("y = 1"), scale)


def plain_bins(x):
    return np.clip(np.floor((x + 3) / 6 * 32), 0, 31).astype(int)


def plain_tree(bins, target, weight, depth, ridge, allowed=lambda node: range(3), node=1):
    """{node: (rows, value, input, bin)} by trying every split."""
    n, w, s = len(bins), weight.sum(), (target).sum()
    out = {node: (n, s / (w + ridge), None, None)}
    best = (0.0, None, None)
    for i in allowed(node) if node < 1 << depth else ():
        for b in range(32):
            left = bins[:, i] <= b
            if left.sum() < trees.LEAST_ROWS or (~left).sum() < trees.LEAST_ROWS:
                continue
            gain = round(target[left].sum() ** 2 / (weight[left].sum() + ridge) + target[~left].sum() ** 2 / (weight[~left].sum() + ridge) - s * s / (w + ridge), 9)
            if gain > best[0]:
                best = (gain, i, b)
    if best[1] is not None:
        left = bins[:, best[1]] <= best[2]
        out[node] = (n, s / (w + ridge), best[1], best[2])
        for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
            out |= plain_tree(bins[side], target[side], weight[side], depth, ridge, allowed, child)
    return out


def same(nodes, plain):
    assert {n.node: (n.rows, n.input, n.bin) for n in nodes} == {k: (v[0], v[2], v[3]) for k, v in plain.items()}
    assert all(abs(n.value - plain[n.node][1]) < 1e-9 for n in nodes)


def test_tree_equals_trying_every_split(train):
    own, scale = train
    _, x, y = matrix(train)
    nodes = trees.fit_tree(own, scale, 3)
    same(nodes, plain_tree(plain_bins(x), y.astype(float), np.ones(len(y)), 3, 0))
    assert len(nodes) > 5
    leaf = trees.binned(own, scale, "y").select(trees.value(nodes).alias("v"), "y")
    assert abs(leaf.select(F.avg("v") - F.avg("y")).first()[0]) < 1e-9


def test_a_node_without_gain_is_a_leaf(spark):
    rows = spark.createDataFrame([(1.0, i % 2) for i in range(50)], "a double, y int")
    scale = fit_scale(rows, ("a",))
    nodes = trees.fit_tree(scale.standardised(rows, "y"), scale)
    assert [(n.node, n.input, n.rows) for n in nodes] == [(1, None, 50)]


def test_boosting_equals_plain_rounds_and_its_loss_falls(train):
    own, scale = train
    _, x, y = matrix(train)
    found = trees.fit_boosted(own, scale, 3, 2)
    bins, f, losses = plain_bins(x), np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    for number in range(3):
        losses.append(np.mean(np.log1p(np.exp(-np.abs(f))) + np.maximum(f, 0) - y * f))
        p = 1 / (1 + np.exp(-f))
        plain = plain_tree(bins, y - p, p * (1 - p), 2, trees.RIDGE)
        same([n for n in found.nodes if n.tree == number], plain)

        def leaf(row, node=1):
            _, v, i, b = plain[node]
            return v if i is None else leaf(row, 2 * node + (row[i] > b))

        f = f + trees.RATE * np.array([leaf(r) for r in bins])
    losses.append(np.mean(np.log1p(np.exp(-np.abs(f))) + np.maximum(f, 0) - y * f))
    assert np.allclose(found.losses, losses, atol=1e-9) and list(found.losses) == sorted(found.losses, reverse=True)


def test_forest_is_the_same_under_any_partitioning(train):
    own, scale = train
    one = trees.fit_forest(own.repartition(1), scale, "k", 4, 2, 2)
    many = trees.fit_forest(own.repartition(9), scale, "k", 4, 2, 2)
    assert one == many and {n.tree for n in one} == {0, 1, 2, 3}
    assert len({tuple((n.node, n.input, n.bin) for n in one if n.tree == t) for t in range(4)}) > 1
    counts = own.select(trees.draws(F.col("k"), 0).alias("d"))
    assert 0.85 < counts.agg(F.avg("d")).first()[0] < 1.15
    p = trees.binned(own, scale).select(trees.forest_probability(one).alias("p"))
    assert p.where("p < 0 or p > 1").isEmpty()


def test_scores_of_all_models(rows, train):
    own, scale = train
    every = scale.standardised(rows, "k")
    found = scoring.score_all(every, {"lr": logistic.fit(own, scale).probability(), "nb": bayes.fit(own, scale).probability()}, "k")
    assert found.count() == 2 * rows.count()
    odd = found.where("(predicted_outcome = 'approved') <> (approval_probability >= 0.5) or risk_tier is null")
    assert odd.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_trained_models_and_their_predictions_are_stored(spark, raw, tmp_path):
    from creditmill.operators.lookup import get_champion_model
    from creditmill.plans.feature_table import build_feature_table
    from creditmill.plans.load import load_features
    from creditmill.plans.training import train_and_score
    from creditmill.sources.store import LoanStore

    r = random.Random(4)
    changes = []
    for i in range(150):
        income = r.randrange(20_000, 120_000)
        good = r.random() < (0.9 if income > 60_000 else 0.2)
        changes.append({"person_income": str(income), "person_gender": r.choice(["male", "female"]), "loan_status": str(int(good)), "loan_amnt": str(5000 + i)})
    store = LoanStore(spark, str(tmp_path / "store"))
    load_features(build_feature_table(raw(*changes), extra=("row_no",)), store, batch_id="loans")
    models, predictions = train_and_score(store, ("logistic_regression", "naive_bayes", "decision_tree"))
    rows = models.collect()
    assert {m.algorithm for m in rows} == {"logistic_regression", "naive_bayes", "decision_tree"}
    assert all(m.cv_auc_roc > 0.6 and set(m.demographic_parity) == {"male", "female"} for m in rows)
    assert get_champion_model(models).count() == sum(m.is_champion for m in rows) == 1
    linear = next(m.id for m in rows if m.algorithm == "logistic_regression")
    assert predictions.count() == 3 * store.read("loan_applicants").count()
    own = predictions.where(F.col("model_id") == linear)
    assert own.where("size(top_shap_features) <> 3 or shap_values is null").isEmpty()
    assert predictions.where(F.col("model_id") != linear).where("shap_values is not null").isEmpty()
    assert own.where("array_contains(top_shap_features, 'person_income')").count() > 0.5 * own.count()
