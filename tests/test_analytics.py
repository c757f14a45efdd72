"""Retrieval and evaluation against brute force on small fixtures."""

import math
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditmill.operators import evaluation, policy, retrieval

TEXTS = {
    "a": "the loan policy asks for income and for a credit history",
    "b": "the bank refused the loan",
    "c": "credit credit credit",
    "d": "nothing in common, élan!",
    "e": "12345",
}


def brute_vectors():
    counts = {k: Counter(re.findall(r"[^\W\d_]+", t.lower())) for k, t in TEXTS.items()}
    df = Counter(term for c in counts.values() for term in c)
    vectors = {}
    for key, c in counts.items():
        w = {t: n * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if w:
            vectors[key] = {t: x / norm for t, x in w.items()}
    return vectors


@pytest.mark.parametrize("salts", [1, 3, 16])
def test_tfidf(spark, monkeypatch, salts):
    monkeypatch.setattr(retrieval, "TERM_PART", salts)
    chunks = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    vectors = retrieval.tfidf_vectors(chunks, "id", "text")
    found = {r["id"]: r["tfidf_vector"] for r in vectors.collect()}
    expected = brute_vectors()
    assert found.keys() == expected.keys()
    for key, vector in expected.items():
        assert found[key] == pytest.approx(vector)
    top = retrieval.tfidf_top_k(chunks, "id", "text", {"q": "Credit history credit"}, 2).orderBy("rank")
    wanted = {"credit", "history"}
    scores = {k: sum(v.get(t, 0) for t in wanted) / math.sqrt(2) for k, v in expected.items()}
    best = sorted(scores.items(), key=lambda kv: (-round(kv[1], 12), kv[0]))[:2]
    assert [(r["id"], r["score"]) for r in top.collect()] == [(k, pytest.approx(s)) for k, s in best]


def test_a_term_of_every_chunk(spark):
    rows = [(i, f"the w{chr(97 + i % 26)}") for i in range(200)]
    vectors = retrieval.tfidf_vectors(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert len(vectors) == 200 and all("the" in r["tfidf_vector"] for r in vectors)


def test_ranks_by_unrounded_scores(spark):
    rows = [(1, [1.0, 1e-4]), (2, [1.0, 0.9e-4]), (3, [1.0, 1.1e-4])]
    top = retrieval.vector_top_k(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", {"q": [1.0, 0.0]}, 3)
    assert [r["id"] for r in top.orderBy("rank").collect()] == [2, 1, 3]


@pytest.mark.parametrize("words", [1, 64, 65, 448, 449, 512, 513, 576, 577, 2000])
def test_chunks(spark, words):
    tokens = [f"t{i}" for i in range(words)]
    docs = spark.createDataFrame([(1, "  " + " \n".join(tokens) + " "), (2, " \n"), (3, "")], "doc int, text string")
    rows = retrieval.chunk_texts(docs, "text").orderBy("chunk_index").collect()
    starts = list(range(0, max(words - 64, 1), 448))
    assert [r["chunk_text"] for r in rows] == [" ".join(tokens[s : s + 512]) for s in starts]
    assert [r["token_count"] for r in rows] == [len(tokens[s : s + 512]) for s in starts]
    assert rows[-1]["chunk_text"].endswith(tokens[-1])


def test_top_k_is_cut_before_the_shuffle(spark):
    vectors = spark.range(100).select("id", F.array(F.col("id").cast("float"), F.lit(1.0)).alias("v"))
    top = retrieval.vector_top_k(vectors, "id", "v", {"q": [0.0, 1.0]}, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_vector_top_k(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    top = retrieval.vector_top_k(vectors, "id", "v", {"q": [0.0, 1.0]}, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in top] == [(3, 1.0), (2, pytest.approx(0.5**0.5))]


def test_retrieval_quality(spark):
    ranked = spark.createDataFrame(
        [("q1", 1, False), ("q1", 2, True), ("q2", 1, True), ("q2", 2, True), ("q3", 1, False)],
        "q string, rank int, hit boolean",
    )
    p = {r["q"]: r["precision_at_k"] for r in evaluation.precision_at_k(ranked, F.col("hit"), "q", 2).collect()}
    assert p == {"q1": 0.5, "q2": 1.0, "q3": 0.0}
    assert evaluation.mean_reciprocal_rank(ranked, F.col("hit"), "q").first()["mrr"] == pytest.approx(0.5)


def brute_kappa(pairs):
    n = len(pairs)
    observed = sum(a == b for a, b in pairs) / n
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    expected = sum(left[k] * right[k] for k in left) / n**2
    return None if expected == 1 else (observed - expected) / (1 - expected)


def test_kappa(spark):
    panel = ("r1", "r2", "r3")
    scores = {(i, r): 1 + (i * (j + 1) + j * i // 3) % 4 for i in range(40) for j, r in enumerate(panel)}
    del scores[(7, "r2")]  # not everybody rated everything
    rows = [(str(i), r, s) for (i, r), s in scores.items()]
    ratings = spark.createDataFrame(rows, "explanation_id string, evaluator_id string, score int")
    for row in evaluation.rater_agreement(ratings, "score", panel).collect():
        a, b = row["rater_a"], row["rater_b"]
        pairs = [(scores[(i, a)], scores[(i, b)]) for i in range(40) if (i, a) in scores and (i, b) in scores]
        assert row["items"] == len(pairs)
        assert row["kappa"] == pytest.approx(brute_kappa(pairs))
    everyone = evaluation.rater_agreement(ratings, "score").orderBy("rater_a", "rater_b").collect()
    assert everyone == evaluation.rater_agreement(ratings, "score", panel).orderBy("rater_a", "rater_b").collect()
    # Repeated ratings count as their mean rounded half up; null raters and scores are none.
    odd = [("1", "x", 1), ("1", "x", 2), ("1", "y", 2), ("2", "x", 4), ("2", "y", 4), ("3", "x", None), ("3", "y", 1), ("1", None, 3)]
    found = evaluation.rater_agreement(spark.createDataFrame(odd, "explanation_id string, evaluator_id string, score int"), "score").collect()
    assert [(r.rater_a, r.rater_b, r["items"], r.kappa) for r in found] == [("x", "y", 2, 1.0)]
    same = ratings.withColumn("score", F.lit(3))
    assert {r["kappa"] for r in evaluation.rater_agreement(same, "score", panel).collect()} == {None}


def test_classification(spark):
    rows = [(1, 1, "0.9"), (1, 0, "0.4"), (0, 1, "0.4"), (0, 0, "0.1"), (0, 0, "0.2"), (None, 1, "0.9")]
    df = spark.createDataFrame([(y, p, Decimal(s)) for y, p, s in rows], "y int, p int, s decimal(6,4)")
    m = evaluation.classification_metrics(df, F.col("y"), F.col("p")).first()
    assert (m["rows"], m["accuracy"], m["precision"], m["recall"]) == (5, 0.6, 0.5, 0.5)
    assert m["f1_weighted"] == pytest.approx((0.5 * 2 + 2 / 3 * 3) / 5)
    positives, negatives = [0.9, 0.4], [0.4, 0.1, 0.2]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives) / 6
    assert evaluation.roc_auc(df, F.col("y"), F.col("s")).first()["auc"] == pytest.approx(wins)


def test_auc_of_fine_and_large_scores(spark):
    def auc(rows):
        return evaluation.roc_auc(spark.createDataFrame(rows, "y int, s double"), F.col("y"), F.col("s")).first()["auc"]

    assert auc([(1, 0.50004), (1, 0.50003), (0, 0.50002), (0, 0.50001)]) == 1.0
    assert auc([(1, 250.0), (0, 1e9), (0, -1e9)]) == 0.5
    assert auc([(1, 0.5)]) is None


def test_fairness(spark):
    df = spark.createDataFrame([("f", 1, 1), ("f", 0, 0), ("m", 1, 0), ("m", 0, 0), ("m", 1, 1), (None, 1, 1)], "g string, y int, p int")
    groups = evaluation.fairness_by_group(df, "g", F.col("y"), F.col("p"))
    assert {r["g"]: r["true_positive_rate"] for r in groups.collect()} == {"f": 1.0, "m": 0.5}
    gaps = evaluation.fairness_gaps(groups).first()
    assert gaps["demographic_parity"] == pytest.approx(0.5 - 1 / 3) and gaps["equalized_odds"] == 0.5


def test_policy(spark):
    df = spark.createDataFrame([(0.8,), (0.79,), (0.5,), (0.49,), (None,)], "s double")
    tiers = [r[0] for r in df.select(policy.risk_tier(F.col("s"))).collect()]
    assert tiers == ["high", "medium", "medium", "low", None]
    shap = spark.createDataFrame([({"a": 0.1, "b": -0.9, "c": 0.5, "d": 0.5},)], "m map<string,double>")
    assert shap.select(policy.top_attributions(F.col("m"), 3)).first()[0] == ["b", "c", "d"]
    missing = spark.createDataFrame([({"a": None, "b": 0.1},), ({"a": None},)], "m map<string,double>")
    assert [r[0] for r in missing.select(policy.top_attributions(F.col("m"), 3)).collect()] == [["b"], []]
