"""Queries of the fitted models and of near-duplicate chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.catalog.samples import Samples
from creditmill.learning import bayes, logistic, scoring, trees
from creditmill.learning.design import Scale, fit_scale, labelled
from creditmill.operators import policy, search, similar_chunks, splits
from creditmill.plans.training import train_and_score

FOREST = 3


def _rows(s: Samples) -> tuple[DataFrame, Scale]:
    """Standardised rows (row_no, y, inputs) of all applications with a label, and their scale."""
    rows = labelled(s.features())
    scale = fit_scale(rows)
    return scale.standardised(rows, "row_no", "y"), scale


def train_naive_bayes(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    return bayes.fit(rows, scale).table(s.spark)


def cross_validated_bayes(s: Samples) -> DataFrame:
    """Scores of five folds, each by the model of the other four."""
    rows, scale = _rows(s)
    rows = rows.withColumn("fold", splits.fold(F.col("row_no")))
    models = bayes.fit_without_each_fold(rows, scale)
    return bayes.fold_scores(bayes.out_of_fold(rows, models))


def train_decision_tree(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    return trees.nodes_table(s.spark, trees.fit_tree(rows, scale), scale.inputs)


def train_random_forest(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    return trees.nodes_table(s.spark, trees.fit_forest(rows, scale, "row_no", FOREST, 2), scale.inputs)


def train_gradient_boosting(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    return trees.nodes_table(s.spark, trees.fit_boosted(rows, scale, depth=2).nodes, scale.inputs)


def boosting_losses(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    losses = trees.fit_boosted(rows, scale, depth=2).losses
    return s.spark.createDataFrame(list(enumerate(losses)), "round int, log_loss double")


def train_logistic_regression(s: Samples) -> DataFrame:
    rows, scale = _rows(s)
    return logistic.fit(rows, scale).table(s.spark)


def batch_scores(s: Samples) -> DataFrame:
    """Every application by naive Bayes and by a decision tree."""
    rows, scale = _rows(s)
    nodes = trees.fit_tree(rows, scale)
    every = scale.standardised(s.features(), "row_no")
    every = every.withColumn("bins", F.array(*[trees.bin_of(F.col(name)) for name in scale.inputs]))
    models = {"naive_bayes": bayes.fit(rows, scale).probability(), "decision_tree": trees.value(nodes)}
    return scoring.score_all(every, models, "row_no")


def stored_predictions(s: Samples) -> DataFrame:
    """All stored applicants scored by two models that were trained on them, as stored."""
    models, predictions = train_and_score(s.loaded_store(), ("naive_bayes", "decision_tree"))
    named = models.select(F.col("id").alias("model_id"), "algorithm")
    return predictions.join(F.broadcast(named), "model_id").select(
        "applicant_id", "algorithm", "approval_probability", "predicted_outcome", "risk_tier"
    )


def stored_model_scores(s: Samples) -> DataFrame:
    """The row of the model table that a training run leaves."""
    models, _ = train_and_score(s.loaded_store(), ("naive_bayes",))
    return models.select(
        "algorithm", "is_from_scratch", "is_champion", "cv_accuracy", "cv_precision", "cv_recall", "cv_f1_weighted", "cv_auc_roc"
    )


def linear_attributions(s: Samples) -> DataFrame:
    """The log odds of every application by a linear model, and the three inputs that move it most."""
    rows, scale = _rows(s)
    intercept, coefficients = bayes.fit(rows, scale).linear()
    model = logistic.Linear(scale.inputs, intercept, coefficients)
    own = scale.standardised(s.features(), "row_no").withColumn("shap_values", model.attributions())
    total = F.aggregate(F.map_values("shap_values"), F.lit(intercept), lambda a, x: a + x)
    return own.select(
        "row_no",
        total.alias("log_odds"),
        F.array_join(policy.top_attributions(F.col("shap_values"), 3), ",").alias("top_shap_features"),
    )


def _near(s: Samples) -> tuple[DataFrame, DataFrame]:
    return similar_chunks.near_duplicates(s.documents(), "id", "chunk_text")


def near_duplicate_chunks(s: Samples) -> DataFrame:
    return _near(s)[0]


def duplicate_chunk_classes(s: Samples) -> DataFrame:
    return similar_chunks.classes(similar_chunks.shingle_sets(s.documents(), "id", "chunk_text"))


def chunk_content_hashes(s: Samples) -> DataFrame:
    return s.documents().select("id", similar_chunks.content_hash(F.col("chunk_text")).alias("content_sha256"))


def vector_topk_set(s: Samples) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 50."""
    return search.vector_top_k(s.table("embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0).best


def tfidf_topk_set(s: Samples) -> DataFrame:
    """The most similar chunks of every chunk of a document whose id is divisible by 50."""
    asks = F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint") % 50 == 0
    return search.tfidf_top_k(s.documents(), "id", "chunk_text", asks).best


QUERIES = {
    "train_naive_bayes": train_naive_bayes,
    "cross_validated_bayes": cross_validated_bayes,
    "train_decision_tree": train_decision_tree,
    "train_random_forest": train_random_forest,
    "train_gradient_boosting": train_gradient_boosting,
    "boosting_losses": boosting_losses,
    "train_logistic_regression": train_logistic_regression,
    "batch_scores": batch_scores,
    "stored_predictions": stored_predictions,
    "stored_model_scores": stored_model_scores,
    "linear_attributions": linear_attributions,
    "near_duplicate_chunks": near_duplicate_chunks,
    "duplicate_chunk_classes": duplicate_chunk_classes,
    "chunk_content_hashes": chunk_content_hashes,
    "vector_topk_set": vector_topk_set,
    "tfidf_topk_set": tfidf_topk_set,
}
