"""Queries by inventory group; each takes the samples of a scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.catalog import samples
from creditmill.catalog.samples import COPY_OFFSET, Samples
from creditmill.config import FEATURE_COLUMNS, RAW_COLUMNS, LoadConfig
from creditmill.operators import (
    evaluation,
    features,
    joins,
    lookup,
    output_rules,
    policy,
    quality,
    retrieval,
    splits,
)
from creditmill.operators.cleaning import clean_loans, count_age_outliers
from creditmill.operators.coercion import (
    coerce_applicant,
    coerce_features,
    coerce_loans,
    explain_rejects,
)
from creditmill.operators.dedup import distinct_fingerprints, first_occurrences
from creditmill.operators.summary import summarise, summary_counts, value_counts
from creditmill.plans.feature_table import build_feature_table, run_features
from creditmill.plans.load import LoadPlan, chunk_counters, load_counters, load_features, plan_load
from creditmill.session import broadcast_up_to, scratch_path, stage, stage_in_turn, staged
from creditmill.sources import tables
from creditmill.sources.files import load_raw, number_rows, read_csv, read_features, write_features
from creditmill.sources.store import LoanStore, with_defaults
from creditmill.streaming.keyed import load_first_arrivals

SCORES = ("policy_traceability", "factual_accuracy", "completeness", "actionability")
QUESTIONS = {
    "q1": "Why was the loan refused: is it the income and the credit history?",
    "q2": "que la une des les",
    "q3": "und der die das nicht",
}
VECTORS = {
    "v1": [((i * 7) % 11 - 5) / 5.0 for i in range(64)],
    "v2": [((i * 3) % 13 - 6) / 6.0 for i in range(64)],
}


#: Narrow rows that a join broadcasts, counted first; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 1_000_000

_PREDICTION_COLUMNS = ("id", "applicant_id", "model_id", "predicted_outcome", "approval_probability")
_EXPLANATION_COLUMNS = ("id", "prediction_id", "retriever_type", "retrieval_k", "llm_response", "generation_latency_ms")
_MODEL_COLUMNS = ("id", "algorithm", "is_from_scratch", "cv_accuracy", "is_champion")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and small integers to int, for comparison across engines."""
    columns = []
    for f in df.schema:
        column = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(f.dataType, T.ShortType):
            column = column.cast("int")
        columns.append(column.alias(f.name))
    return df.select(*columns)


# --- cleaning and features -------------------------------------------------


def clean(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).select("row_no", *RAW_COLUMNS)


def age_outliers(s: Samples) -> DataFrame:
    return count_age_outliers(s.loan_raw())


def financial_ratios(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_financial_ratios).select(
        "row_no",
        "monthly_income",
        "debt_to_income_ratio",
        "loan_to_income_ratio",
        "monthly_loan_burden",
        "affordability_ratio",
        "credit_history_to_age_ratio",
    )


def age_employment(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_age_employment).select(
        "row_no", "emp_to_age_ratio", "loan_per_age", "young_inexperienced"
    )


def credit_quality(s: Samples) -> DataFrame:
    cleaned = clean_loans(s.loan_raw())
    medians = features.fit_medians(cleaned)
    return features.with_credit_quality(cleaned, medians).select(
        "row_no",
        "credit_score_tier",
        "thin_credit_file",
        "score_per_history_year",
        "credit_risk_interaction",
    )


def income_burden(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_income_burden).select(
        "row_no", "income_bucket", "high_loan_burden_flag"
    )


def employment_stability(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_employment_stability).select(
        "row_no", "employment_stability"
    )


def homeownership(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_homeownership).select(
        "row_no", "homeownership_score", "stability_income_interaction"
    )


def intent_risk(s: Samples) -> DataFrame:
    return clean_loans(s.loan_raw()).transform(features.with_intent_risk).select(
        "row_no", "intent_risk_score"
    )


def risk_score(s: Samples) -> DataFrame:
    return build_feature_table(s.loan_raw(), extra=("row_no",)).select(
        "row_no", "credit_risk_interaction", "composite_risk_score", "is_high_risk"
    )


def risk_baseline(s: Samples) -> DataFrame:
    fitted = features.fit_risk_baseline(clean_loans(s.loan_raw()))
    return s.spark.createDataFrame(
        [(fitted.median_rate, fitted.median_score, fitted.risk_threshold)],
        "median_rate double, median_score double, risk_threshold double",
    )


def feature_table(s: Samples) -> DataFrame:
    return build_feature_table(stage(s.loan_raw(), "raw-loans"), extra=("row_no",))


# --- files and stored tables ---------------------------------------------------


def _raw_csv(s: Samples) -> str:
    """The raw applications as CSV: columns in another order, one more, missing values as NA."""
    path = scratch_path(s.spark, "raw-csv")
    columns = ["row_no", *reversed(RAW_COLUMNS)]
    s.loan_raw().select(*columns).write.csv(path, header=True, nullValue="NA")
    return path


def csv_clean(s: Samples) -> DataFrame:
    return clean_loans(load_raw(s.spark, _raw_csv(s))).select(*RAW_COLUMNS)


def csv_features(s: Samples) -> DataFrame:
    """The whole job, from CSV to a written feature table."""
    return run_features(s.spark, _raw_csv(s), scratch_path(s.spark, "features"))


def csv_row_numbers(s: Samples) -> DataFrame:
    """Positions in file order of applications written in the order of their numbers."""
    path = scratch_path(s.spark, "ordered-csv")
    s.loan_raw().select(F.col("row_no").alias("loan_no"), "person_age").orderBy("loan_no").write.csv(path, header=True)
    rows = number_rows(read_csv(s.spark, path, with_order=True))
    return rows.select(F.col("loan_no").cast("bigint").alias("loan_no"), F.col("row_no").cast("bigint").alias("row_no"))


def _store(s: Samples) -> LoanStore:
    return LoanStore(s.spark, scratch_path(s.spark, "store"))


def stored_applicants(s: Samples) -> DataFrame:
    store = _store(s)
    load_features(s.loan_batch(), store, batch_id="first")
    return store.read("loan_applicants").select("id", *_columns(tables.APPLICANTS, "id", "created_at", "loan_grade"))


def stored_features(s: Samples) -> DataFrame:
    store = _store(s)
    load_features(s.loan_batch(), store, batch_id="first")
    return store.read("engineered_features").select(*_columns(tables.FEATURES, "id", "computed_at"))


def load_results(s: Samples) -> DataFrame:
    """Counters of a dry run, a load and a second load of the same rows."""
    store, batch = _store(s), s.loan_batch()
    results = [
        load_features(batch, store, LoadConfig(dry_run=True), batch_id="dry"),
        load_features(batch, store, batch_id="first"),
        load_features(batch, store, batch_id="second"),
    ]
    rows = [(r.batch_id, r.total, r.inserted, r.skipped, r.rejected) for r in results]
    return s.spark.createDataFrame(
        rows, "batch_id string, total bigint, inserted bigint, skipped bigint, rejected bigint"
    )


def stored_models(s: Samples) -> DataFrame:
    """Models appended without their champion flag, which has a default."""
    kept = s.models().where("algorithm <> 'svm'").drop("is_champion", "trained_at")
    return _store(s).create_models(kept, "models").select("id", "algorithm", "is_from_scratch", "cv_accuracy", "is_champion")


def appended_predictions(s: Samples) -> DataFrame:
    """Predictions appended after applicants and models, all constraints checked."""
    store = s.store_with_parents()
    kept = s.predictions().join(s.models().where("algorithm <> 'svm'").select(F.col("id").alias("model_id")), "model_id", "left_semi")
    kept = kept.join(s.applicant_keys().select("applicant_id"), "applicant_id", "left_semi")
    return store.create_predictions(kept, "predictions").select(*_PREDICTION_COLUMNS)


def appended_explanations(s: Samples) -> DataFrame:
    """Explanations with an answer, appended after their predictions; the retriever has a default."""
    store = s.store_with_parents()
    predictions = s.predictions().where("approval_probability < 0.1")
    counts = {tables.PREDICTIONS.name: store.write(tables.PREDICTIONS.name, with_defaults(predictions, tables.PREDICTIONS), "parents")}
    store.publish("parents", counts)
    own = predictions.select(F.col("id").alias("prediction_id"))
    kept = s.explanations().where("llm_response is not null").join(own, "prediction_id", "left_semi")
    kept = kept.withColumn("retriever_type", F.when(F.col("retriever_type") == "vector", "vector"))
    return store.create_explanations(kept, "explanations").select(*_EXPLANATION_COLUMNS)


def appended_features(s: Samples) -> DataFrame:
    """Applicants and features by their own appends instead of the load."""
    store = _store(s)
    store.create_applicants(s.applicants().select(*_columns(tables.APPLICANTS, "created_at")), "applicants")
    derived = s.applicants().withColumn("applicant_id", F.col("id")).select(*_columns(tables.FEATURES, "id", "computed_at"))
    return store.create_features(derived, "features").select(*_columns(tables.FEATURES, "id", "computed_at"))


def created_tables(s: Samples) -> DataFrame:
    """Rows of all eight tables after they were created and a batch was loaded."""
    store = _store(s)
    store.create_tables()
    load_features(s.features(), store, batch_id="first")
    found = None
    for table in tables.TABLES.values():
        rows = store.read(table.name).agg(F.lit(table.name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        found = rows if found is None else found.unionByName(rows)
    return found


def processed_scan(s: Samples) -> DataFrame:
    """A feature table written and read again with the position of every row."""
    path = scratch_path(s.spark, "features")
    write_features(s.features().select("row_no", *FEATURE_COLUMNS).orderBy("row_no"), path)
    rows = number_rows(read_features(s.spark, path, with_order=True).withColumnRenamed("row_no", "loan_no"))
    return rows.select("loan_no", F.col("row_no").cast("bigint").alias("row_no"), "person_income", "credit_score_tier")


def stream_load(s: Samples) -> DataFrame:
    """Applicants after three arrivals, loaded by a stream that stops after each and starts again from its checkpoint."""
    root = scratch_path(s.spark, "stream")
    store = LoanStore(s.spark, f"{root}/store")
    batch = s.loan_batch()
    third = F.col("row_no") >= COPY_OFFSET
    for rows in (batch.where(~third & (F.col("row_no") % 2 == 0)), batch.where(~third & (F.col("row_no") % 2 == 1)), batch.where(third)):
        rows.write.mode("append").parquet(f"{root}/landing")
        load_first_arrivals(s.spark, f"{root}/landing", store, f"{root}/checkpoint").awaitTermination()
    return store.read("loan_applicants").select("id", *_columns(tables.APPLICANTS, "id", "created_at", "loan_grade"))


# --- summaries ---------------------------------------------------------------


def feature_summary(s: Samples) -> DataFrame:
    return summarise(s.features().select(*FEATURE_COLUMNS))


def counts_income_bucket(s: Samples) -> DataFrame:
    return value_counts(s.features(), "income_bucket")


def counts_credit_tier(s: Samples) -> DataFrame:
    return value_counts(s.features(), "credit_score_tier")


def counts_employment(s: Samples) -> DataFrame:
    return value_counts(s.features(), "employment_stability")


def counts_long(s: Samples) -> DataFrame:
    return summary_counts(s.features())


# --- coercion and load -------------------------------------------------------


def _columns(table: tables.Table, *without: str) -> list[str]:
    return [name for name in table.columns if name not in without]


def applicant_types(s: Samples) -> DataFrame:
    typed = coerce_applicant(s.features())
    return typed.select("row_no", *_columns(tables.APPLICANTS, "id", "created_at"))


def feature_types(s: Samples) -> DataFrame:
    typed = coerce_features(s.features())
    return typed.select("row_no", *_columns(tables.FEATURES, "id", "applicant_id", "computed_at"))


def load_fingerprints(s: Samples) -> DataFrame:
    return distinct_fingerprints(s.loan_existing())


def load_dedup(s: Samples) -> DataFrame:
    typed = coerce_loans(s.loan_batch()).where("storable")
    keys = list(tables.APPLICANTS.natural_key)
    return first_occurrences(typed.select("row_no", *keys))


def _load_plan(s: Samples) -> LoadPlan:
    return plan_load(coerce_loans(s.loan_batch()), s.loan_existing())


def load_new_rows(s: Samples) -> DataFrame:
    rows = _load_plan(s).new_rows
    applicant = _columns(tables.APPLICANTS, "id", "created_at", "loan_grade")
    derived = _columns(tables.FEATURES, "id", "computed_at")
    return rows.select("row_no", *applicant, *derived)


def load_totals(s: Samples) -> DataFrame:
    return load_counters(_load_plan(s), s.loan_existing())


def load_chunks(s: Samples) -> DataFrame:
    return chunk_counters(_load_plan(s), 500)


def load_rejects(s: Samples) -> DataFrame:
    rejects = _load_plan(s).rejects
    return rejects.select("row_no", F.explode("violations").alias("rule"))


# --- data quality --------------------------------------------------------------


def dq_not_null(s: Samples) -> DataFrame:
    return quality.missing_values(coerce_applicant(s.loan_batch()), tables.APPLICANTS)


def dq_rules(s: Samples) -> DataFrame:
    rejects = explain_rejects(coerce_loans(s.loan_batch()).where(~F.col("storable")))
    return quality.rule_counts(rejects)


def dq_table_rules(s: Samples) -> DataFrame:
    """Rows per broken row rule of all eight tables, with violations put in; one pass per table."""
    late = F.when(F.col("model_id") == "model-7", "maybe").otherwise(F.col("predicted_outcome"))
    tier = F.when(F.col("model_id") == "model-8", F.repeat(F.lit("x"), F.lit(21)))
    typed = coerce_loans(s.loan_batch())
    grade = F.when(F.col("credit_score") < 400, "Z")
    long_name = F.when(F.col("chunk_index") % 3 == 2, F.repeat(F.col("source_name"), F.lit(201))).otherwise(F.col("source_name"))
    # As in the sample of long evaluators.
    long_evaluator = F.when(F.col("completeness") == 5, F.repeat("evaluator_id", F.lit(6))).otherwise(F.col("evaluator_id"))
    frames = {
        tables.APPLICANTS: typed.withColumn("loan_grade", grade),
        tables.FEATURES: typed.withColumn("credit_score_tier", F.when(F.col("credit_score") > 800, "Superb").otherwise(F.col("credit_score_tier"))),
        tables.MODELS: s.models(),
        tables.PREDICTIONS: s.predictions().withColumns({"predicted_outcome": late, "risk_tier": tier}),
        tables.DOCUMENTS: s.documents().withColumn("source_name", long_name),
        tables.EXPLANATIONS: s.explanations(),
        tables.EXPLANATION_CHUNKS: s.explanation_chunks().withColumn("rank", F.when(F.col("rank") < 5, F.col("rank"))),
        tables.ASSESSMENTS: s.assessments().where("id is not null").withColumn("evaluator_id", long_evaluator),
    }
    found = None
    for table, rows in frames.items():
        broken = quality.row_violations(table, skip=set(table.columns) - set(rows.columns))
        counts = quality.rule_counts(rows.select(broken.alias("violations")))
        counts = counts.select(F.lit(table.name).alias("table_name"), "rule", "row_count")
        found = counts if found is None else found.unionByName(counts)
    return found


def dq_primary_key(s: Samples) -> DataFrame:
    return quality.duplicate_keys(s.repeated_predictions(), ["id"])


def dq_unique(s: Samples) -> DataFrame:
    return quality.duplicate_keys(s.repeated_predictions(), ["applicant_id", "model_id"])


def dq_unique_assessment(s: Samples) -> DataFrame:
    return quality.duplicate_keys(s.repeated_assessments(), ["explanation_id", "evaluator_id"])


def dq_orphan_applicants(s: Samples) -> DataFrame:
    return quality.orphans(s.predictions(), "applicant_id", s.applicants())


def dq_orphan_models(s: Samples) -> DataFrame:
    return quality.orphans(s.predictions(), "model_id", s.models().where("not is_champion"))


def dq_orphan_predictions(s: Samples) -> DataFrame:
    return quality.orphans(
        s.explanations(), "prediction_id", s.predictions().where("approval_probability >= 0.1")
    )


def _answered(s: Samples) -> DataFrame:
    return s.explanations().where("llm_response is not null")


def dq_orphan_explanations(s: Samples) -> DataFrame:
    return quality.orphans(s.explanation_chunks(), "explanation_id", _answered(s))


def dq_orphan_documents(s: Samples) -> DataFrame:
    return quality.orphans(s.explanation_chunks(), "document_id", s.documents())


def dq_orphan_assessments(s: Samples) -> DataFrame:
    return quality.orphans(s.assessments(), "explanation_id", _answered(s))


def dq_orphan_features(s: Samples) -> DataFrame:
    """Features of every tenth application whose applicant was not stored."""
    derived = s.applicants().select(F.col("id").alias("applicant_id"))
    return quality.orphans(derived, "applicant_id", s.stored_applicants())


def dq_enum_domain(s: Samples) -> DataFrame:
    domain = tables.MODELS.field("algorithm").domain
    return quality.outside_domain(s.models(), "algorithm", domain)


def dq_decimal_range(s: Samples) -> DataFrame:
    wide = s.features().withColumn("loan_percent_income", F.col("loan_percent_income") * 16.0)
    return quality.does_not_fit(wide, "loan_percent_income", "decimal(5,4)").select(
        "row_no", "loan_percent_income"
    )


def dq_string_length(s: Samples) -> DataFrame:
    limit = tables.ASSESSMENTS.field("evaluator_id").max_length
    return quality.too_long(s.long_evaluators(), "evaluator_id", limit).select("id")


def dq_likert(s: Samples) -> DataFrame:
    return quality.off_scale(s.assessments(), SCORES).select("id", *SCORES)


def dq_champion(s: Samples) -> DataFrame:
    return quality.champion_count(s.models())


# --- lookups -------------------------------------------------------------------


def _first_key(table: DataFrame, column: str = "id") -> str:
    return table.agg(F.min(column)).first()[0]


def _applicant_table(s: Samples) -> DataFrame:
    return s.applicants().select(*_columns(tables.APPLICANTS, "created_at", "loan_grade"))


def _feature_table(s: Samples) -> DataFrame:
    rows = s.applicants().withColumn("applicant_id", F.col("id"))
    return rows.select(*_columns(tables.FEATURES, "id", "computed_at"))


def _model_table(s: Samples) -> DataFrame:
    return s.models().drop("trained_at")


def _stored(s: Samples, table: tables.Table, *columns: str) -> DataFrame:
    """Some columns of a stored table, as a scan without a join."""
    return s.store(table).current(table.name).select(*columns)


def lookup_applicant(s: Samples) -> DataFrame:
    table = _stored(s, tables.APPLICANTS, *_columns(tables.APPLICANTS, "created_at", "loan_grade"))
    return lookup.get_by_id(table, _first_key(table))


def lookup_features(s: Samples) -> DataFrame:
    table = _stored(s, tables.FEATURES, *_columns(tables.FEATURES, "id", "computed_at"))
    return lookup.get_features(table, _first_key(table, "applicant_id"))


def lookup_model(s: Samples) -> DataFrame:
    return lookup.get_by_id(_stored(s, tables.MODELS, *_MODEL_COLUMNS), "model-7")


def lookup_prediction(s: Samples) -> DataFrame:
    table = _stored(s, tables.PREDICTIONS, *_PREDICTION_COLUMNS)
    return lookup.get_by_id(table, _first_key(table))


def lookup_explanation(s: Samples) -> DataFrame:
    table = _stored(s, tables.EXPLANATIONS, *_EXPLANATION_COLUMNS)
    return lookup.get_explanation(table, _first_key(table, "prediction_id"))


def applicant_predictions(s: Samples) -> DataFrame:
    table = _stored(s, tables.PREDICTIONS, *_PREDICTION_COLUMNS)
    return lookup.get_applicant_predictions(table, _first_key(table, "applicant_id"))


def approved_applicant_predictions(s: Samples) -> DataFrame:
    approved = _stored(s, tables.APPLICANTS, "id", "loan_status").where("loan_status = 1")
    return lookup.matching(_stored(s, tables.PREDICTIONS, *_PREDICTION_COLUMNS), "applicant_id", approved, "id")


def champion_model(s: Samples) -> DataFrame:
    return lookup.get_champion_model(_stored(s, tables.MODELS, *_MODEL_COLUMNS, "trained_at")).drop("trained_at")


def list_applicants(s: Samples) -> DataFrame:
    return lookup.list_rows(_stored(s, tables.APPLICANTS, *_columns(tables.APPLICANTS, "created_at", "loan_grade")))


def list_models(s: Samples) -> DataFrame:
    return lookup.list_rows(_stored(s, tables.MODELS, *_MODEL_COLUMNS), 10)


# --- joins ---------------------------------------------------------------------


def join_applicant_features(s: Samples) -> DataFrame:
    """All applicants; features exist for those approved."""
    derived = _feature_table(s).withColumn("id", F.concat(F.lit("f-"), "applicant_id"))
    kept = lookup.matching(
        derived, "applicant_id", s.applicants().where("loan_status = 1"), "id"
    )
    return joins.applicant_with_features(_applicant_table(s), kept)


def join_applicant_predictions(s: Samples) -> DataFrame:
    return joins.applicant_predictions(
        _applicant_table(s).select("id", "person_income", "loan_amnt", "loan_status"),
        s.predictions(),
    )


def join_model_predictions(s: Samples) -> DataFrame:
    return joins.model_predictions(_model_table(s), s.predictions())


def join_prediction_explanations(s: Samples) -> DataFrame:
    return joins.prediction_explanations(
        s.predictions().select("id", "model_id", "approval_probability"), s.explanations()
    )


def join_explanation_documents(s: Samples) -> DataFrame:
    """All links, slice by slice where there are many: they outnumber the documents and are moved for each of two joins."""
    documents = s.documents().select("id", "source_name", "chunk_index", "token_count")

    def joined(documents: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        return joins.explanation_documents(
            s.explanations(pairs).select("id", "retriever_type"), s.explanation_chunks(pairs), documents
        )

    if s.table("lineitem").count() <= samples.LINK_SLICE:
        return joined(documents)
    with staged(documents, "linked-documents") as documents, s.pair_slices(samples.LINK_SLICE) as slices:
        return stage_in_turn(lambda pairs: joined(documents, pairs), slices, "explanation-documents")


def join_explanation_assessments(s: Samples) -> DataFrame:
    return joins.explanation_assessments(
        s.explanations().select("id", "retriever_type"), s.assessments()
    )


# --- results the stored tables have columns for ------------------------------------


def document_chunks(s: Samples) -> DataFrame:
    return s.documents().select("id", "source_name", "chunk_index", "token_count", "chunk_text")


def tfidf_terms(s: Samples) -> DataFrame:
    vectors = retrieval.tfidf_vectors(s.documents(), "id", "chunk_text")
    return vectors.select("id", F.explode("tfidf_vector").alias("term", "weight"))


def tfidf_top_k(s: Samples) -> DataFrame:
    return retrieval.tfidf_top_k(s.documents(), "id", "chunk_text", QUESTIONS)


def vector_top_k(s: Samples) -> DataFrame:
    return retrieval.vector_top_k(s.table("embeddings"), "vec_id", "embedding", VECTORS)


def score_maps(s: Samples) -> DataFrame:
    maps = retrieval.retrieval_scores(s.explanation_chunks())
    return maps.select(
        "explanation_id", F.explode("retrieval_scores").alias("document_id", "retrieval_score")
    )


def _judged_chunks(s: Samples) -> DataFrame:
    """Retrieved chunks with the label of a document of good quality; the others are not relevant, labelled or not."""
    labels = s.table("labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("document"), "quality")
    labels = broadcast_up_to(labels, BROADCAST_ROWS)
    chunks = s.explanation_chunks().withColumn("document", F.split_part("document_id", F.lit("-"), F.lit(2)))
    return chunks.join(labels, "document", "left").drop("document")


def precision_at_k(s: Samples) -> DataFrame:
    relevant = F.coalesce(F.col("quality") == 1, F.lit(False))
    return evaluation.precision_at_k(_judged_chunks(s), relevant, "explanation_id", 5)


def reciprocal_rank(s: Samples) -> DataFrame:
    relevant = F.coalesce(F.col("quality") == 1, F.lit(False))
    return evaluation.mean_reciprocal_rank(_judged_chunks(s), relevant, "explanation_id")


def rater_agreement(s: Samples) -> DataFrame:
    return evaluation.rater_agreement(s.assessments(), "factual_accuracy")


def rubric_means(s: Samples) -> DataFrame:
    return evaluation.rubric_means(s.assessments(), SCORES)


def _scored_applicants(s: Samples) -> DataFrame:
    return joins.applicant_predictions(
        s.applicants().select("id", "person_gender", "loan_status"), s.predictions()
    )


_PREDICTED = "predicted_outcome = 'approved'"


def model_metrics(s: Samples) -> DataFrame:
    return evaluation.classification_metrics(
        _scored_applicants(s), F.col("loan_status"), F.expr(_PREDICTED)
    )


def model_auc(s: Samples) -> DataFrame:
    return evaluation.roc_auc(
        _scored_applicants(s), F.col("loan_status"), F.col("approval_probability")
    )


def fairness_groups(s: Samples) -> DataFrame:
    return evaluation.fairness_by_group(
        _scored_applicants(s), "person_gender", F.col("loan_status"), F.expr(_PREDICTED)
    )


def fairness_gaps(s: Samples) -> DataFrame:
    return evaluation.fairness_gaps(fairness_groups(s))


def decision_actions(s: Samples) -> DataFrame:
    """Risk tier and action per application, by the composite score."""
    tier = policy.risk_tier(F.col("composite_risk_score"))
    return s.features().select(
        "row_no", tier.alias("risk_tier"), policy.action(tier).alias("action")
    )


def top_attributions(s: Samples) -> DataFrame:
    """The three features of an application farthest from zero, as one text."""
    shap = F.create_map(
        F.lit("emp_to_age_ratio"), F.col("emp_to_age_ratio") * 2,
        F.lit("affordability_ratio"), -F.col("affordability_ratio"),
        F.lit("debt_to_income_ratio"), F.col("debt_to_income_ratio"),
        F.lit("composite_risk_score"), F.col("composite_risk_score"),
    )
    return s.features().select(
        "row_no", F.array_join(policy.top_attributions(shap, 3), ",").alias("top_shap_features")
    )


def splits_and_folds(s: Samples) -> DataFrame:
    return s.loan_raw().select(
        "row_no",
        splits.source_split(F.col("row_no"), validation_share=0.1).alias("source_split"),
        splits.fold(F.col("row_no")).alias("fold"),
    )


def phrase_flags(s: Samples) -> DataFrame:
    """Disallowed phrases in explanations and in all conversation turns."""
    answers = s.explanations().select("id", F.col("llm_response").alias("text"))
    turns = s.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    found = output_rules.disallowed_phrases(F.col("text"))
    return answers.unionByName(turns).select("id", F.array_join(found, ",").alias("phrases"))


def confidence_flags(s: Samples) -> DataFrame:
    return s.predictions().select("id", output_rules.low_confidence(F.col("approval_probability")).alias("low_confidence"))


def constructed_prompts(s: Samples) -> DataFrame:
    """Prompts of all explanations from their retrieved chunks, slice by slice: together they are many times the documents."""
    texts = s.documents().select(F.col("id").alias("document_id"), "chunk_text")

    def digests(pairs: DataFrame) -> DataFrame:
        chunks = s.explanation_chunks(pairs).join(texts, "document_id")
        made = output_rules.prompts(chunks, "explanation_id", "rank", "chunk_text", F.lit("Why was the loan decided so?"), 3)
        return made.select("explanation_id", F.md5(F.col("constructed_prompt").cast("binary")).alias("prompt_md5"))

    with staged(texts, "prompt-texts") as texts, s.pair_slices() as slices:
        return stage_in_turn(digests, slices, "prompts")


def alpha(s: Samples) -> DataFrame:
    return evaluation.krippendorff_alpha(s.assessments(), "explanation_id", "evaluator_id", "factual_accuracy")


QUERIES = {
    "clean_loans": clean,
    "age_outliers": age_outliers,
    "financial_ratios": financial_ratios,
    "age_employment": age_employment,
    "credit_quality": credit_quality,
    "income_burden": income_burden,
    "employment_stability": employment_stability,
    "homeownership": homeownership,
    "intent_risk": intent_risk,
    "risk_score": risk_score,
    "risk_baseline": risk_baseline,
    "feature_table": feature_table,
    "csv_clean_loans": csv_clean,
    "csv_feature_table": csv_features,
    "csv_row_numbers": csv_row_numbers,
    "store_loaded_applicants": stored_applicants,
    "store_loaded_features": stored_features,
    "store_load_results": load_results,
    "store_appended_models": stored_models,
    "store_appended_features": appended_features,
    "store_appended_predictions": appended_predictions,
    "store_appended_explanations": appended_explanations,
    "store_created_tables": created_tables,
    "processed_feature_scan": processed_scan,
    "stream_loaded_applicants": stream_load,
    "feature_summary": feature_summary,
    "value_counts_income_bucket": counts_income_bucket,
    "value_counts_credit_score_tier": counts_credit_tier,
    "value_counts_employment_stability": counts_employment,
    "summary_counts": counts_long,
    "coerce_applicant": applicant_types,
    "coerce_features": feature_types,
    "load_fingerprints": load_fingerprints,
    "load_dedup": load_dedup,
    "load_new_rows": load_new_rows,
    "load_counters": load_totals,
    "load_chunk_counters": load_chunks,
    "load_rejects": load_rejects,
    "dq_not_null": dq_not_null,
    "dq_rules": dq_rules,
    "dq_table_rules": dq_table_rules,
    "dq_primary_key": dq_primary_key,
    "dq_unique_prediction": dq_unique,
    "dq_unique_assessment": dq_unique_assessment,
    "dq_orphan_features": dq_orphan_features,
    "dq_orphan_prediction_applicants": dq_orphan_applicants,
    "dq_orphan_prediction_models": dq_orphan_models,
    "dq_orphan_explanations": dq_orphan_predictions,
    "dq_orphan_chunk_explanations": dq_orphan_explanations,
    "dq_orphan_chunk_documents": dq_orphan_documents,
    "dq_orphan_assessments": dq_orphan_assessments,
    "dq_enum_domain": dq_enum_domain,
    "dq_decimal_range": dq_decimal_range,
    "dq_string_length": dq_string_length,
    "dq_likert": dq_likert,
    "dq_champion": dq_champion,
    "lookup_applicant": lookup_applicant,
    "lookup_features": lookup_features,
    "lookup_model": lookup_model,
    "lookup_prediction": lookup_prediction,
    "lookup_explanation": lookup_explanation,
    "lookup_applicant_predictions": applicant_predictions,
    "lookup_approved_predictions": approved_applicant_predictions,
    "champion_model": champion_model,
    "list_applicants": list_applicants,
    "list_models": list_models,
    "join_applicant_features": join_applicant_features,
    "join_applicant_predictions": join_applicant_predictions,
    "join_model_predictions": join_model_predictions,
    "join_prediction_explanations": join_prediction_explanations,
    "join_explanation_documents": join_explanation_documents,
    "join_explanation_assessments": join_explanation_assessments,
    "chunk_documents": document_chunks,
    "tfidf_vectors": tfidf_terms,
    "tfidf_topk": tfidf_top_k,
    "vector_topk": vector_top_k,
    "retrieval_score_maps": score_maps,
    "precision_at_k": precision_at_k,
    "mean_reciprocal_rank": reciprocal_rank,
    "cohen_kappa": rater_agreement,
    "rubric_means": rubric_means,
    "classification_metrics": model_metrics,
    "roc_auc": model_auc,
    "fairness_by_group": fairness_groups,
    "fairness_gaps": fairness_gaps,
    "decision_actions": decision_actions,
    "top_attributions": top_attributions,
    "splits_and_folds": splits_and_folds,
    "phrase_flags": phrase_flags,
    "confidence_flags": confidence_flags,
    "constructed_prompts": constructed_prompts,
    "krippendorff_alpha": alpha,
}
