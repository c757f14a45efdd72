"""The eight stored tables: columns, domains, keys and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from creditmill import config as C


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    domain: tuple[str, ...] | None = None
    max_length: int | None = None
    between: tuple[int, int] | None = None


@dataclass(frozen=True)
class Table:
    """Columns plus the constraints a relational store would enforce."""

    name: str
    fields: tuple[Field, ...]
    natural_key: tuple[str, ...]
    stamp: str
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> T.StructType:
        columns = [f"`{f.name}` {f.type}" for f in self.fields]
        return T.StructType.fromDDL(", ".join(columns))

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)


# ---------------------------------------------------------------------------
# Column names, types, lengths, domains and keys of the tables.
# ---------------------------------------------------------------------------

APPLICANTS = Table(
    "loan_applicants",
    (
        Field("id", "string", required=True),
        Field("person_age", "decimal(5,1)", required=True),
        Field("person_gender", "string", domain=C.GENDERS),
        Field("person_education", "string", domain=C.EDUCATION_LEVELS),
        Field("person_income", "decimal(12,2)", required=True),
        Field("person_emp_exp", "int", required=True),
        Field("person_home_ownership", "string", required=True, domain=C.HOME_OWNERSHIP),
        Field("loan_amnt", "decimal(12,2)", required=True),
        Field("loan_intent", "string", required=True, domain=C.LOAN_INTENTS),
        Field("loan_grade", "string", domain=C.LOAN_GRADES),
        Field("loan_int_rate", "decimal(5,2)", required=True),
        Field("loan_percent_income", "decimal(5,4)", required=True),
        Field("cb_person_cred_hist_length", "decimal(4,1)", required=True),
        Field("credit_score", "int", required=True),
        Field("previous_loan_defaults_on_file", "boolean", required=True),
        Field("loan_status", "smallint"),
        Field("created_at", "timestamp", required=True),
        Field("source_split", "string", max_length=10),
    ),
    natural_key=C.FINGERPRINT_COLUMNS,
    stamp="created_at",
)

FEATURES = Table(
    "engineered_features",
    (
        Field("id", "string", required=True),
        Field("applicant_id", "string", required=True),
        Field("debt_to_income_ratio", "decimal(10,6)"),
        Field("loan_to_income_ratio", "decimal(10,6)"),
        Field("credit_history_to_age_ratio", "decimal(10,6)"),
        Field("affordability_ratio", "decimal(10,6)"),
        Field("monthly_loan_burden", "decimal(12,2)"),
        Field("monthly_income", "decimal(12,2)"),
        Field("emp_to_age_ratio", "decimal(10,6)"),
        Field("loan_per_age", "decimal(10,4)"),
        Field("young_inexperienced", "boolean"),
        Field("credit_score_tier", "string", domain=C.CREDIT_TIERS),
        Field("thin_credit_file", "boolean"),
        Field("score_per_history_year", "decimal(10,4)"),
        Field("credit_risk_interaction", "boolean"),
        Field("income_bucket", "string", domain=C.INCOME_BUCKETS),
        Field("high_loan_burden_flag", "boolean"),
        Field("employment_stability", "string", domain=C.EMPLOYMENT_LEVELS),
        Field("is_high_risk", "boolean"),
        Field("composite_risk_score", "decimal(8,6)"),
        Field("homeownership_score", "smallint"),
        Field("stability_income_interaction", "decimal(12,6)"),
        Field("intent_risk_score", "smallint"),
        Field("computed_at", "timestamp", required=True),
        Field("pipeline_version", "string", max_length=20),
    ),
    natural_key=("applicant_id",),
    stamp="computed_at",
    unique=(("applicant_id",),),
    references=(("applicant_id", "loan_applicants"),),
)

MODELS = Table(
    "ml_models",
    (
        Field("id", "string", required=True),
        Field("algorithm", "string", required=True, domain=C.ALGORITHMS),
        Field("is_from_scratch", "boolean", required=True),
        Field("hyperparameters", "string"),
        Field("cv_accuracy", "decimal(6,4)"),
        Field("cv_precision", "decimal(6,4)"),
        Field("cv_recall", "decimal(6,4)"),
        Field("cv_f1_weighted", "decimal(6,4)"),
        Field("cv_auc_roc", "decimal(6,4)"),
        Field("equalized_odds", "map<string,double>"),
        Field("demographic_parity", "map<string,double>"),
        Field("model_path", "string", max_length=500),
        Field("trained_at", "timestamp", required=True),
        Field("is_champion", "boolean"),
    ),
    natural_key=("algorithm", "hyperparameters", "model_path", "trained_at"),
    stamp="trained_at",
)

PREDICTIONS = Table(
    "model_predictions",
    (
        Field("id", "string", required=True),
        Field("applicant_id", "string", required=True),
        Field("model_id", "string", required=True),
        Field("predicted_outcome", "string", required=True, domain=C.OUTCOMES),
        Field("approval_probability", "decimal(6,4)", required=True),
        Field("risk_tier", "string", max_length=20),
        Field("shap_values", "map<string,double>"),
        Field("top_shap_features", "array<string>"),
        Field("predicted_at", "timestamp", required=True),
    ),
    natural_key=("applicant_id", "model_id"),
    stamp="predicted_at",
    unique=(("applicant_id", "model_id"),),
    references=(("applicant_id", "loan_applicants"), ("model_id", "ml_models")),
)

DOCUMENTS = Table(
    "retrieval_documents",
    (
        Field("id", "string", required=True),
        Field("source_name", "string", required=True, max_length=200),
        Field("source_type", "string", max_length=100),
        Field("chunk_index", "int", required=True),
        Field("chunk_text", "string", required=True),
        Field("token_count", "int"),
        Field("tfidf_vector", "map<string,double>"),
        Field("embedding_vector", "array<float>"),
        Field("added_at", "timestamp", required=True),
    ),
    # Two texts of one source may both have a first chunk.
    natural_key=("source_name", "chunk_index", "chunk_text"),
    stamp="added_at",
)

EXPLANATIONS = Table(
    "rag_explanations",
    (
        Field("id", "string", required=True),
        Field("prediction_id", "string", required=True),
        Field("retriever_type", "string", required=True, domain=C.RETRIEVERS),
        Field("query_text", "string"),
        Field("retrieval_k", "smallint"),
        Field("retrieval_scores", "map<string,double>"),
        Field("constructed_prompt", "string"),
        Field("llm_model", "string", max_length=100),
        Field("llm_response", "string", required=True),
        Field("generation_latency_ms", "int"),
        Field("generated_at", "timestamp", required=True),
    ),
    natural_key=("prediction_id",),
    stamp="generated_at",
    unique=(("prediction_id",),),
    references=(("prediction_id", "model_predictions"),),
)

EXPLANATION_CHUNKS = Table(
    "rag_explanation_chunks",
    (
        Field("id", "string", required=True),
        Field("explanation_id", "string", required=True),
        Field("document_id", "string", required=True),
        Field("rank", "smallint", required=True),
        Field("retrieval_score", "decimal(8,6)"),
    ),
    natural_key=("explanation_id", "document_id", "rank"),
    stamp="",
    references=(
        ("explanation_id", "rag_explanations"),
        ("document_id", "retrieval_documents"),
    ),
)

ASSESSMENTS = Table(
    "evaluator_assessments",
    (
        Field("id", "string", required=True),
        Field("explanation_id", "string", required=True),
        Field("evaluator_id", "string", required=True, max_length=50),
        Field("is_rag_system", "boolean", required=True),
        Field("policy_traceability", "smallint", required=True, between=(1, 5)),
        Field("factual_accuracy", "smallint", required=True, between=(1, 5)),
        Field("completeness", "smallint", required=True, between=(1, 5)),
        Field("actionability", "smallint", required=True, between=(1, 5)),
        Field("notes", "string"),
        Field("assessed_at", "timestamp", required=True),
    ),
    natural_key=("explanation_id", "evaluator_id"),
    stamp="assessed_at",
    unique=(("explanation_id", "evaluator_id"),),
    references=(("explanation_id", "rag_explanations"),),
)

TABLES = {
    table.name: table
    for table in (
        APPLICANTS,
        FEATURES,
        MODELS,
        PREDICTIONS,
        DOCUMENTS,
        EXPLANATIONS,
        EXPLANATION_CHUNKS,
        ASSESSMENTS,
    )
}
