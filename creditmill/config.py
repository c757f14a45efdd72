"""Tunable parameters, with the defaults that define the published results."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Column names, code lists, bands, edges and weights below decide
# the results and must keep exactly these values.
# ---------------------------------------------------------------------------

PIPELINE_VERSION = "1.0.0"

RAW_COLUMNS = (
    "person_age",
    "person_gender",
    "person_education",
    "person_income",
    "person_emp_exp",
    "person_home_ownership",
    "loan_amnt",
    "loan_intent",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
    "previous_loan_defaults_on_file",
    "loan_status",
)

NUMERIC_COLUMNS = (
    "person_age",
    "person_income",
    "loan_amnt",
    "loan_int_rate",
    "loan_percent_income",
    "cb_person_cred_hist_length",
    "credit_score",
    "person_emp_exp",
)

FEATURE_COLUMNS = RAW_COLUMNS + (
    "debt_to_income_ratio",
    "loan_to_income_ratio",
    "credit_history_to_age_ratio",
    "affordability_ratio",
    "monthly_loan_burden",
    "monthly_income",
    "emp_to_age_ratio",
    "loan_per_age",
    "young_inexperienced",
    "credit_score_tier",
    "thin_credit_file",
    "score_per_history_year",
    "credit_risk_interaction",
    "income_bucket",
    "high_loan_burden_flag",
    "employment_stability",
    "is_high_risk",
    "composite_risk_score",
    "homeownership_score",
    "stability_income_interaction",
    "intent_risk_score",
    "pipeline_version",
)

# Two applications with the same four values count as the same application.
FINGERPRINT_COLUMNS = (
    "person_income",
    "loan_amnt",
    "credit_score",
    "loan_percent_income",
)

# Field values that a CSV reader treats as missing (the public pandas default list).
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

GENDERS = ("male", "female", "other")
EDUCATION_LEVELS = ("High School", "Bachelor", "Diploma", "Associate", "Master", "Doctor")
HOME_OWNERSHIP = ("MORTGAGE", "OTHER", "OWN", "RENT")
LOAN_INTENTS = (
    "DEBTCONSOLIDATION",
    "EDUCATION",
    "HOME_IMPROVEMENT",
    "MEDICAL",
    "PERSONAL",
    "VENTURE",
)
LOAN_GRADES = ("A", "B", "C", "D", "E", "F", "G")
CREDIT_TIERS = ("Poor", "Fair", "Good", "Very Good", "Exceptional")
INCOME_BUCKETS = ("low", "mid_low", "medium", "high")
EMPLOYMENT_LEVELS = ("stable", "unstable")
ALGORITHMS = (
    "logistic_regression",
    "decision_tree",
    "random_forest",
    "gradient_boosting",
    "naive_bayes",
)
OUTCOMES = ("approved", "rejected")
RETRIEVERS = ("tfidf", "vector")

EDUCATION_SYNONYMS = {"Doctorate": "Doctor"}
INTENT_SYNONYMS = {"HOMEIMPROVEMENT": "HOME_IMPROVEMENT"}

INCOME_EDGES = ((47204, "low"), (67048, "mid_low"), (95789, "medium"))
TOP_INCOME_BUCKET = "high"

SCORE_BANDS = (
    (800, 850, "Exceptional"),
    (740, 799, "Very Good"),
    (670, 739, "Good"),
    (580, 669, "Fair"),
    (300, 579, "Poor"),
)
FALLBACK_TIER = "Poor"

INTENT_SCORES = {
    "EDUCATION": 0,
    "HOMEIMPROVEMENT": 1,
    "HOME_IMPROVEMENT": 1,
    "PERSONAL": 2,
    "MEDICAL": 3,
    "DEBTCONSOLIDATION": 4,
    "VENTURE": 5,
}
UNKNOWN_INTENT_SCORE = 2

OWNERSHIP_SCORES = {"OTHER": 0, "RENT": 1, "MORTGAGE": 2, "OWN": 3}
UNKNOWN_OWNERSHIP_SCORE = 0

RISK_WEIGHTS = {
    "debt_to_income_ratio": 0.20,
    "loan_to_income_ratio": 0.15,
    "thin_credit_file": 0.10,
    "credit_risk_interaction": 0.15,
    "high_loan_burden_flag": 0.10,
    "is_default_on_file": 0.20,
    "young_inexperienced": 0.10,
}

# End of the fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureConfig:
    """Thresholds, bands, code maps and weights of the feature job."""

    version: str = PIPELINE_VERSION
    age_cap: float = 100.0
    education_synonyms: dict = field(default_factory=lambda: dict(EDUCATION_SYNONYMS))
    intent_synonyms: dict = field(default_factory=lambda: dict(INTENT_SYNONYMS))
    income_edges: tuple = INCOME_EDGES
    top_income_bucket: str = TOP_INCOME_BUCKET
    score_bands: tuple = SCORE_BANDS
    fallback_tier: str = FALLBACK_TIER
    intent_scores: dict = field(default_factory=lambda: dict(INTENT_SCORES))
    unknown_intent_score: int = UNKNOWN_INTENT_SCORE
    ownership_scores: dict = field(default_factory=lambda: dict(OWNERSHIP_SCORES))
    unknown_ownership_score: int = UNKNOWN_OWNERSHIP_SCORE
    risk_weights: dict = field(default_factory=lambda: dict(RISK_WEIGHTS))
    income_share_limit: float = 0.40
    burden_limit: float = 0.30
    thin_file_years: float = 2.0
    young_age: float = 25.0
    stable_years: float = 2.0
    high_risk_quantile: float = 0.75


@dataclass(frozen=True)
class LoadConfig:
    """Parameters of the idempotent load."""

    source_split: str = "processed"
    default_version: str = PIPELINE_VERSION
    chunk_size: int = 500
    strict: bool = False
    dry_run: bool = False
