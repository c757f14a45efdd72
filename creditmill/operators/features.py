"""Engineered loan features.

Every step adds columns with native expressions, so a chain of steps collapses
into one projection over the scan: no shuffle and no Python in the executors.
The two dataset-wide inputs (medians and the risk threshold) are fitted once
with ``fit_risk_baseline`` and enter the projection as constants.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.config import FEATURE_COLUMNS, FeatureConfig
from creditmill.functions.numeric import flag, floor_at_zero, ratio
from creditmill.functions.text import code_of
from creditmill.operators.quantiles import exact_quantiles, value_frequencies

_DEFAULT = FeatureConfig()


@dataclass(frozen=True)
class RiskBaseline:
    """Dataset-wide statistics; None when the dataset has no value to take them from."""

    median_rate: float | None
    median_score: float | None
    risk_threshold: float | None = None


def with_financial_ratios(df: DataFrame) -> DataFrame:
    income = F.col("monthly_income")
    share = F.col("loan_percent_income")
    burden = F.col("loan_amnt") * (1 + F.col("loan_int_rate") / 100) / 12.0
    return (
        df.withColumns(
            {
                "monthly_income": F.col("person_income") / 12.0,
                "monthly_loan_burden": burden,
                "debt_to_income_ratio": share,
                "loan_to_income_ratio": share,
                "credit_history_to_age_ratio": ratio(
                    F.col("cb_person_cred_hist_length"), F.col("person_age")
                ),
            }
        )
        .withColumn(
            "affordability_ratio",
            F.when(income > 0, 1.0 - F.col("monthly_loan_burden") / income),
        )
        .withColumn("affordability_ratio", floor_at_zero(F.col("affordability_ratio")))
    )


def with_age_employment(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    age, experience = F.col("person_age"), F.col("person_emp_exp")
    return df.withColumns(
        {
            "emp_to_age_ratio": ratio(experience, age),
            "loan_per_age": ratio(F.col("loan_amnt"), age),
            "young_inexperienced": flag((age < config.young_age) & (experience == 0)),
        }
    )


def with_credit_quality(
    df: DataFrame, baseline: RiskBaseline, config: FeatureConfig = _DEFAULT
) -> DataFrame:
    """Score tier, thin file, score density and the rate/score interaction.

    The bands are closed on both ends: a score outside all of them, between two
    of them (739.5) or missing falls to the lowest tier.
    """
    score, history = F.col("credit_score"), F.col("cb_person_cred_hist_length")
    tier = F
    for low, high, label in config.score_bands:
        tier = tier.when(score.between(low, high), label)
    costly = F.col("loan_int_rate") > F.lit(baseline.median_rate).cast("double")
    weak = score < F.lit(baseline.median_score).cast("double")
    return df.withColumns(
        {
            "credit_score_tier": tier.otherwise(config.fallback_tier),
            "thin_credit_file": flag(history < config.thin_file_years),
            "score_per_history_year": ratio(score, history),
            "credit_risk_interaction": flag(costly & weak),
        }
    )


def with_income_burden(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    """Income bucket (a missing income falls to the top one) and the burden flag."""
    bucket = F
    for upper, label in config.income_edges:
        bucket = bucket.when(F.col("person_income") <= upper, label)
    return df.withColumns(
        {
            "income_bucket": bucket.otherwise(config.top_income_bucket),
            "high_loan_burden_flag": flag(F.col("loan_percent_income") > config.burden_limit),
        }
    )


def with_employment_stability(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    settled = F.col("person_emp_exp") >= config.stable_years
    return df.withColumn(
        "employment_stability", F.when(settled, "stable").otherwise("unstable")
    )


def with_composite_score(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    """Weighted sum of seven yes/no signals, rounded to six decimals."""
    signals = {
        "debt_to_income_ratio": flag(F.col("debt_to_income_ratio") > config.income_share_limit),
        "loan_to_income_ratio": flag(F.col("loan_to_income_ratio") > config.income_share_limit),
        "thin_credit_file": F.col("thin_credit_file"),
        "credit_risk_interaction": F.col("credit_risk_interaction"),
        "high_loan_burden_flag": F.col("high_loan_burden_flag"),
        "is_default_on_file": F.col("previous_loan_defaults_on_file"),
        "young_inexperienced": F.col("young_inexperienced"),
    }
    total = F.lit(0.0)
    for name, weight in config.risk_weights.items():
        total = total + signals[name].cast("double") * F.lit(weight)
    return df.withColumn("composite_risk_score", F.round(total, 6))


def with_risk_flag(df: DataFrame, baseline: RiskBaseline) -> DataFrame:
    """High risk is at or above the threshold, so ties at it are all flagged."""
    threshold = F.lit(baseline.risk_threshold).cast("double")
    return df.withColumn("is_high_risk", flag(F.col("composite_risk_score") >= threshold))


def with_homeownership(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    score = code_of(
        F.col("person_home_ownership"), config.ownership_scores, config.unknown_ownership_score
    )
    return df.withColumn("homeownership_score", score).withColumn(
        "stability_income_interaction",
        F.round(F.col("homeownership_score") * F.log1p("person_income"), 6),
    )


def with_intent_risk(df: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    intent = F.upper(F.col("loan_intent"))
    return df.withColumn(
        "intent_risk_score", code_of(intent, config.intent_scores, config.unknown_intent_score)
    )


def with_version(df: DataFrame, version: str = _DEFAULT.version) -> DataFrame:
    return df.withColumn("pipeline_version", F.lit(version))


def select_features(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The feature columns in published order; names the frame lacks are skipped."""
    present = [name for name in (*extra, *FEATURE_COLUMNS) if name in df.columns]
    return df.select(*present)


def _scored(df: DataFrame, baseline: RiskBaseline, config: FeatureConfig) -> DataFrame:
    return (
        df.transform(with_financial_ratios)
        .transform(with_age_employment, config)
        .transform(with_credit_quality, baseline, config)
        .transform(with_income_burden, config)
        .transform(with_employment_stability, config)
        .transform(with_composite_score, config)
    )


def fit_medians(cleaned: DataFrame, config: FeatureConfig = _DEFAULT) -> RiskBaseline:
    """Medians of interest rate and credit score, from one two-column pass."""
    frequencies = value_frequencies(
        cleaned,
        {"rate": F.col("loan_int_rate"), "score": F.col("credit_score")},
    )
    medians = exact_quantiles(frequencies, {"rate": 0.5, "score": 0.5})
    return RiskBaseline(medians["rate"], medians["score"])


def fit_threshold(scored: DataFrame, config: FeatureConfig = _DEFAULT) -> float | None:
    """Threshold of the composite score.

    Seven signals give the score at most 2^7 values, so the built-in exact
    percentile keeps a table of at most that many counts per task.
    """
    quantile = F.lit(config.high_risk_quantile)
    return scored.agg(F.percentile("composite_risk_score", quantile)).first()[0]


def fit_risk_baseline(cleaned: DataFrame, config: FeatureConfig = _DEFAULT) -> RiskBaseline:
    """Both medians, then the threshold of the composite score built on them."""
    medians = fit_medians(cleaned, config)
    return replace(medians, risk_threshold=fit_threshold(_scored(cleaned, medians, config), config))


def _completed(scored: DataFrame, baseline: RiskBaseline, config: FeatureConfig) -> DataFrame:
    return (
        scored.transform(with_risk_flag, baseline)
        .transform(with_homeownership, config)
        .transform(with_intent_risk, config)
        .transform(with_version, config.version)
    )


def engineer_features(
    cleaned: DataFrame, baseline: RiskBaseline, config: FeatureConfig = _DEFAULT
) -> DataFrame:
    """All engineered columns next to the cleaned ones: a projection, no shuffle."""
    return _completed(_scored(cleaned, baseline, config), baseline, config)


def fit_and_engineer(cleaned: DataFrame, config: FeatureConfig = _DEFAULT) -> DataFrame:
    """``fit_risk_baseline`` and ``engineer_features`` in one go."""
    medians = fit_medians(cleaned, config)
    scored = _scored(cleaned, medians, config)
    baseline = replace(medians, risk_threshold=fit_threshold(scored, config))
    return _completed(scored, baseline, config)
