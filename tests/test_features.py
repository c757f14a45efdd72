"""Edge cases of cleaning and of every engineered column."""

import pytest
from pyspark.sql import functions as F

from creditmill.config import FEATURE_COLUMNS, FeatureConfig
from creditmill.operators.cleaning import blank_missing_tokens, clean_loans, count_age_outliers
from creditmill.operators.features import (
    RiskBaseline,
    engineer_features,
    fit_risk_baseline,
    select_features,
    with_risk_flag,
)
from creditmill.plans.feature_table import build_feature_table

BASELINE = RiskBaseline(11.0, 600.0, 0.45)


def cleaned(raw, column, *values):
    rows = clean_loans(raw(*[{column: v} for v in values])).orderBy("row_no").collect()
    return [row[column] for row in rows]


def engineered(raw, column, *changes):
    rows = engineer_features(clean_loans(raw(*changes)), BASELINE).orderBy("row_no").collect()
    return [row[column] for row in rows]


def per_value(raw, source, column, *values):
    return engineered(raw, column, *[{source: v} for v in values])


def test_worked_row(raw):
    row = engineer_features(clean_loans(raw({})), BASELINE).first()
    expected = {
        "monthly_income": 3750.0,
        "monthly_loan_burden": 1125.0,
        "affordability_ratio": 0.7,
        "credit_history_to_age_ratio": 0.214286,
        "emp_to_age_ratio": 0.178571,
        "loan_per_age": 428.571429,
        "score_per_history_year": 115.0,
        "stability_income_interaction": 10.71444,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name
    assert row["credit_score_tier"] == "Good"
    assert row["income_bucket"] == "low"
    assert row["employment_stability"] == "stable"
    assert row["homeownership_score"] == 1
    assert row["intent_risk_score"] == 2
    assert row["pipeline_version"] == "1.0.0"
    for name in ("young_inexperienced", "thin_credit_file", "high_loan_burden_flag"):
        assert row[name] is False, name


def test_age_cap(raw):
    assert cleaned(raw, "person_age", "100", "101", "123", "99.5") == [100.0, 100.0, 100.0, 99.5]
    assert count_age_outliers(raw({"person_age": "123"}, {"person_age": "100"})).first()[0] == 1


@pytest.mark.parametrize("bad", ["abc", "", "n/a", "1d", "2f", "1_000", "0x1p3", "nan", ".", "1 2", None])
def test_bad_numbers_are_null(raw, bad):
    assert cleaned(raw, "person_income", bad) == [None]


def test_padded_and_odd_numbers(raw):
    assert cleaned(raw, "loan_amnt", " 12 ", "\t12\n", "1e3", ".5", "7.", "-3", "+4") == [
        12.0, 12.0, 1000.0, 0.5, 7.0, -3.0, 4.0,
    ]
    assert cleaned(raw, "loan_amnt", "inf", "-Infinity") == [float("inf"), float("-inf")]


def test_default_flag(raw):
    assert cleaned(
        raw, "previous_loan_defaults_on_file", " Yes", "No", " No\t", "Maybe", "yes", "no", None
    ) == [True, False, False, True, True, True, True]


def test_default_flag_already_boolean(spark, raw):
    frame = raw({}, {}).withColumn("previous_loan_defaults_on_file", F.col("row_no") == 1)
    rows = clean_loans(frame).orderBy("row_no").collect()
    assert [r["previous_loan_defaults_on_file"] for r in rows] == [False, True]


def test_text_columns(raw):
    assert cleaned(raw, "person_education", " Doctorate\n", "doctorate", None) == ["Doctor", "doctorate", None]
    assert cleaned(raw, "loan_intent", "HOMEIMPROVEMENT ", "homeimprovement") == [
        "HOME_IMPROVEMENT", "homeimprovement",
    ]
    assert cleaned(raw, "person_home_ownership", " rent") == ["RENT"]
    assert cleaned(raw, "person_gender", " FeMale\t") == ["female"]


def test_missing_tokens(spark):
    frame = spark.createDataFrame([("NA",), ("None",), ("n/a",), (" NA",), ("x",), ("",)], "a string")
    assert [r["a"] for r in blank_missing_tokens(frame).collect()] == [None, None, None, " NA", "x", None]


def test_zero_and_missing_income(raw):
    changes = [{"person_income": "0"}, {"person_income": None}]
    assert engineered(raw, "affordability_ratio", *changes) == [None, None]
    assert engineered(raw, "income_bucket", *changes) == ["low", "high"]
    assert engineered(raw, "stability_income_interaction", *changes) == [0.0, None]


def test_affordability_is_clipped_but_null_stays(raw):
    changes = [{"loan_amnt": "900000"}, {"loan_amnt": None}]
    assert engineered(raw, "affordability_ratio", *changes) == [0.0, None]


def test_age_zero_or_missing(raw):
    for name in ("credit_history_to_age_ratio", "emp_to_age_ratio", "loan_per_age"):
        assert per_value(raw, "person_age", name, "0", None) == [None, None]
    changes = [{"person_age": a, "person_emp_exp": e} for a, e in
               [("24", "0"), ("25", "0"), ("24", "1"), (None, "0"), ("24", None)]]
    assert engineered(raw, "young_inexperienced", *changes) == [True, False, False, False, False]


def test_history(raw):
    values = ("0", "1", "2", None)
    source = "cb_person_cred_hist_length"
    assert per_value(raw, source, "score_per_history_year", *values) == [None, 690.0, 345.0, None]
    assert per_value(raw, source, "thin_credit_file", *values) == [True, True, False, False]


def test_tier_edges_and_gaps(raw):
    scores = {
        "299": "Poor", "300": "Poor", "579": "Poor", "580": "Fair", "669": "Fair", "670": "Good",
        "739": "Good", "740": "Very Good", "799": "Very Good", "800": "Exceptional",
        "850": "Exceptional", "851": "Poor", "579.5": "Poor", "669.5": "Poor", "739.5": "Poor",
        "799.5": "Poor", None: "Poor",
    }
    assert per_value(raw, "credit_score", "credit_score_tier", *scores) == list(scores.values())


def test_bucket_edges(raw):
    edges = {
        "47204": "low", "47204.01": "mid_low", "67048": "mid_low", "67048.01": "medium",
        "95789": "medium", "95789.01": "high",
    }
    assert per_value(raw, "person_income", "income_bucket", *edges) == list(edges.values())


def test_percent_edges(raw):
    values = ("0.30", "0.31", "0.40", "0.41", None)
    source = "loan_percent_income"
    assert per_value(raw, source, "high_loan_burden_flag", *values) == [False, True, True, True, False]
    # Both ratio signals read the same column: above 0.40 they add 0.20 and 0.15 to the flag's 0.10.
    assert per_value(raw, source, "composite_risk_score", *values) == [0.0, 0.1, 0.1, 0.45, 0.0]


def test_experience(raw):
    assert per_value(raw, "person_emp_exp", "employment_stability", "1", "2", None) == [
        "unstable", "stable", "unstable",
    ]


def test_intent_and_ownership_codes(raw):
    assert per_value(
        raw, "loan_intent", "intent_risk_score", "personal", "HOMEIMPROVEMENT", "CRYPTO", None, "VENTURE", "EDUCATION"
    ) == [2, 1, 2, 2, 5, 0]
    assert per_value(raw, "loan_intent", "loan_intent", "personal") == ["personal"]
    assert per_value(raw, "person_home_ownership", "homeownership_score", " rent", "LODGER", None, "own") == [1, 0, 0, 3]


def test_interaction_is_strict(raw):
    changes = [{"loan_int_rate": r, "credit_score": s} for r, s in
               [("11", "500"), ("11.1", "600"), ("11.1", "599"), (None, "500"), ("12", None)]]
    assert engineered(raw, "credit_risk_interaction", *changes) == [False, False, True, False, False]


def test_medians_of_an_even_count(raw):
    rates = ["1", "2", "3", "4", None]
    baseline = fit_risk_baseline(clean_loans(raw(*[{"loan_int_rate": r} for r in rates])))
    assert baseline.median_rate == 2.5
    assert baseline.median_score == 690.0


def test_no_values_to_fit(raw):
    frame = clean_loans(raw({"loan_int_rate": None, "credit_score": None}))
    baseline = fit_risk_baseline(frame)
    assert (baseline.median_rate, baseline.median_score) == (None, None)
    assert engineer_features(frame, baseline).first()["credit_risk_interaction"] is False
    empty = clean_loans(raw({}).where("false"))
    assert fit_risk_baseline(empty) == RiskBaseline(None, None, None)


def test_tied_percentile_flags_every_row(raw):
    changes = [{"loan_percent_income": p} for p in ["0.1"] * 8 + ["0.5"] * 2]
    table = build_feature_table(raw(*changes))
    assert table.where("is_high_risk").count() == 10


def test_nan_in_a_numeric_source_is_missing(spark, raw):
    frame = raw({}).withColumn("cb_person_cred_hist_length", F.lit(float("nan")))
    row = engineer_features(clean_loans(frame), BASELINE).first()
    assert row["thin_credit_file"] is False and row["score_per_history_year"] is None


def test_score_takes_19_values(raw):
    changes = [
        {
            "loan_percent_income": p, "cb_person_cred_hist_length": h, "loan_int_rate": r,
            "credit_score": "500", "previous_loan_defaults_on_file": d, "person_age": "20",
            "person_emp_exp": e,
        }
        for p in ("0.1", "0.35", "0.5") for h in ("1", "5") for r in ("5", "20")
        for d in ("Yes", "No") for e in ("0", "4")
    ]
    found = set(engineered(raw, "composite_risk_score", *changes))
    assert found == {round(0.05 * i, 6) for i in range(21)} - {0.05, 0.95}


def test_column_order_and_missing_columns(raw):
    table = build_feature_table(raw({}))
    assert table.columns == list(FEATURE_COLUMNS) and len(table.columns) == 36
    assert select_features(raw({}).select("loan_amnt", "person_age")).columns == ["person_age", "loan_amnt"]


def test_result_does_not_depend_on_partitioning(raw):
    frame = raw(*[{"credit_score": str(300 + 7 * i), "loan_int_rate": str(5 + i % 9)} for i in range(60)])
    one = build_feature_table(frame.coalesce(1), extra=("row_no",)).orderBy("row_no").collect()
    many = build_feature_table(frame.repartition(13), extra=("row_no",)).orderBy("row_no").collect()
    assert one == many


def test_config_changes_results(raw):
    config = FeatureConfig(version="2.1", stable_years=10, burden_limit=0.2)
    row = build_feature_table(raw({}), config).first()
    assert (row["pipeline_version"], row["employment_stability"]) == ("2.1", "unstable")
    assert row["high_loan_burden_flag"] is True


def test_threshold_itself_is_high_risk(spark):
    frame = spark.createDataFrame([(0.44,), (0.45,), (None,)], "composite_risk_score double")
    flags = [r["is_high_risk"] for r in with_risk_flag(frame, BASELINE).collect()]
    assert flags == [False, True, False]
