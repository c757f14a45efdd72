"""Appends with constraints, lookups and joins over stored tables."""

from datetime import datetime
from decimal import Decimal

import pytest

from creditmill.operators import joins, lookup, quality
from creditmill.sources.store import BatchExistsError, ConstraintError, LoanStore
from creditmill.sources.tables import ASSESSMENTS, TABLES

TS = datetime(2024, 1, 1)


def frame(spark, table, **values):
    schema = {f.name: f.dataType.simpleString() for f in TABLES[table].schema}
    ddl = ", ".join(f"`{name}` {schema[name]}" for name in values)
    return spark.createDataFrame([tuple(values.values())], ddl)


@pytest.fixture
def store(spark, tmp_path):
    return LoanStore(spark, str(tmp_path / "store"))


@pytest.fixture
def filled(spark, store):
    """One row in five tables, each pointing at the one before."""
    applicant = store.create_applicants(
        frame(
            spark, "loan_applicants", person_age=Decimal("28.0"), person_gender="male",
            person_education="Bachelor", person_income=Decimal("45000.00"), person_emp_exp=5,
            person_home_ownership="RENT", loan_amnt=Decimal("12000.00"), loan_intent="PERSONAL",
            loan_grade="B", loan_int_rate=Decimal("12.50"), loan_percent_income=Decimal("0.2600"),
            cb_person_cred_hist_length=Decimal("6.0"), credit_score=690,
            previous_loan_defaults_on_file=False, loan_status=1, source_split="test",
        ), "a", TS,
    ).first()["id"]
    store.create_features(
        frame(spark, "engineered_features", applicant_id=applicant, monthly_income=Decimal("3750.00")), "b", TS
    )
    model = store.create_models(
        frame(
            spark, "ml_models", algorithm="logistic_regression", hyperparameters='{"lr": 0.01}',
            cv_accuracy=Decimal("0.8200"), is_champion=True, equalized_odds={"male": 0.1},
        ), "c", TS,
    ).first()["id"]
    prediction = store.create_predictions(
        frame(
            spark, "model_predictions", applicant_id=applicant, model_id=model,
            predicted_outcome="approved", approval_probability=Decimal("0.7800"),
            shap_values={"income": 0.2, "credit_score": 0.3}, top_shap_features=["credit_score", "income"],
        ), "d", TS,
    ).first()["id"]
    store.create_explanations(
        frame(spark, "rag_explanations", prediction_id=prediction, llm_response="Stable income."), "e", TS
    )
    return store, applicant, model, prediction


def test_append_and_look_up(filled):
    store, applicant, model, prediction = filled
    assert lookup.get_by_id(store.read("loan_applicants"), applicant).first()["credit_score"] == 690
    assert lookup.get_features(store.read("engineered_features"), applicant).count() == 1
    champion = lookup.get_champion_model(store.read("ml_models")).first()
    assert champion["id"] == model and champion["is_from_scratch"] is False
    assert champion["equalized_odds"] == {"male": 0.1} and champion["trained_at"] == TS
    found = lookup.get_applicant_predictions(store.read("model_predictions"), applicant).first()
    assert found["id"] == prediction and found["top_shap_features"] == ["credit_score", "income"]
    explanation = lookup.get_explanation(store.read("rag_explanations"), prediction).first()
    assert explanation["retriever_type"] == "tfidf"
    assert lookup.get_by_id(store.read("ml_models"), "nobody").isEmpty()
    assert lookup.list_rows(store.read("ml_models"), 10).count() == 1


def test_joins_over_the_store(filled):
    store, applicant, model, prediction = filled
    read = store.read
    assert joins.applicant_with_features(read("loan_applicants"), read("engineered_features")).count() == 1
    assert joins.applicant_predictions(read("loan_applicants"), read("model_predictions")).count() == 1
    assert joins.model_predictions(read("ml_models"), read("model_predictions")).first()["model_id"] == model
    joined = joins.prediction_explanations(read("model_predictions"), read("rag_explanations"))
    assert joined.first()["llm_response"] == "Stable income."
    assert joins.explanation_assessments(read("rag_explanations"), read("evaluator_assessments")).isEmpty()
    assert joins.explanation_documents(
        read("rag_explanations"), read("rag_explanation_chunks"), read("retrieval_documents")
    ).isEmpty()


def test_constraints_stop_an_append(spark, filled):
    store, applicant, model, prediction = filled
    same = frame(
        spark, "model_predictions", applicant_id=applicant, model_id=model, predicted_outcome="rejected",
        approval_probability=Decimal("0.1000"),
    )
    with pytest.raises(ConstraintError, match="not unique"):
        store.create_predictions(same, "x")
    with pytest.raises(ConstraintError, match="not in loan_applicants"):
        store.create_features(frame(spark, "engineered_features", applicant_id="nobody"), "x")
    with pytest.raises(ConstraintError, match="algorithm: not in domain"):
        store.create_models(frame(spark, "ml_models", algorithm="svm"), "x")
    with pytest.raises(ConstraintError, match="llm_response: required"):
        store.create_explanations(frame(spark, "rag_explanations", prediction_id=prediction), "x")
    with pytest.raises(ValueError, match="has no column"):
        store.create_models(spark.createDataFrame([("a",)], "colour string"), "x")
    with pytest.raises(BatchExistsError):
        store.create_models(frame(spark, "ml_models", algorithm="naive_bayes"), "c")
    assert store.read("ml_models").count() == 1


def test_create_tables(store):
    store.create_tables()
    store.create_tables()
    for name, table in TABLES.items():
        assert store.read(name).schema == table.schema and store.read(name).isEmpty()


def test_row_rules(spark):
    rows = spark.createDataFrame(
        [("a", "e", "evaluator_1", True, 1, 5, 3, 3), ("b", "e", "x" * 51, True, 0, 6, 3, None)],
        "id string, explanation_id string, evaluator_id string, is_rag_system boolean, "
        "policy_traceability int, factual_accuracy int, completeness int, actionability int",
    )
    broken = rows.select("id", quality.row_violations(ASSESSMENTS, skip={"notes", "assessed_at"}).alias("v"))
    found = {r["id"]: set(r["v"]) for r in broken.collect()}
    assert found["a"] == set()
    assert found["b"] == {
        "evaluator_id: too long", "policy_traceability: out of range", "factual_accuracy: out of range",
        "actionability: required",
    }


def test_key_checks(spark):
    child = spark.createDataFrame([("p",), ("p",), ("q",), (None,)], "fk string")
    parent = spark.createDataFrame([("p",)], "id string")
    assert [tuple(r) for r in quality.orphans(child, "fk", parent).collect()] == [("q", 1)]
    assert [tuple(r) for r in quality.duplicate_keys(child, ["fk"]).collect()] == [("p", 2)]
    models = spark.createDataFrame([(True,), (True,), (False,), (None,)], "is_champion boolean")
    assert tuple(quality.champion_count(models).first()) == (2, False)


def test_a_lookup_skips_row_groups(spark, store):
    rows = spark.range(400).selectExpr(
        "concat('model-', id) AS id", "'random_forest' AS algorithm", "id % 2 = 0 AS is_from_scratch"
    )
    store.create_models(rows.repartition(8), "models")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lookup.get_by_id(store.read("ml_models"), "model-77")
        assert [r["id"] for r in found.collect()] == ["model-77"]
        plan = found._jdf.queryExecution().executedPlan()
        assert "EqualTo(id,model-77)" in plan.toString()
        leaves = plan.collectLeaves()
        read = [
            leaves.apply(i).metrics().apply("numOutputRows").value()
            for i in range(leaves.size())
            if "EqualTo(id" in leaves.apply(i).toString()
        ]
        assert read and sum(read) <= 100  # two of eight row groups at most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_ids_and_batches_are_stable(spark, store):
    rows = spark.createDataFrame([("svm_like", 1)], "model_path string, x int").selectExpr(
        "model_path", "'random_forest' AS algorithm", "true AS is_from_scratch"
    )
    made = store.create_models(rows, "first")
    assert made.select("id").first() == made.select("id").first()
    with pytest.raises(BatchExistsError):
        store.write("ml_models", made, "first")
    texts = spark.createDataFrame(
        [("policy", 0, "one text"), ("policy", 0, "another text")], "source_name string, chunk_index int, chunk_text string"
    )
    assert store.append("retrieval_documents", texts, "texts").count() == 2
