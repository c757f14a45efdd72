"""Registered lookups read a stored table by its key."""

import pytest
from pyspark.sql import functions as F

from creditmill.catalog import queries
from creditmill.catalog.samples import Samples
from creditmill.sources.store import LoanStore

KEYED = {
    "lookup_applicant": "id",
    "lookup_features": "applicant_id",
    "lookup_model": "id",
    "lookup_prediction": "id",
    "lookup_explanation": "prediction_id",
    "lookup_applicant_predictions": "applicant_id",
}


@pytest.mark.parametrize("name, key", KEYED.items())
def test_no_lookup_joins_and_the_key_reaches_the_scan(spark, sf_dir, name, key):
    plan = queries.QUERIES[name](Samples(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and f"EqualTo({key}," in plan


def test_a_lookup_reads_the_files_that_may_hold_its_key(spark, tmp_path):
    """Bloom filters rule out most files that do not hold the key, so fewer rows are read than there are."""
    store = LoanStore(spark, str(tmp_path / "store"))
    columns = ["'decision_tree' AS algorithm", "false AS is_from_scratch", "current_timestamp() AS trained_at", "false AS is_champion"]
    rows = spark.range(4000).repartition(8).selectExpr("sha2(cast(id AS string), 256) AS id", *columns)
    store.create_models(rows, "one")
    table = store.current("ml_models")
    key = table.orderBy("id").first()["id"]
    found = table.where(F.col("id") == key)
    assert len(found.collect()) == 1
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = scan.metrics().get("numOutputRows").get().value()
    assert 0 < read < 2000 and table.count() == 4000


def test_only_published_batches_are_current(spark, tmp_path):
    store = LoanStore(spark, str(tmp_path / "store"))
    assert store.current("ml_models").count() == 0
    rows = spark.range(3).selectExpr(
        "cast(id AS string) AS id", "'naive_bayes' AS algorithm", "false AS is_from_scratch", "current_timestamp() AS trained_at", "false AS is_champion"
    )
    store.create_models(rows, "one")
    store.write("ml_models", store.current("ml_models"), "two")
    assert store.current("ml_models").count() == store.read("ml_models").count() == 3
    store.publish("two", {"ml_models": 3})
    assert store.current("ml_models").count() == 6
    assert store.read_batches("ml_models", ["two"]).count() == 3
