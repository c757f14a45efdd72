"""The idempotent load."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from creditmill.catalog.samples import Samples
from creditmill.config import LoadConfig
from creditmill.plans.feature_table import build_feature_table
from creditmill.plans.load import RejectedRowsError, chunk_counters, load_counters, load_features, plan_load, store_new_rows
from creditmill.operators.dedup import first_occurrences, new_occurrences
from creditmill.operators.coercion import coerce_applicant, coerce_features, coerce_loans, explain_rejects
from creditmill.session import stage
from creditmill.sources.files import read_features, write_features
from creditmill.sources.store import BatchExistsError, LoanStore

TS = datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture
def features(raw):
    def build(*changes):
        return stage(build_feature_table(raw(*changes), extra=("row_no",)), "test-features")

    return build


@pytest.fixture
def store(spark, tmp_path):
    return LoanStore(spark, str(tmp_path / "store"))


def people(n):
    return [{"person_income": str(30000 + 100 * i)} for i in range(n)]


def test_load_twice_inserts_nothing(features, store):
    table = features(*people(20))
    first = load_features(table, store, batch_id="one", run_ts=TS)
    assert (first.total, first.inserted, first.skipped, first.rejected) == (20, 20, 0, 0)
    second = load_features(table, store, batch_id="two", run_ts=TS)
    assert (second.inserted, second.skipped) == (0, 20)
    applicants, derived = store.read("loan_applicants"), store.read("engineered_features")
    assert applicants.count() == derived.count() == 20
    assert applicants.join(derived, applicants.id == derived.applicant_id).count() == 20
    assert applicants.first()["created_at"] == TS


def test_rounding_does_not_break_idempotence(features, store):
    table = features({"person_income": "45000.129", "loan_percent_income": "0.266666"})
    assert load_features(table, store, batch_id="one").inserted == 1
    assert load_features(table, store, batch_id="two").skipped == 1


def test_first_occurrence_wins(features, store):
    table = features({"person_gender": "female"}, {"person_gender": "male"}, {"person_gender": "other"})
    result = load_features(table.repartition(3), store, batch_id="one")
    assert (result.inserted, result.skipped) == (1, 2)
    assert store.read("loan_applicants").first()["person_gender"] == "female"


def test_file_order_decides_when_there_is_no_row_number(spark, features, store, tmp_path):
    table = features({"person_gender": "female"}, {"person_gender": "male"})
    write_features(table.orderBy("row_no").coalesce(1).drop("row_no"), tmp_path / "f")
    rows = read_features(spark, tmp_path / "f", with_order=True)
    assert load_features(rows, store, batch_id="one").skipped == 1
    assert store.read("loan_applicants").first()["person_gender"] == "female"


def test_dry_run_writes_nothing(features, store):
    result = load_features(features(*people(5)), store, LoadConfig(dry_run=True), "one")
    assert (result.total, result.inserted, result.dry_run) == (5, 5, True)
    assert store.read("loan_applicants").isEmpty() and store.manifest().isEmpty()


def test_rejects(spark, features, store):
    changes = people(3) + [
        {"person_age": "n/a"},
        {"person_home_ownership": "LODGER"},
        {"loan_percent_income": "12.5"},
        {"credit_score": "inf"},
        {"loan_status": "99999"},
    ]
    table = features(*changes)
    with pytest.raises(RejectedRowsError, match="person_age: required"):
        load_features(table, store, LoadConfig(strict=True), "strict")
    assert store.manifest().isEmpty()
    result = load_features(table, store, batch_id="one")
    assert (result.inserted, result.rejected) == (3, 5)
    rejects = spark.read.parquet(store.path("rejects", "one"))
    reasons = {r["row_no"]: r["violations"] for r in rejects.collect()}
    assert "person_age: required" in reasons[3]
    assert "person_home_ownership: required" in reasons[4]
    assert "loan_percent_income: out of range" in reasons[5]
    assert "credit_score: out of range" in reasons[6]
    assert reasons[7] == ["loan_status: out of range"]


def test_infinity_in_an_optional_decimal_is_only_missing(features):
    table = features({}).withColumn("affordability_ratio", F.lit(float("inf")))
    row = coerce_loans(table).first()
    assert row["storable"] and row["affordability_ratio"] is None


def test_unpublished_batch_is_invisible_and_replaced(features, store):
    table = features(*people(4))
    load_features(table, store, batch_id="one")
    half = store.read("loan_applicants")
    store.write("loan_applicants", half, "broken")  # a load that died before publishing
    assert store.read("loan_applicants").count() == 4
    more = features(*people(6))
    assert load_features(more, store, batch_id="broken").inserted == 2
    assert store.read("loan_applicants").count() == 6
    with pytest.raises(BatchExistsError):
        load_features(more, store, batch_id="broken")


def test_source_split_length(features):
    with pytest.raises(ValueError):
        coerce_loans(features({}), LoadConfig(source_split="longer than ten"))


def test_version_too_long_is_rejected(features):
    table = features({}).withColumn("pipeline_version", F.lit("v" * 21))
    rejects = explain_rejects(coerce_loans(table).where("not storable")).collect()
    assert rejects[0]["violations"] == ["pipeline_version: too long"]


def test_bool_and_code_coercion(features):
    table = features({}).select(
        "*", F.explode(F.array(*[F.lit(x) for x in ("TRUE", "1", " yes ", "garbage", "False")])).alias("t")
    )
    typed = coerce_features(table.withColumn("is_high_risk", F.col("t"))).collect()
    assert {r["t"]: r["is_high_risk"] for r in typed} == {
        "TRUE": True, "1": True, " yes ": True, "garbage": False, "False": False,
    }
    numbers = coerce_features(features({}).withColumn("is_high_risk", F.lit(2.0))).first()
    assert numbers["is_high_risk"] is True
    odd = features({}).withColumns(
        {"person_education": F.lit(" Doctorate "), "person_gender": F.lit(" MALE"), "loan_intent": F.lit("homeimprovement")}
    )
    row = coerce_applicant(odd).first()
    assert (row["person_education"], row["person_gender"], row["loan_intent"]) == ("Doctor", "male", "HOME_IMPROVEMENT")


def test_missing_version_gets_the_default(features):
    assert coerce_features(features({}).drop("pipeline_version")).first()["pipeline_version"] == "1.0.0"


def test_load_from_csv(spark, features, store, tmp_path):
    write_features(features(*people(7)).drop("row_no"), tmp_path / "f", "csv")
    rows = read_features(spark, tmp_path / "f", "csv", with_order=True)
    assert load_features(rows, store, batch_id="csv").inserted == 7


def test_csv_and_parquet_load_the_same_rows(spark, features, tmp_path):
    table = features(*people(9))
    loaded = []
    for fmt in ("csv", "parquet"):
        write_features(table.drop("row_no"), tmp_path / fmt, fmt)
        store = LoanStore(spark, str(tmp_path / f"store-{fmt}"))
        rows = read_features(spark, tmp_path / fmt, fmt, with_order=True)
        load_features(rows, store, batch_id="b", run_ts=TS)
        loaded.append(
            [store.read(t).orderBy("id").collect() for t in ("loan_applicants", "engineered_features")]
        )
    assert loaded[0] == loaded[1]


def test_counters(spark, sf_dir):
    samples = Samples(spark, sf_dir)
    stored = samples.loan_existing()
    plan = plan_load(coerce_loans(samples.loan_batch()), stored)
    totals = load_counters(plan, stored).first().asDict()
    parts = [totals[k] for k in ("rejected", "skipped_in_batch", "skipped_stored", "inserted")]
    assert sum(parts) == totals["incoming"]
    assert plan.new_rows.count() == totals["inserted"]
    chunks = chunk_counters(plan, 500).agg(*[F.sum(c).alias(c) for c in ("total", "inserted", "rejected")])
    assert tuple(chunks.first()) == (totals["incoming"], totals["inserted"], totals["rejected"])
    if sf_dir.endswith("sf0.001"):
        assert (totals["incoming"], *parts) == (1530, 15, 30, 148, 1337)


def test_hot_fingerprint(features, store):
    """A third of the batch is one application; it is stored once."""
    table = features(*(people(10) + [{}] * 5)).crossJoin(features({}).sparkSession.range(20)).drop("id")
    table = table.withColumn("row_no", F.monotonically_increasing_id())
    result = load_features(table, store, batch_id="one")
    assert (result.total, result.inserted, result.skipped) == (300, 11, 289)


def test_two_loads_started_together_insert_a_fingerprint_once(features, store, spark):
    """The second is planned before the first is published, and published after it."""
    first, second = features(*people(20)), features(*people(30)[10:])
    known = store.batches("loan_applicants")
    late = plan_load(coerce_loans(second), store.read("loan_applicants"))
    assert load_features(first, store, batch_id="first").inserted == 20
    assert store_new_rows(late.new_rows, store, "second", TS, known) == 10
    keys = store.read("loan_applicants").select("id")
    assert keys.count() == keys.distinct().count() == 30
    assert store.read("engineered_features").count() == 30


def test_loads_in_two_threads(features, store):
    tables = [features(*people(30)), features(*people(40)[5:])]
    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(lambda i: load_features(tables[i], store, batch_id=f"t{i}"), range(2)))
    assert sum(r.inserted for r in results) == 40
    keys = store.read("loan_applicants").select("id")
    assert keys.count() == keys.distinct().count() == 40


def test_a_publisher_that_is_gone_is_reported(store):
    with store.publishing("one"):
        with pytest.raises(TimeoutError, match="_publishing"):
            with store.publishing("two", wait=0.5):
                raise AssertionError("two publishers at once")
    with store.publishing("three", wait=0.5):
        pass


def test_repeated_row_numbers_leave_one_row(features, spark):
    rows = features(*people(3)).withColumn("row_no", F.lit(7))
    twice = rows.unionByName(rows)
    assert first_occurrences(twice, keys=["person_income"]).count() == 3
    none = twice.select("person_income").limit(0)
    assert new_occurrences(twice, none, keys=["person_income"]).count() == 3


def test_first_occurrences_keep_one_row_per_task_before_the_shuffle(features):
    plan = first_occurrences(features(*people(3)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
