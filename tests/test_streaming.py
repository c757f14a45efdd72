"""The load as a stream of arriving files."""

from creditmill.plans.feature_table import build_feature_table
from creditmill.sources.store import LoanStore
from creditmill.streaming.incremental import load_arrivals
from creditmill.streaming.keyed import load_first_arrivals


def test_arrivals_are_loaded_once(spark, raw, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    store = LoanStore(spark, str(tmp_path / "store"))

    def arrive(first, last):
        changes = [{"person_income": str(30000 + 100 * i)} for i in range(first, last)]
        build_feature_table(raw(*changes)).write.mode("append").parquet(landing)

    def run():
        load_arrivals(spark, landing, store, checkpoint).awaitTermination()
        return store.read("loan_applicants").count()

    arrive(0, 10)
    assert run() == 10
    assert run() == 10  # nothing new
    arrive(5, 15)  # half of them stored before
    assert run() == 15
    assert store.read("engineered_features").count() == 15


def test_a_new_checkpoint_and_folder_share_the_store(spark, raw, tmp_path):
    store = LoanStore(spark, str(tmp_path / "store"))
    for folder, first in (("a", 0), ("b", 10)):
        landing = str(tmp_path / folder)
        changes = [{"person_income": str(50000 + 100 * i)} for i in range(first, first + 10)]
        build_feature_table(raw(*changes)).write.parquet(landing)
        load_arrivals(spark, landing, store, str(tmp_path / f"checkpoint-{folder}")).awaitTermination()
    assert store.read("loan_applicants").count() == 20


def test_a_replayed_batch_does_nothing(spark, raw, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), tmp_path / "checkpoint"
    store = LoanStore(spark, str(tmp_path / "store"))
    build_feature_table(raw({"person_income": "61000"}, {"person_income": "62000"})).write.parquet(landing)
    load_arrivals(spark, landing, store, str(checkpoint)).awaitTermination()
    for file in (checkpoint / "commits").glob("*0*"):
        file.unlink()  # as if the stream had stopped after the load and before its commit
    load_arrivals(spark, landing, store, str(checkpoint)).awaitTermination()
    assert store.read("loan_applicants").count() == 2
    assert store.manifest().where("table_name = 'loan_applicants'").count() == 1


def test_state_keeps_first_arrivals_over_restarts(spark, raw, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    store = LoanStore(spark, str(tmp_path / "store"))

    def arrive(first, last, gender):
        changes = [{"person_income": str(30000 + 100 * (i % 7)), "person_gender": gender} for i in range(first, last)]
        build_feature_table(raw(*changes)).coalesce(1).write.mode("append").parquet(landing)

    def run():
        load_first_arrivals(spark, landing, store, checkpoint).awaitTermination()
        return sorted((float(r.person_income), r.person_gender) for r in store.read("loan_applicants").collect())

    arrive(0, 4, "male")
    assert run() == [(30000.0 + 100 * i, "male") for i in range(4)]
    arrive(0, 20, "female")  # repeats in the batch and of the batch before
    first = [(30000.0 + 100 * i, "male" if i < 4 else "female") for i in range(7)]
    assert run() == first
    assert run() == first
    arrive(0, 7, "other")
    assert run() == first
    assert store.read("engineered_features").count() == 7


def test_a_replayed_micro_batch_keeps_its_rows(spark, raw, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), tmp_path / "checkpoint"
    store = LoanStore(spark, str(tmp_path / "store"))
    build_feature_table(raw({"person_income": "61000"}, {"person_income": "62000"})).write.parquet(landing)
    load_first_arrivals(spark, landing, store, str(checkpoint)).awaitTermination()
    for file in (checkpoint / "commits").glob("*0*"):
        file.unlink()
    load_first_arrivals(spark, landing, store, str(checkpoint)).awaitTermination()
    assert store.read("loan_applicants").count() == 2
    assert store.manifest().where("table_name = 'loan_applicants'").count() == 1
