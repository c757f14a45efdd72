"""What the physical plans must and must not contain."""

from creditmill.catalog.queries import QUERIES
from creditmill.catalog.samples import Samples
from creditmill.operators import lookup


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_steps_are_one_stage(spark, raw):
    from creditmill.operators.cleaning import clean_loans
    from creditmill.operators.features import RiskBaseline, engineer_features

    plan = plan_of(engineer_features(clean_loans(raw({})), RiskBaseline(1.0, 1.0, 0.5)))
    assert "Exchange" not in plan and "Join" not in plan


def test_lookup_reaches_the_reader(spark, sf_dir, tmp_path):
    features = Samples(spark, sf_dir).features()
    features.select("person_gender", "loan_amnt").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("person_gender", "id")
    assert "EqualTo(person_gender,male)" in plan_of(lookup.get_by_id(stored, "male"))


def test_summary_reads_only_its_columns(spark, sf_dir):
    plan = plan_of(QUERIES["summary_counts"](Samples(spark, sf_dir)))
    schema = plan[plan.index("ReadSchema") :]
    assert "income_bucket" in schema and "loan_amnt" not in schema.split(">")[0]


def test_deduplication_combines_before_the_shuffle(spark, sf_dir):
    plan = plan_of(QUERIES["load_dedup"](Samples(spark, sf_dir)))
    # From the scan up: one row per fingerprint and task, then the only shuffle, then one per fingerprint.
    first, shuffle, last = plan.rindex("WindowGroupLimit"), plan.rindex("Exchange"), plan.index("WindowGroupLimit")
    assert last < shuffle < first and plan.count("Exchange") == 1 and "Partial" in plan[first:] and "Join" not in plan
