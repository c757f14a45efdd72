"""Every registered query against its SQL oracle, and the published goldens."""

import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as contract  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from creditmill import catalog  # noqa: E402
from creditmill.catalog.samples import Samples  # noqa: E402

# No Python in the executors, and nothing that pairs all rows with all rows.
FORBIDDEN = (
    "PythonUDF",
    "ArrowEvalPython",
    "MapInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)
QUERIES = {n: q for n, q in contract.queries().items() if n in catalog.QUERIES}
ORACLES = {n: o for n, o in contract.oracle_sql().items() if n in catalog.QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() | set(catalog.WITHOUT_ORACLE)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in FORBIDDEN:
        assert operator not in plan, operator
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert compare(df.collect(), df.columns, result.fetchall(), columns) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 1500


def test_goldens(spark):
    row = (
        Samples(spark, "/root/testdata/sf0.001")
        .features()
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("is_high_risk").alias("high"),
            F.round(F.avg("composite_risk_score"), 9).alias("score"),
            F.count_if("thin_credit_file").alias("thin"),
            F.count_if("credit_risk_interaction").alias("interaction"),
            F.count_if("high_loan_burden_flag").alias("burden"),
            F.count_if("young_inexperienced").alias("young"),
            F.count_if("previous_loan_defaults_on_file").alias("defaults"),
            F.sum("homeownership_score").alias("ownership"),
            F.sum("intent_risk_score").alias("intent"),
            F.round(F.avg("affordability_ratio"), 9).alias("affordability"),
            F.count_if(F.col("person_age") == 100).alias("capped"),
        )
        .first()
        .asDict()
    )
    assert row == {
        "rows": 1500, "high": 603, "score": 0.303433333, "thin": 104, "interaction": 381,
        "burden": 806, "young": 17, "defaults": 508, "ownership": 2088, "intent": 3364,
        "affordability": 0.676880149, "capped": 2,
    }
