"""Splits, output rules, prompts and agreement against plain versions."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from creditmill.operators import evaluation, output_rules, splits


def test_splits_do_not_depend_on_partitioning(spark):
    rows = spark.range(5000).select(F.col("id"), splits.source_split(F.col("id"), 0.2, 0.1).alias("s"), splits.fold(F.col("id")).alias("f"))
    other = spark.range(5000).repartition(7).select(F.col("id"), splits.source_split(F.col("id"), 0.2, 0.1).alias("s"), splits.fold(F.col("id")).alias("f"))
    assert rows.exceptAll(other).isEmpty()
    counts = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    assert counts["test"] == pytest.approx(1000, rel=0.15) and counts["validation"] == pytest.approx(500, rel=0.2)
    assert sorted(r["f"] for r in rows.select("f").distinct().collect()) == [0, 1, 2, 3, 4]


def test_phrases_and_confidence(spark):
    df = spark.createDataFrame([("It is GUARANTEED, no RISK", 0.64), (None, 0.36), ("fine", 0.65), ("100% sure", None)], "t string, p double")
    found = df.select(output_rules.disallowed_phrases(F.col("t")), output_rules.low_confidence(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [(["guaranteed", "no risk"], True), ([], True), ([], False), (["100% sure"], None)]


def test_prompts(spark):
    chunks = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, "three"), ("b", 1, "x")], "q string, rank int, text string")
    made = {r["q"]: r["constructed_prompt"] for r in output_rules.prompts(chunks, "q", "rank", "text", F.lit("Why?"), 2).collect()}
    assert made == {"a": "[1] one\n[2] two\nWhy?", "b": "[1] x\nWhy?"}


def plain_alpha(units):
    units = [u for u in units if len(u) > 1]
    values = [x for u in units for x in u]
    n = len(values)
    within = sum(sum((a - b) ** 2 for a, b in permutations(u, 2)) / (len(u) - 1) for u in units) / n
    overall = sum((a - b) ** 2 for a, b in permutations(values, 2)) / (n * (n - 1))
    return 1 - within / overall


def test_krippendorff(spark):
    units = [[1, 2, 3], [2, 2], [5], [4, 5, 4, 4], [1, 1], []]
    rows = [(str(i), str(j), float(x)) for i, u in enumerate(units) for j, x in enumerate(u)] + [("5", "0", None)]
    df = spark.createDataFrame(rows, "i string, r string, x double")
    assert evaluation.krippendorff_alpha(df, "i", "r", "x").first()["alpha"] == pytest.approx(plain_alpha(units))
    same = df.withColumn("x", F.lit(2.0))
    assert evaluation.krippendorff_alpha(same, "i", "r", "x").first()["alpha"] is None
