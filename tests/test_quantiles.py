"""Exact quantiles, over any number of value ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditmill.operators.quantiles import exact_quantiles, value_frequencies


def quantile(df, q, ranges):
    frequencies = value_frequencies(df, {"x": F.col("x")})
    return exact_quantiles(frequencies, {"x": q}, ranges)["x"]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_against_numpy(spark, q, ranges):
    values = np.random.default_rng(7).normal(size=3001).round(3)
    values[::3] = 0.125  # a third of all rows share one value
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(6)
    assert quantile(df, q, ranges) == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_neighbours_in_different_ranges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(2000)], "x double")
    assert quantile(df, 0.5, 1) == 999.5
    assert quantile(df, 0.5, 200) == 999.5


def test_small_cases(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "x double")
    assert quantile(df, 0.75, 10) == 3.25
    assert quantile(df, 0.5, 10) == 2.5
    assert quantile(df.where("x is null"), 0.5, 10) is None


def test_several_columns_in_one_pass(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"))
    frequencies = value_frequencies(df, {"a": F.col("a"), "b": F.col("b")})
    assert exact_quantiles(frequencies, {"a": 0.5, "b": 0.25}, 50) == {"a": 501.0, "b": 502.0}


def test_infinite_neighbours(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (inf,), (inf,), (inf,)], "x double")
    assert quantile(df, 0.5, 3) == inf
    assert quantile(df, 0.0, 3) == 1.0
