"""Exact quantiles that stay distributed however many distinct values there are.

Spark's exact ``percentile`` gathers every distinct value of the column in one
task. Here the values are first counted where they lie (``value_frequencies``:
one pass, combined before the shuffle, so a value held by a third of all rows
costs nothing), and the counts are ranked by ranges of values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.operators.ranks import totals_before


def value_frequencies(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(name, value, n) for several numeric columns in a single pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("name"), column.cast("double").alias("value"))
            for name, column in columns.items()
        ]
    )
    return (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.name", "pair.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    frequencies: DataFrame, wanted: Mapping[str, float], ranges: int | None = None
) -> dict[str, float | None]:
    """Linear-interpolation quantile of each named column, exact.

    Only a count and the two neighbouring values of each quantile reach the driver.
    """
    found: dict[str, float | None] = dict.fromkeys(wanted)
    with totals_before(frequencies, "value", ["n"], ["name"], ranges) as ranked:
        sizes = {
            row["name"]: row["rows"]
            for row in ranked.groupBy("name").agg(F.sum("n").alias("rows")).collect()
        }
        first_rank, last_rank, fraction = F, F, {}
        for name in (n for n in wanted if n in sizes):
            position = wanted[name] * (sizes[name] - 1)
            first, last = math.floor(position), math.ceil(position)
            fraction[name] = position - first
            first_rank = first_rank.when(F.col("name") == name, F.lit(first))
            last_rank = last_rank.when(F.col("name") == name, F.lit(last))
        if not fraction:
            return found
        end = F.col("before_n") + F.col("n")
        neighbours = ranked.groupBy("name").agg(
            F.min(F.when(end > first_rank, F.col("value"))).alias("low"),
            F.min(F.when(end > last_rank, F.col("value"))).alias("high"),
        )
        for row in neighbours.collect():
            if row["name"] in fraction:
                low, high = row["low"], row["high"]
                # Equal neighbours, infinite ones among them, need no step.
                found[row["name"]] = low if low == high else low + (high - low) * fraction[row["name"]]
    return found
