"""Running totals over a value's order that no single task has to hold.

A frequency table is dealt to tasks by ranges of the value. Each range is
totalled, the totals of the earlier ranges are added up (one row per range), and
the values of a range are added up inside it. The ranged table is written
once, since two evaluations may cut the ranges differently.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditmill.session import staged


@contextmanager
def totals_before(
    frequencies: DataFrame,
    value: str,
    amounts: Sequence[str],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> Iterator[DataFrame]:
    """``frequencies`` with ``before_<amount>``: each amount's sum over smaller values of the group.

    Values are distinct within their group. The frame lives as long as the context.
    """
    order = [*group, value]
    dealt = (
        frequencies.repartitionByRange(*order)
        if ranges is None
        else frequencies.repartitionByRange(ranges, *order)
    )
    with staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges") as dealt:
        earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        smaller = (
            Window.partitionBy("_range", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        )
        sums = dealt.groupBy("_range", *group).agg(*[F.sum(a).alias(a) for a in amounts])
        offsets = sums.select(
            "_range", *group, *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_{a}") for a in amounts]
        )
        yield dealt.join(offsets, ["_range", *group]).select(
            *frequencies.columns,
            *[
                (F.col(f"_{a}") + F.coalesce(F.sum(a).over(smaller), F.lit(0))).alias(f"before_{a}")
                for a in amounts
            ],
        )
