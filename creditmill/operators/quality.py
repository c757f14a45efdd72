"""Table constraints as data-quality checks.

Row rules are evaluated together in one pass without a shuffle. Key checks
count per key before the shuffle, so a key repeated by a third of all rows
reaches its reducer as one row per input task. Every check returns rows; no
rows means the constraint holds.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.sources.tables import Table


def row_violations(table: Table, skip: Collection[str] = ()) -> Column:
    """Array of "<column>: <rule>" broken by a row."""
    rules = []
    for f in table.fields:
        if f.name in skip:
            continue
        value = F.col(f.name)
        if f.required:
            rules.append(F.when(value.isNull(), F.lit(f"{f.name}: required")))
        if f.domain is not None:
            rules.append(F.when(~value.isin(*f.domain), F.lit(f"{f.name}: not in domain")))
        if f.max_length is not None:
            rules.append(F.when(F.length(value) > f.max_length, F.lit(f"{f.name}: too long")))
        if f.between is not None:
            rules.append(F.when(~value.between(*f.between), F.lit(f"{f.name}: out of range")))
    return F.filter(F.array(*rules), lambda rule: rule.isNotNull())


def rule_counts(df: DataFrame, violations: str = "violations") -> DataFrame:
    """Rows per broken rule."""
    return (
        df.select(F.explode(violations).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def missing_values(df: DataFrame, table: Table) -> DataFrame:
    """Null counts of the required columns, one row per column that has any."""
    required = [f.name for f in table.fields if f.required and f.name in df.columns]
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in required])
    return counts.unpivot([], required, "column_name", "missing").where("missing > 0")


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys held by more than one row. As in SQL, a key with a null never clashes."""
    keys = list(keys)
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
    )


def has_duplicate_keys(df: DataFrame, keys: Iterable[str]) -> bool:
    """Whether ``duplicate_keys`` gives any row; the keys themselves are shuffled only if two of their hashes are equal."""
    keys = list(keys)
    hashes = df.dropna(subset=keys).select(F.xxhash64(*keys).alias("hash"))
    if duplicate_keys(hashes, ["hash"]).isEmpty():
        return False
    return not duplicate_keys(df, keys).isEmpty()


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Foreign keys without a parent, with the number of rows that use them.

    Child keys are reduced to one row each before the join, so the join is never
    skewed by a parent that most rows point to.
    """
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    parents = parent.select(F.col(parent_key).alias(column))
    return used.join(parents, column, "left_anti")


def outside_domain(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    """Values of a code column that its domain does not list, with their counts."""
    return (
        df.where(~F.col(column).isin(*domain))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def does_not_fit(df: DataFrame, column: str, decimal_type: str) -> DataFrame:
    """Rows whose number cannot be stored in the given decimal type."""
    wide = F.col(column).try_cast("decimal(38,10)")
    return df.where(F.col(column).isNotNull() & wide.try_cast(decimal_type).isNull())


def too_long(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.where(F.length(column) > limit)


def off_scale(df: DataFrame, columns: Iterable[str], low: int = 1, high: int = 5) -> DataFrame:
    """Rows with a rubric score outside the scale."""
    columns = list(columns)
    outside = ~F.col(columns[0]).between(low, high)
    for name in columns[1:]:
        outside = outside | ~F.col(name).between(low, high)
    return df.where(outside)


def champion_count(models: DataFrame) -> DataFrame:
    """How many models are marked champion, and whether that is at most one."""
    champions = F.count_if("is_champion")
    return models.agg(
        champions.alias("champions"), (champions <= 1).alias("at_most_one")
    )
