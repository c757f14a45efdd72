"""Relational databases through Spark's JDBC source. Parquet is the default target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str = "org.postgresql.Driver",
    batch_rows: int = 10_000,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "driver": driver}
    options["fetchsize"] = options["batchsize"] = str(batch_rows)
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def read_jdbc(
    spark: SparkSession,
    options: dict[str, str],
    partition_column: str,
    lower: str | int,
    upper: str | int,
    partitions: int,
) -> DataFrame:
    """Read a table in parallel by ranges of a column."""
    return (
        spark.read.format("jdbc")
        .options(**options)
        .options(
            partitionColumn=partition_column,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
        .load()
    )


def write_jdbc(df: DataFrame, options: dict[str, str], connections: int = 8) -> None:
    """Append rows over a limited number of connections; what is before keeps its own tasks."""
    df.repartition(connections).write.format("jdbc").options(**options).mode("append").save()
