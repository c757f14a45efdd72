"""CSV and parquet files of loan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditmill.config import RAW_COLUMNS
from creditmill.operators.cleaning import blank_missing_tokens


class MissingColumnsError(ValueError):
    """The input lacks columns the job needs."""


def require_columns(df: DataFrame, required=RAW_COLUMNS) -> DataFrame:
    """Fail before any job runs when a required column is absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"missing required columns: {', '.join(missing)}")
    return df


def file_order() -> Column:
    """Sort key giving the order of rows in the files read.

    One task reads a block of a file from front to back, so (file, block start,
    id within the task) orders rows as the files do, however they were split.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def read_csv(
    spark: SparkSession, path, with_order: bool = False, multi_line: bool = False
) -> DataFrame:
    """A CSV file or folder with a header, every column as text.

    With ``enforceSchema`` off, a file of the folder whose header differs from
    the first one is an error; otherwise its values would be bound by position
    to the wrong columns. ``multi_line`` keeps line breaks inside quotes; such a
    file cannot be split, so it is off unless the files need it.
    """
    options = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line}
    df = spark.read.options(**options).csv(str(path))
    if with_order:
        df = df.withColumn("row_order", file_order())
    return blank_missing_tokens(df)


def load_raw(spark: SparkSession, path, with_order: bool = False) -> DataFrame:
    """Raw loan applications by column name; other columns are left out."""
    df = require_columns(read_csv(spark, path, with_order))
    return df.select(*RAW_COLUMNS, *(["row_order"] if with_order else []))


def read_features(spark: SparkSession, path, fmt: str = "parquet", with_order: bool = False):
    """A feature table written by ``write_features``, in either format."""
    if fmt == "csv":
        return read_csv(spark, path, with_order)
    df = spark.read.format(fmt).load(str(path))
    return df.withColumn("row_order", file_order()) if with_order else df


def write_features(df: DataFrame, path, fmt: str = "parquet") -> None:
    """Overwrite the feature table at ``path``; missing parent folders are made."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(str(path), header=True, escape='"')
    else:
        writer.format(fmt).save(str(path))


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``row_no``, the 0-based position in file order, to a ``row_order`` frame.

    Each block is numbered on its own and shifted by the rows of the blocks
    before it, so no task sees more than one block; only the block list (one row
    per scan block) is summed up in one place.
    """
    block = [F.col("row_order.file").alias("file"), F.col("row_order.block").alias("block")]
    blocks = df.groupBy(*block).agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_order.line").alias("first_line")
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return (
        df.withColumns(dict(zip(("file", "block"), block)))
        .join(starts.select("file", "block", "start", "first_line"), ["file", "block"])
        .withColumn("row_no", F.col("start") + F.col("row_order.line") - F.col("first_line"))
        .drop("file", "block", "start", "first_line")
    )
