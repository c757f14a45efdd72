"""What the operators share: Arrow mapping, checked broadcasts and scratch tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.session import stage

#: Rows that one Arrow batch holds, so that long texts do not add up in a worker.
BATCH_ROWS = 1000
#: Bytes that one Arrow batch holds about, for texts of megabytes.
BATCH_BYTES = 4 << 20
#: Estimated size up to which a join side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20

KINDS = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the rows and bytes of an Arrow batch and let local workers import this package.

    A cluster gets the package by ``--py-files`` or an installation, as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(
    df: DataFrame,
    column: str,
    fields: list[tuple[str, str]],
    task: Callable[[], Callable[[list], Iterable[Iterable]]],
) -> DataFrame:
    """Append ``fields`` computed from one column, batch by batch.

    ``task`` runs once per partition and returns a function from a batch's
    values to one sequence per field. A column of ``df`` that bears the name of
    a field is replaced.
    """
    kept = [name for name in df.columns if name not in {f for f, _ in fields}]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
        + [f"`{name}` {kind}" for name, kind in fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = task()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            made = [
                pa.array(cells, type=KINDS[kind])
                for (_, kind), cells in zip(fields, work(values))
            ]
            old = [batch.column(batch.schema.get_field_index(name)) for name in kept]
            yield pa.RecordBatch.from_arrays(old + made, names=kept + [f for f, _ in fields])

    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a frame may be broadcast: counts its rows."""
    return df.count() * row_bytes <= limit


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where the counted size allows it; otherwise the join shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


__all__ = [
    "BATCH_ROWS",
    "BROADCAST_BYTES",
    "add_columns",
    "broadcast_if_small",
    "prepare",
    "read_table",
    "small_enough",
    "stage",
]
