"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution picks partition counts, broadcasts by measured size and
# splits skewed join partitions; the rest bounds the size of one task's input.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # State of streams beyond the memory of executors.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # The feature projection compiles to one long method, and HotSpot leaves
    # methods above 8000 bytes of bytecode interpreted; with this limit Spark
    # evaluates such a projection in smaller compiled pieces instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "creditmill", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the method-size limit to a session built elsewhere."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, RECOMMENDED[name])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="creditmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """The frame with a broadcast hint if it has so few rows, which are counted here, and as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written copy.

    Later jobs read only the columns they need from it, and a lost executor
    costs no recomputation.
    """
    return _written(df, scratch_path(df.sparkSession, label))


@contextmanager
def staged(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> Iterator[DataFrame]:
    """``stage`` for the length of a job, in folders of the columns ``by``; the copy is deleted at the end."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        yield _written(df, path, by)
    finally:
        delete_folder(spark, path)


def stage_in_turn(make: Callable[[DataFrame], DataFrame], slices: Iterable[DataFrame], label: str) -> DataFrame:
    """One written table of what ``make`` gives for each slice, one slice after the other.

    The shuffle files of a slice are deleted once it is written, so those of one slice are on disk at a time.
    """
    for number, rows in enumerate(slices):
        spark = rows.sparkSession
        if not number:
            path = scratch_path(spark, label)
        with _shuffle_files_deleted(spark):
            made = make(rows)
            made.write.mode("append").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


@contextmanager
def _shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """Every query started inside deletes its shuffle files when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
