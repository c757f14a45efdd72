"""Load feature files as they arrive in a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from creditmill.config import LoadConfig
from creditmill.plans.load import load_features
from creditmill.sources.store import LoanStore


def load_arrivals(
    spark: SparkSession,
    landing: str,
    store: LoanStore,
    checkpoint: str,
    config: LoadConfig = LoadConfig(),
    schema: T.StructType | None = None,
    name: str = "arrivals",
) -> StreamingQuery:
    """Load all parquet feature files not loaded yet, then stop.

    Each micro-batch is one load batch named after its stream and its number, so a micro-batch
    that is replayed after a failure finds itself published and does nothing. The
    stream's id is the one that its checkpoint keeps: batches of another checkpoint never share a name.
    The files' own schema is used when none is given.
    """
    schema = schema or spark.read.parquet(landing).schema
    arriving = (
        spark.readStream.schema(schema)
        .parquet(landing)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )

    def stream_id() -> str:
        kept = spark.read.text(f"{str(checkpoint).rstrip('/')}/metadata").first()[0]
        return json.loads(kept)["id"]

    def load_batch(rows: DataFrame, number: int) -> None:
        batch_id = f"{name}-{stream_id()}-{number:08d}"
        if store.is_published(batch_id):
            return
        order = F.struct("_file", "_block", F.monotonically_increasing_id().alias("line"))
        ordered = rows.withColumn("row_order", order).drop("_file", "_block")
        load_features(ordered, store, config, batch_id=batch_id)

    return (
        arriving.writeStream.queryName(name)
        .foreachBatch(load_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
