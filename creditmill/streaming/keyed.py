"""First occurrences over micro-batches, with the fingerprints seen so far in Spark's state store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from creditmill.config import LoadConfig
from creditmill.operators.coercion import coerce_loans, fingerprint_id, stored_columns
from creditmill.operators.dedup import KEYS
from creditmill.plans.load import store_new_rows
from creditmill.sources.store import LoanStore
from creditmill.sources.tables import APPLICANTS

def first_arrivals(coerced: DataFrame, order: list[str]) -> DataFrame:
    """The earliest row of each fingerprint that no earlier micro-batch had.

    ``coerced`` is a stream. Per fingerprint the state keeps the first row and when it came; rows are
    combined per task before the shuffle. A fingerprint that comes again updates its state without changing it,
    and is told from a new one by the time of its micro-batch, which a replay keeps.
    """
    values = [c for c in coerced.columns if c not in {*KEYS, *order}]
    timed = coerced.withColumn("_came", F.current_timestamp())
    first = timed.groupBy(*KEYS).agg(F.min_by(F.struct("_came", *values), F.struct("_came", *order)).alias("first"))
    fresh = first.where(F.col("first._came") == F.current_timestamp())
    return fresh.select(*KEYS, *[F.col(f"first.{c}").alias(c) for c in values])


def load_first_arrivals(
    spark: SparkSession,
    landing: str,
    store: LoanStore,
    checkpoint: str,
    config: LoadConfig = LoadConfig(),
    schema: T.StructType | None = None,
    name: str = "first-arrivals",
) -> StreamingQuery:
    """Load the first occurrences among all parquet feature files not seen yet, then stop.

    The stored tables are not read again: the fingerprints live in the state of the checkpoint, which a restarted
    stream takes up. ``build_session`` keeps it in RocksDB; other sessions choose their provider themselves. Files are taken as they arrive; inside a micro-batch the order is file time, file and row. Each
    micro-batch is a batch of the store under its own number, so a replay finds it published and does nothing. Rows that
    cannot be stored are passed over.
    """
    schema = schema or spark.read.parquet(landing).schema
    order = {"_time": "file_modification_time", "_file": "file_path", "_row": "row_index"}
    arriving = spark.readStream.schema(schema).parquet(landing)
    ordered = arriving.select(*schema.names, *[F.col(f"_metadata.{field}").alias(c) for c, field in order.items()])
    valid = stored_columns(coerce_loans(ordered, config).where("storable"), *order)

    def store_batch(rows: DataFrame, number: int) -> None:
        batch_id = f"{name}-{number:08d}"
        if store.is_published(batch_id):
            # A replay: nothing is written, but the state of this micro-batch has to be.
            rows.write.format("noop").mode("overwrite").save()
            return
        new = rows.withColumn("applicant_id", fingerprint_id())
        store_new_rows(new, store, batch_id, datetime.now(timezone.utc), store.batches(APPLICANTS.name))

    return (
        first_arrivals(valid, list(order))
        .writeStream.queryName(name)
        .outputMode("update")
        .foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
