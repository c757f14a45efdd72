"""Idempotent load of feature rows into applicants and engineered features."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.config import LoadConfig
from creditmill.operators.coercion import (
    coerce_loans,
    explain_rejects,
    fingerprint_id,
    given_of_rejects,
    stored_columns,
)
from creditmill.operators.dedup import (
    KEYS,
    distinct_fingerprints,
    new_occurrences,
)
from creditmill.operators.quality import rule_counts
from creditmill.session import delete_folder, staged
from creditmill.sources.store import BatchExistsError, LoanStore, natural_id
from creditmill.sources.tables import APPLICANTS, FEATURES

_STORABLE = "storable"


class RejectedRowsError(ValueError):
    """Strict mode: the batch holds rows that cannot be stored; nothing was written."""


@dataclass(frozen=True)
class LoadPlan:
    incoming: DataFrame
    rejects: DataFrame
    new_rows: DataFrame


@dataclass(frozen=True)
class LoadResult:
    batch_id: str
    total: int
    inserted: int
    skipped: int
    rejected: int
    dry_run: bool


def order_column(df: DataFrame) -> str:
    for name in ("row_no", "row_order"):
        if name in df.columns:
            return name
    raise ValueError("the load needs the row order: a row_no or row_order column")


def plan_load(coerced: DataFrame, stored: DataFrame) -> LoadPlan:
    """Split coerced rows: what cannot be stored, and first occurrences not stored yet.

    Fingerprints are compared as stored, that is after rounding, on both sides.
    """
    order = order_column(coerced)
    valid = stored_columns(coerced.where(_STORABLE), order)
    new_rows = new_occurrences(valid, stored, order).withColumn("applicant_id", fingerprint_id())
    return LoadPlan(coerced, explain_rejects(coerced.where(~F.col(_STORABLE))), new_rows)


def load_counters(plan: LoadPlan, stored: DataFrame) -> DataFrame:
    """One row: incoming, rejected, both kinds of skipped rows, inserted.

    Rows are counted per fingerprint before the shuffle, so the batch is read
    once and a repeated fingerprint weighs as much as any other.
    """
    groups = plan.incoming.groupBy(*KEYS, F.col(_STORABLE).alias("valid")).agg(F.count(F.lit(1)).alias("n"))
    known = distinct_fingerprints(stored).withColumn("known", F.lit(True))
    counted = groups.join(known, KEYS, "left")
    valid, is_known = F.col("valid"), F.col("known").isNotNull()
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counted.agg(
        total.alias("incoming"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("skipped_in_batch"),
        F.count_if(valid & is_known).alias("skipped_stored"),
        F.count_if(valid & ~is_known).alias("inserted"),
    )


def chunk_counters(plan: LoadPlan, chunk_size: int = LoadConfig.chunk_size) -> DataFrame:
    """The same counts per chunk of ``chunk_size`` consecutive row numbers."""
    chunk = F.floor(F.col("row_no") / chunk_size).alias("chunk_no")
    tagged = plan.incoming.select(
        chunk, F.lit(1).alias("total"), (~F.col(_STORABLE)).cast("int").alias("rejected"), F.lit(0).alias("inserted")
    ).unionByName(
        plan.new_rows.select(
            chunk, F.lit(0).alias("total"), F.lit(0).alias("rejected"), F.lit(1).alias("inserted")
        )
    )
    return (
        tagged.groupBy("chunk_no")
        .agg(*[F.sum(name).alias(name) for name in ("total", "rejected", "inserted")])
        .withColumn("skipped", F.col("total") - F.col("rejected") - F.col("inserted"))
    )


def applicant_rows(new_rows: DataFrame, run_ts: datetime) -> DataFrame:
    return new_rows.withColumns(
        {"id": F.col("applicant_id"), "created_at": F.lit(run_ts)}
    ).select(*APPLICANTS.columns)


def feature_rows(new_rows: DataFrame, run_ts: datetime) -> DataFrame:
    return new_rows.withColumns(
        {"id": natural_id(FEATURES), "computed_at": F.lit(run_ts)}
    ).select(*FEATURES.columns)


def load_features(
    features: DataFrame,
    store: LoanStore,
    config: LoadConfig = LoadConfig(),
    batch_id: str | None = None,
    run_ts: datetime | None = None,
) -> LoadResult:
    """Load a batch: both tables or neither.

    Loading the same rows again inserts nothing. A dry run does everything but
    write. In strict mode a row that cannot be stored stops the load before
    anything is written; otherwise such rows go to ``rejects`` with the reasons.

    The input is read and coerced once, into a scratch copy; the rows to insert are
    found from its keys and written once, and both tables are plain copies of them.
    """
    run_ts = run_ts or datetime.now(timezone.utc)
    batch_id = batch_id or f"load-{run_ts:%Y%m%dT%H%M%S%f}"
    if store.is_published(batch_id):
        raise BatchExistsError(batch_id)
    order_column(features)
    known = store.batches(APPLICANTS.name)
    with staged(given_of_rejects(coerce_loans(features, config)), f"load-{batch_id}") as coerced:
        plan = plan_load(coerced, store.read(APPLICANTS.name))
        totals = coerced.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(~F.col(_STORABLE)).alias("rejected")
        ).first()
        total, rejected = totals["total"], totals["rejected"]
        if rejected and config.strict:
            reasons = rule_counts(plan.rejects).orderBy("rule").collect()
            listed = ", ".join(f"{row['rule']} ({row['row_count']})" for row in reasons)
            raise RejectedRowsError(f"{rejected} of {total} rows cannot be stored: {listed}")
        if config.dry_run:
            inserted = plan.new_rows.count()
        else:
            if rejected:
                plan.rejects.write.mode("overwrite").parquet(store.path("rejects", batch_id))
            else:  # what an earlier, failed attempt may have left
                delete_folder(store.spark, store.path("rejects", batch_id))
            inserted = store_new_rows(plan.new_rows, store, batch_id, run_ts, known, rejected)
    return LoadResult(
        batch_id, total, inserted, total - rejected - inserted, rejected, config.dry_run
    )


def store_new_rows(
    new_rows: DataFrame, store: LoanStore, batch_id: str, run_ts: datetime, known: set[str], rejected: int = 0
) -> int:
    """Write both tables and publish them together; returns the rows inserted.

    ``known`` are the batches that ``new_rows`` were compared with. What other loads have published since is compared
    again while nobody else can publish, so of two loads started together each fingerprint is inserted once.
    """

    def write(rows: DataFrame) -> int:
        count = store.write(APPLICANTS.name, applicant_rows(rows, run_ts), batch_id)
        store.write(FEATURES.name, feature_rows(rows, run_ts), batch_id)
        return count

    with staged(new_rows, f"new-{batch_id}") as rows:
        inserted = write(rows)
        with store.publishing(batch_id):
            if store.is_published(batch_id):
                raise BatchExistsError(batch_id)
            later = store.batches(APPLICANTS.name) - known
            if later:
                others = store.read_batches(APPLICANTS.name, later).select(*KEYS)
                inserted = write(rows.join(others, KEYS, "left_anti").select(*rows.columns))
            counts = {APPLICANTS.name: inserted, FEATURES.name: inserted, "rejects": rejected}
            store.publish(batch_id, counts, run_ts)
    return inserted
