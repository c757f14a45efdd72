"""Tables kept as parquet, one folder per load batch, visible once published.

A batch writes its tables first and one manifest row per table last, in a
single write. Readers take only published batches, so a load that fails half
way is never seen, and running it again under the same batch id replaces it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.operators.quality import has_duplicate_keys, orphans, row_violations
from creditmill.session import delete_folder
from creditmill.sources.tables import TABLES, Table

_MANIFEST = "batch_id string, table_name string, row_count bigint, published_at timestamp"


class ConstraintError(ValueError):
    """Rows break a constraint of their table; nothing was written."""


class BatchExistsError(ValueError):
    """The batch was published before."""


class LoanStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = str(root).rstrip("/")

    def _read_or_empty(self, paths: list[str], schema) -> DataFrame:
        try:
            if paths:
                return self.spark.read.schema(schema).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._read_or_empty([f"{self.root}/manifest"], _MANIFEST)

    def _published(self, name: str) -> DataFrame:
        """Ids of the published batches of a table."""
        return self.manifest().where(F.col("table_name") == name).select("batch_id").distinct()

    def is_published(self, batch_id: str, name: str | None = None) -> bool:
        rows = self.manifest() if name is None else self._published(name)
        return not rows.where(F.col("batch_id") == batch_id).isEmpty()

    def path(self, name: str, batch_id: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError("a batch id has letters, digits, '.', '_' and '-' only")
        return f"{self.root}/{name}/batch_id={batch_id}"

    def read(self, name: str) -> DataFrame:
        """All published rows of a table; an empty frame before the first load.

        Batches are folders of the table and joined with the manifest, so
        their number never passes through the driver.
        """
        schema = T.StructType([*TABLES[name].schema, T.StructField("batch_id", T.StringType())])
        rows = self._read_or_empty([f"{self.root}/{name}"], schema)
        return rows.join(self._published(name), "batch_id", "left_semi").select(*TABLES[name].columns)

    def current(self, name: str) -> DataFrame:
        """``read`` for lookups: a plain scan of the published folders, so that a key reaches the files' filters.

        The driver holds one short id per load.
        """
        return self.read_batches(name, self.batches(name))

    def read_batches(self, name: str, batch_ids: Iterable[str]) -> DataFrame:
        """The rows of some batches of a table."""
        paths = [self.path(name, batch_id) for batch_id in sorted(batch_ids)]
        return self._read_or_empty(paths, TABLES[name].schema).select(*TABLES[name].columns)

    def create_tables(self) -> None:
        """Publish an empty first batch of every table that has none."""
        absent = [name for name in TABLES if self._published(name).isEmpty()]
        for name in absent:
            empty = self.spark.createDataFrame([], TABLES[name].schema)
            self.write(name, empty, "created")
        if absent:
            self.publish("created", dict.fromkeys(absent, 0))

    def write(self, name: str, rows: DataFrame, batch_id: str) -> int:
        """Write a batch of a table without publishing it; returns the rows written.

        A batch that was published is never overwritten, one that was not is replaced.
        """
        if self.is_published(batch_id, name):
            raise BatchExistsError(batch_id)
        table, path = TABLES[name], self.path(name, batch_id)
        columns = [F.col(f.name).cast(f.type).alias(f.name) for f in table.fields]
        # Keys are hashes, scattered over all row groups; bloom filters let a lookup skip most of them.
        looked_up = {"id", *(column for column, _ in table.references)}
        options = {f"parquet.bloom.filter.enabled#{column}": "true" for column in sorted(looked_up)}
        rows.select(*columns).write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(table.schema).parquet(path).count()

    def publish(
        self, batch_id: str, row_counts: Mapping[str, int], run_ts: datetime | None = None
    ) -> None:
        when = F.current_timestamp() if run_ts is None else F.lit(run_ts)
        rows = self.spark.createDataFrame(
            [(batch_id, name, count) for name, count in row_counts.items()],
            "batch_id string, table_name string, row_count bigint",
        )
        rows.withColumn("published_at", when).coalesce(1).write.mode("append").parquet(
            f"{self.root}/manifest"
        )

    def batches(self, name: str) -> set[str]:
        """Ids of the published batches of a table, one per load."""
        return {row["batch_id"] for row in self._published(name).collect()}

    @contextmanager
    def publishing(self, batch_id: str, wait: float = 600.0) -> Iterator[None]:
        """One publisher at a time: a file that only one can create, deleted at the end.

        A load checks what others have published since its plan and publishes inside. A process that dies here leaves
        the file, which names its batch; later loads then fail after ``wait`` seconds and say which file to remove.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_publishing")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + wait
        while True:
            try:
                out = files.create(path, False)
                break
            except Py4JJavaError as error:
                if not files.exists(path) and time.monotonic() > until:
                    raise
                if time.monotonic() > until:
                    raise TimeoutError(f"another load has been publishing for {wait:.0f} s; if it is gone, delete {path.toString()}") from error
                time.sleep(0.2)
        try:
            out.write(bytearray(batch_id.encode()))
            out.close()
            yield
        finally:
            files.delete(path, False)

    def append(
        self, name: str, rows: DataFrame, batch_id: str, run_ts: datetime | None = None
    ) -> DataFrame:
        """Add key and time stamp, check every constraint, write and publish.

        Columns the input lacks are null. Returns the stored rows. The input is evaluated
        once, into the batch's folder; the checks read that copy, and readers see it once it is published.
        """
        if self.is_published(batch_id):
            raise BatchExistsError(batch_id)
        table, run_ts = TABLES[name], run_ts or datetime.now(timezone.utc)
        count = self.write(name, with_defaults(rows, table, run_ts), batch_id)
        written = self.spark.read.schema(table.schema).parquet(self.path(name, batch_id))
        try:
            self._check(table, written)
        except ConstraintError:
            delete_folder(self.spark, self.path(name, batch_id))
            raise
        self.publish(batch_id, {name: count}, run_ts)
        return written

    def create_applicants(self, rows: DataFrame, batch_id: str, run_ts=None) -> DataFrame:
        return self.append("loan_applicants", rows, batch_id, run_ts)

    def create_features(self, rows: DataFrame, batch_id: str, run_ts=None) -> DataFrame:
        return self.append("engineered_features", rows, batch_id, run_ts)

    def create_models(self, rows: DataFrame, batch_id: str, run_ts=None) -> DataFrame:
        return self.append("ml_models", rows, batch_id, run_ts)

    def create_predictions(self, rows: DataFrame, batch_id: str, run_ts=None) -> DataFrame:
        return self.append("model_predictions", rows, batch_id, run_ts)

    def create_explanations(self, rows: DataFrame, batch_id: str, run_ts=None) -> DataFrame:
        return self.append("rag_explanations", rows, batch_id, run_ts)

    def _check(self, table: Table, rows: DataFrame) -> None:
        broken = rows.select(F.explode(row_violations(table)).alias("rule")).distinct()
        problems = [row["rule"] for row in broken.collect()]
        stored = None if self._published(table.name).isEmpty() else self.read(table.name)
        for keys in (("id",), *table.unique):
            incoming = both = rows.select(*keys)
            if stored is not None:
                both = incoming.unionByName(stored.select(*keys).join(incoming, list(keys), "left_semi"))
            if has_duplicate_keys(both, keys):
                problems.append(f"{', '.join(keys)}: not unique")
        for column, parent in table.references:
            if not orphans(rows, column, self.read(parent)).isEmpty():
                problems.append(f"{column}: not in {parent}")
        if problems:
            raise ConstraintError(f"{table.name}: {'; '.join(sorted(problems))}")


def natural_id(table: Table):
    """Key of a row: a hash of its natural key, equal whenever it is recomputed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.natural_key]
    return F.sha2(F.concat_ws("|", F.lit(table.name), *parts), 256)


def with_defaults(rows: DataFrame, table: Table, run_ts: datetime | None = None) -> DataFrame:
    """Cast to the table's types and fill in time stamp, defaults and key."""
    unknown = sorted(set(rows.columns) - set(table.columns))
    if unknown:
        raise ValueError(f"{table.name} has no column {', '.join(unknown)}")
    values = {}
    for f in table.fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.name == table.stamp:
            value = F.coalesce(value, F.current_timestamp() if run_ts is None else F.lit(run_ts))
        elif f.name in ("is_from_scratch", "is_champion"):
            value = F.coalesce(value, F.lit(False))
        elif f.name == "retriever_type":
            value = F.coalesce(value, F.lit("tfidf"))
        values[f.name] = value.cast(f.type)
    typed = rows.select(*[values[name].alias(name) for name in table.columns])
    if "id" in rows.columns:
        return typed.withColumn("id", F.coalesce("id", natural_id(table)))
    return typed.withColumn("id", natural_id(table))
