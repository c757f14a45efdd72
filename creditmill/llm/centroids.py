"""Centroid clustering by Lloyd's rounds, sharded over dimensions, in exact integers.

Vectors are cut into blocks of columns and chunks of rows, and written once as a table bucketed by
both. A round is one job: tasks over blocks compute the partial squared distances of a chunk to
their centroid slices, the blocks of a chunk are added by key and the least sum is taken, and
the assignments go back to the blocks, whose sums make the next slice of each shard. Only
partial distances and assignments are shuffled; the blocks stay in their buckets. The driver
holds the centroids, clusters x dimensions numbers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.llm.common import stage
from creditmill.session import delete_folder, scratch_path

CLUSTERS = 8
DIMENSIONS = 64
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Columns of a block; a shard's slice has clusters x BLOCK numbers.
BLOCK = 16
#: Bytes of components in one bucket.
BUCKET_BYTES = 64 << 20
#: Largest scaled component: differences then fit 28 bits and their squared sums 64.
LARGEST = 1 << 27


def usable(vectors: DataFrame, embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Vectors of the right length whose components are all there and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(embedding) == dimensions) & finite)


def first_centroids(vectors: DataFrame, clusters: int, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The scaled vectors of the smallest id hashes, in their order: (at most clusters, dimensions).

    Rows that share an id are ordered by their components; rows without an id are no seeds.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), whole.alias("v")).orderBy("h", "v").limit(clusters)
    return np.array([r["v"] for r in rows.collect()], np.int64)


def cut_blocks(vectors: DataFrame, scale: int, dimensions: int, width: int) -> DataFrame:
    """(block, chunk, data, ids): scaled components of an Arrow batch, block by block; ids with the first block only."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(flat.reshape(-1, dimensions) * scale)
            if np.abs(whole).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST // scale}: its squared distances leave 64 bits")
            whole = whole.astype("<i4")
            cuts = range(0, dimensions, width)
            data = [np.ascontiguousarray(whole[:, at : at + width]).tobytes() for at in cuts]
            ids = batch.column(0)
            starts = pa.array([0] + [len(ids)] * len(data), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(data)), pa.int32()), pa.array([chunk] * len(data), pa.int64()), pa.array(data, pa.binary()), pa.ListArray.from_arrays(starts, ids)],
                names=["block", "chunk", "data", "ids"],
            )
            chunk += 1

    return vectors.mapInArrow(run, f"block int, chunk bigint, data binary, ids array<{kind}>")


def _bucketed(spark: SparkSession, blocks: DataFrame, count: int) -> tuple[str, str]:
    """Name and folder of a table of the blocks that joins by (block, chunk) without being shuffled again."""
    name, path = f"lloyd_{uuid.uuid4().hex}", scratch_path(spark, "lloyd-blocks")
    dealt = blocks.repartition(count, "block", "chunk")
    dealt.write.bucketBy(count, "block", "chunk").option("path", path).saveAsTable(name)
    return name, path


def _slices(centroids: np.ndarray, width: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(centroids[:, at : at + width]) for at in range(0, centroids.shape[1], width)]


def partial_distances(data: bytes, part: np.ndarray) -> np.ndarray:
    """(vectors, clusters): squared distances over the columns of one block."""
    own = np.frombuffer(data, "<i4").reshape(-1, part.shape[1]).astype(np.int64)
    out = np.empty((len(own), len(part)), np.int64)
    for k, centroid in enumerate(part):
        gap = own - centroid
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Four bytes a number where all fit, else eight; the length tells which."""
    return numbers.astype("<u4" if numbers.max(initial=0) < 1 << 32 else "<i8").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * count else "<i8").astype(np.int64)


def assign(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(chunk, labels, distances) of every chunk: the nearest centroid, of equal ones the smaller number."""
    slices, clusters = _slices(centroids, width), len(centroids)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [partial_distances(d, slices[b]) for b, d in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            sizes = pa.array([len(m) for m in made], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), sizes, pa.array(map(_packed, made), pa.binary())], names=["chunk", "n", "part"])

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        total = np.zeros(n * clusters, np.int64)
        for part in table.column("part").to_pylist():
            total += _unpacked(part, n * clusters)
        total = total.reshape(n, clusters)
        label = total.argmin(axis=1)
        least = total[np.arange(n), label]
        return pa.table(
            [table.column("chunk").slice(0, 1), pa.array([label.astype("<i4").tobytes()], pa.binary()), pa.array([least.astype("<i8").tobytes()], pa.binary())],
            names=["chunk", "labels", "distances"],
        )

    parts = blocks.select("block", "chunk", "data").mapInArrow(partials, "chunk bigint, n int, part binary")
    return parts.groupBy("chunk").applyInArrow(add, "chunk bigint, labels binary, distances binary")


def next_centroids(blocks: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The floored means of the assigned vectors, slice by slice; a centroid without vectors stays."""
    clusters, dimensions = centroids.shape
    count = -(-dimensions // width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        sizes: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own, at = min(width, dimensions - block * width), np.frombuffer(label, "<i4")
                rows = np.frombuffer(data, "<i4").reshape(-1, own)
                total = totals.setdefault(block, np.zeros((clusters, own), np.int64))
                size = sizes.setdefault(block, np.zeros(clusters, np.int64))
                np.add.at(total, at, rows)
                size += np.bincount(at, minlength=clusters)
        for block, total in totals.items():
            k, place = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, block, np.int32)), pa.array(k.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.ravel()), pa.array(sizes[block][k])],
                names=["block", "cluster", "place", "total", "n"],
            )

    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    labels = assigned.select("chunk", "labels", every.alias("block"))
    met = blocks.select("block", "chunk", "data").join(labels, ["block", "chunk"]).select("block", "data", "labels")
    parts = met.mapInArrow(sums, "block int, cluster int, place int, total bigint, n bigint")
    # Sums are decimals, as those of a whole cluster may leave 64 bits.
    slices = parts.groupBy("block", "cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")
    )
    floored = F.expr("(total - pmod(total, n)) div n").cast("bigint")
    moved = centroids.copy()
    for r in slices.where("n > 0").select("block", "cluster", "place", floored.alias("value")).collect():
        moved[r["cluster"], r["block"] * width + r["place"]] = r["value"]
    return moved


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per usable vector.

    Components become integers floor(scale * x). Vectors of another length, null ones and such with
    a null or non-finite component are left out. Repeated rows count each; rows without
    an id are clustered but are no first centroids. With fewer usable vectors than clusters there are as many
    centroids as vectors with an id; with none, or an empty table, the result is empty. Ties go
    to the smaller cluster. Components beyond LARGEST / scale are refused by an error.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")), "embedding", dimensions)
    centroids = first_centroids(rows, clusters, scale, seed)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    count = max(spark.sparkContext.defaultParallelism, -(-rows.count() * dimensions * 4 // BUCKET_BYTES))
    name, path = _bucketed(spark, cut_blocks(rows, scale, dimensions, block), count)
    try:
        blocks = spark.table(name)
        for _ in range(rounds):
            centroids = next_centroids(blocks, assign(blocks, centroids, block), centroids, block)
        ids = blocks.where("block = 0").select("chunk", "ids")
        flat = ids.join(assign(blocks, centroids, block), "chunk").select("ids", "labels", "distances")
        done = stage(flat.mapInArrow(_unfold, schema), "assigned")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_folder(spark, path)
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = int(sum(r["s"] for r in sums))
    named = [
        (r["cluster"], int(r["s"]), whole, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in sums
    ]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(told), "cluster").select("vec_id", *done.columns[1:], *told.columns[1:])


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector of each chunk."""
    for batch in batches:
        labels = b"".join(batch.column(1).to_pylist())
        distances = b"".join(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).flatten(), pa.array(np.frombuffer(labels, "<i4")), pa.array(np.frombuffer(distances, "<i8"))],
            names=["vec_id", "cluster", "distance"],
        )


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows in DuckDB, every round a table of its own."""
    steps = [
        f"""own AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM own WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters}) AS s)""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT row_no, min(struct_pack(d := d, k := cluster)) AS best FROM (
    SELECT row_no, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM own, c{i}) AS t
  GROUP BY row_no)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(x ORDER BY place) AS c FROM (
    SELECT cluster, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
      SELECT best.k AS cluster, place, CAST(sum(v[place]) AS BIGINT) AS s, count(*) AS n
      FROM a{i} JOIN own USING (row_no), (SELECT unnest(range(1, {dimensions + 1})) AS place) AS p GROUP BY ALL) AS t) AS u
  GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
            )
    return f"""WITH {",".join(chr(10) + s for s in steps)}
SELECT vec_id, best.k AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN own USING (row_no) JOIN c{rounds} ON cluster = best.k"""
