"""Near-duplicate embeddings: one small-world graph per shard, every shard asked for every vector.

Equal vectors form one class, of which only one representative is indexed. Shards are cut by a hash of the
representative and are bounded in rows. A task holds the graph of one shard and streams
a slice of all representatives past it. Its beam is widened until an audit passes: planted
neighbours at the threshold must be found, and for a sample of the real queries the
links found by brute force. A query whose links fill a good part of its beam is asked again
with a wider one, or compared with the whole shard where that is cheaper. Links count only where the cosine in double precision reaches the threshold.
A task returns counts per query and spanning links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import stage
from creditmill.llm.components import connected_components
from creditmill.llm.hnsw import LINKS, Graph

THRESHOLD = 0.9
#: Bytes that the double vectors of a shard take and rows that it holds (in expectation), and the fewest shards.
SHARD_BYTES = 128 << 20
SHARD_ROWS = 65_536
SHARDS = 4
#: Share of a shard from which on a beam gives way to comparing the query with all of the shard.
DENSE = 0.125
#: The same for a beam wider than the audited one: a place of a beam takes about as long as 1,000 products.
WIDENED = 1 / 1024
#: Queries and nodes of one block of such a comparison.
BLOCK = (256, 16384)
#: Slices of the queries of each shard; each becomes a task of its own.
SLICES = 6
BEAM = 24
#: Links of a query may fill one part in SLACK of its beam before it is widened.
SLACK = 2
#: Queries of an audit, and the recall that it asks for.
AUDIT = 64
RECALL = 0.98
QUERIES_PER_STEP = 2048


def _usable(vector: Column) -> Column:
    """Not null, all components finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows as doubles, scaled so that no square overflows or vanishes."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.abs(flat).max(axis=1, keepdims=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal ``unit`` within each batch, in order."""
    for batch in batches:
        if batch.num_rows:
            unit = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(unit)]):
                yield int(unit[a]), pa.Table.from_batches([batch.slice(int(a), int(b - a))])


_NODE = "unit bigint, dim int, node int, rep bigint, n bigint, vector {kind}, links array<int>"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index each shard of the partition: a row per node with its vector and links, layer after layer."""

    def rows(unit: int, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        given = table.column("vector").combine_chunks()
        vectors = _matrix(given)
        dim, graph = vectors.shape[1], Graph.build(_unit(vectors))
        del vectors
        for lo in range(0, len(rep), 5000):
            hi = min(lo + 5000, len(rep))
            links = [
                np.concatenate([layer[i] for layer in graph.layers[: graph.levels[i] + 1]]) for i in range(lo, hi)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(hi - lo, unit)),
                    pa.array(np.full(hi - lo, dim, np.int32)),
                    pa.array(np.arange(lo, hi, dtype=np.int32)),
                    pa.array(rep[lo:hi]),
                    pa.array(n[lo:hi]),
                    given.slice(lo, hi - lo),
                    pa.array(links, pa.list_(pa.int32())),
                ],
                names=["unit", "dim", "node", "rep", "n", "vector", "links"],
            )

    held, now = [], None
    for unit, part in _by_unit(batches):
        if held and unit != now:
            yield from rows(now, held)
            held = []
        held.append(part)
        now = unit
    if held:
        yield from rows(now, held)


def _load(parts: list[pa.Table]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """A graph from its rows, with the double vectors, representatives and class sizes."""
    table = pa.concat_tables(parts).combine_chunks()
    order = np.argsort(table.column("node").to_numpy())
    table = table.take(pa.array(order))
    vectors = np.concatenate([_matrix(c) for c in table.column("vector").chunks])
    links = table.column("links").to_pylist()
    sizes = np.array([len(x) for x in links])
    # The lowest layer's width is what the shortest rows hold; upper layers add equal blocks.
    width = int(sizes.min())
    levels = (sizes - width) // LINKS
    layers = []
    for layer in range(int(levels.max()) + 1):
        columns = slice(0, width) if layer == 0 else slice(width + (layer - 1) * LINKS, width + layer * LINKS)
        full = np.full((len(links), columns.stop - columns.start), -1, np.int32)
        for i in np.flatnonzero(levels >= layer):
            full[i] = links[i][columns]
        layers.append(full)
    entry = int(np.flatnonzero(levels == levels.max())[0])
    graph = Graph(_unit(vectors), levels, layers, entry)
    return graph, vectors, table.column("rep").to_numpy(), table.column("n").to_numpy()


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dots = np.einsum("nd,nd->n", a, b)
    return dots / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def compare_all(vectors: np.ndarray, queries: np.ndarray, threshold: float, units: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs with a cosine of at least the threshold, by products of blocks, verified one by one.

    ``units`` are the vectors as single-precision rows of length one, where the caller has them.
    """
    out = [np.zeros((2, 0), np.int64)]
    own = _unit(queries)
    for lo in range(0, len(vectors), BLOCK[1]):
        nodes = vectors[lo : lo + BLOCK[1]]
        sides = (_unit(nodes) if units is None else units[lo : lo + BLOCK[1]]).T
        for at in range(0, len(own), BLOCK[0]):
            q, node = np.nonzero(own[at : at + BLOCK[0]] @ sides >= np.float32(threshold - 1e-3))
            for part in range(0, len(q), 100_000):
                a, b = q[part : part + 100_000] + at, node[part : part + 100_000]
                true = _cosines(queries[a], nodes[b]) >= threshold
                out.append(np.stack([a[true], b[true] + lo]))
    found = np.concatenate(out, axis=1)
    return found[0], found[1]


def ask(graph: Graph, vectors: np.ndarray, queries: np.ndarray, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) with a cosine of at least the threshold, found with beams of at least ``beam``.

    A query whose links fill its beam gets a wider one; once that is DENSE of the shard, or WIDENED for a beam above the
    given one, it is compared with all of it.
    """
    units = _unit(queries)
    left, out, given = np.arange(len(queries)), [], beam
    while len(left):
        size = min(beam, len(vectors))
        if size > BEAM and size >= (DENSE if beam == given else WIDENED) * len(vectors):
            q, node = compare_all(vectors, queries[left], threshold, graph.vectors)
            out.append(np.stack([left[q], node]))
            break
        ids, sims = graph.search(units[left], size)
        q, c = np.nonzero(sims >= threshold - 1e-3)
        node = ids[q, c]
        true = np.zeros(len(q), bool)
        for lo in range(0, len(q), 100_000):
            part = slice(lo, lo + 100_000)
            true[part] = _cosines(queries[left[q[part]]], vectors[node[part]]) >= threshold
        more = np.bincount(q, minlength=len(left)) * SLACK > size
        if size == len(vectors):
            more[:] = False
        done = true & ~more[q]
        out.append(np.stack([left[q[done]], node[done]]))
        left, beam = left[more], beam * 2
    found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return found[0], found[1]


def audited_beam(graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float) -> int:
    """The smallest beam, doubled from BEAM on, whose recall passes; a beam over all nodes passes by construction."""
    r = np.random.default_rng(5)
    picked = r.choice(len(vectors), min(AUDIT, len(vectors)), replace=False)
    own = vectors[picked] / np.linalg.norm(vectors[picked], axis=1, keepdims=True)
    noise = r.normal(size=own.shape)
    noise -= (noise * own).sum(1, keepdims=True) * own
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    near = min(1.0, threshold + 1e-3)
    planted = near * own + np.sqrt(1 - near * near) * noise / np.where(length > 0, length, 1.0)
    sample = np.concatenate([planted, queries[:AUDIT]])
    true = np.bincount(compare_all(vectors, sample, threshold)[0], minlength=len(sample))
    beam = BEAM
    while beam < len(vectors):
        q, node = ask(graph, vectors, sample, beam, threshold)
        # Each query counts alike, so that one with very many links does not hide the others.
        hits = np.bincount(q, minlength=len(sample)) / np.maximum(1, true)
        some = true > 0
        if not some.any() or hits[some].mean() >= RECALL:
            break
        beam *= 2
    return beam


def _query(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"unit": None}

        def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if state["graph"] is None and not state["nodes"]:
                return  # a shard without vectors of this length
            reps = table.column("rep").to_numpy()
            queries = np.concatenate([_matrix(c) for c in table.column("vector").chunks])
            if state["graph"] is None:
                state["graph"] = _load(state["nodes"])
                state["nodes"] = []
                state["beam"] = audited_beam(*state["graph"][:2], queries, threshold)
            graph, vectors, nodes, sizes = state["graph"]
            for lo in range(0, len(reps), QUERIES_PER_STEP):
                part = slice(lo, lo + QUERIES_PER_STEP)
                q, node = ask(graph, vectors, queries[part], state["beam"], threshold)
                own = reps[part]
                other = nodes[node] != own[q]
                q, node = q[other], node[other]
                links = np.bincount(q, weights=sizes[node].astype(float), minlength=len(own)).astype(np.int64)
                edges = _spanning(own[q], nodes[node], state["parent"])
                a = np.concatenate([own[links > 0], edges[0]])
                b = np.concatenate([own[links > 0], edges[1]])
                n = np.concatenate([links[links > 0], np.zeros(len(edges[0]), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

        for unit, part in _by_unit(batches):
            if unit != state["unit"]:
                state = {"unit": unit, "nodes": [], "graph": None, "parent": {}}
            kind = part.column("kind").to_numpy()
            split = int(np.searchsorted(kind, 1))
            if split:
                state["nodes"].append(part.slice(0, split))
            if split < len(kind):
                yield from answer(part.slice(split))

    return run


def _spanning(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the task has not connected before."""
    kept_a, kept_b = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = x, y
        while (up := parent.get(u, u)) != u:
            parent[u] = parent.get(up, up)
            u = up
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept_a.append(x)
            kept_b.append(y)
    return np.array(kept_a, np.int64), np.array(kept_b, np.int64)


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing: no links,
    a component of their own id. Equal vectors all link with each other, repeated ids included; vectors of different
    lengths never do. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("vector")) & F.col("vec_id").isNotNull())
    classes = stage(
        rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")),
        "classes",
    )
    count, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("bigint") * 8), F.lit(0))).first()
    shards = max(SHARDS, -(-size // SHARD_BYTES), -(-count // SHARD_ROWS))
    wide = classes.select("rep", "n", F.size("vector").alias("dim"), "vector")
    kind = classes.schema["vector"].dataType.simpleString()
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards))
    placed = wide.select(
        (F.col("dim").cast("bigint") * shards + shard).alias("unit"), "rep", "n", "vector"
    )
    graph = stage(
        placed.repartition(shards, "unit").sortWithinPartitions("unit", "rep").mapInArrow(_build, _NODE.format(kind=kind)), "graph"
    )
    slices = F.sequence(F.lit(0), F.lit(SLICES - 1))
    nodes = graph.select(
        F.explode(slices).alias("slice"), F.col("unit").alias("shard"), F.lit(0).alias("kind"), "node", "rep", "n", "vector", "links"
    )
    asked = wide.select(
        F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(SLICES)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"),
        F.col("dim"),
        "rep",
        "n",
        "vector",
    ).select(
        "slice",
        (F.col("dim").cast("bigint") * shards + F.col("s")).alias("shard"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("node"),
        "rep",
        "n",
        "vector",
        F.lit(None).cast("array<int>").alias("links"),
    )
    both = nodes.unionByName(asked).select((F.col("shard") * SLICES + F.col("slice")).alias("unit"), "kind", "node", "rep", "n", "vector", "links")
    dealt = both.repartition(shards * SLICES, "unit").sortWithinPartitions("unit", "kind", "node", "rep")
    answers = stage(dealt.mapInArrow(_query(threshold), "a bigint, b bigint, n bigint"), "answers")
    links = answers.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(answers.where("a <> b").select("a", "b"))
    named = (
        classes.join(links, "rep", "left")
        .join(components, classes.rep == components.node, "left")
        .select(
            "vector",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    good = rows.where("usable").join(named, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
