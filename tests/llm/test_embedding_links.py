import time

import numpy as np
import pytest

from creditmill.llm import embedding_links
from creditmill.llm.hnsw import Graph


def clouds(n, dim, seed, groups=20, spread=0.12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    rows = np.concatenate([r.normal(size=(n, dim)), centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim)) * np.sqrt(1)])
    return rows[r.permutation(len(rows))]


def slow(rows, threshold=0.9):
    """{position: (links, component)} over usable (id, vector) rows."""
    usable = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i in usable}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for i in usable:
        for j in usable:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    low = {}
    for i in usable:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return {i: (links[i], low[find(i)] if i in root else rows[i][0]) for i in range(len(rows))}


def test_graph_finds_near_neighbours():
    rows = clouds(700, 24, 1)
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    graph = Graph.build(unit)
    true = unit @ unit.T >= 0.9
    assert embedding_links.audited_beam(graph, rows, rows[:64], 0.9) >= embedding_links.BEAM
    q, node = embedding_links.ask(graph, rows, rows, embedding_links.BEAM, 0.9)
    found = np.zeros_like(true)
    found[q, node] = True
    assert not (found & ~true).sum() > 4  # float32 against double at the threshold
    assert (found & true).sum() >= 0.97 * true.sum()


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs_and_equal_vectors(n):
    unit = np.tile(np.eye(1, 8, dtype=np.float32), (n, 1))
    ids, _ = Graph.build(unit).search(unit, n)
    assert (np.sort(ids, axis=1) == np.arange(n)).all()


def test_a_full_beam_is_exact():
    rows = clouds(60, 8, 4)
    graph = Graph.build((rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32))
    ids, _ = graph.search(graph.vectors, len(rows))
    assert (np.sort(ids, axis=1) == np.arange(len(rows))).mean() > 0.99


def test_rows_match_brute_force(spark):
    some = clouds(60, 6, 2, groups=8)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(some)]
    rows += [(300 + k, rows[5][1]) for k in range(30)] + [(7, rows[5][1]), (400, [2 * x for x in rows[9][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (505, [None] + [1.0] * 5)]
    rows += [(None, rows[5][1]), (600, [1.0, 0.0]), (601, [1.0, 0.001]), (500, None)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, n_links int")
    found = embedding_links.near_vectors(frame).collect()
    expected = sorted(((i, *slow(rows)[k]) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)


def test_empty_table(spark):
    assert embedding_links.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_shards_far_larger_than_the_beam(spark, monkeypatch):
    """Found links are true, and hardly any is missed, where a search sees a small part of its shard."""
    monkeypatch.setattr(embedding_links, "SHARDS", 2)
    r = np.random.default_rng(7)
    base = r.normal(size=(1500, 16))
    near = base[:400] / np.linalg.norm(base[:400], axis=1, keepdims=True)
    noise = r.normal(size=near.shape)
    noise -= (noise * near).sum(1, keepdims=True) * near
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = r.uniform(0.86, 0.99, (400, 1))
    rows = np.float32(np.concatenate([base, cosine * near + np.sqrt(1 - cosine**2) * noise]))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>")
    found = {x.vec_id: x.n_links for x in embedding_links.near_vectors(frame).collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = np.array([found[i] for i in range(len(rows))])
    assert (got <= true).all() and true.sum() > 400
    assert got.sum() >= 0.97 * true.sum()


def test_a_dense_group_is_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "SHARDS", 2)
    r = np.random.default_rng(8)
    rows = np.concatenate([r.normal(size=(1000, 16)), r.normal(size=(1, 16)) + 0.05 * r.normal(size=(1000, 16))]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>")
    begin = time.monotonic()
    found = {x.vec_id: (x.n_links, x.component_id) for x in embedding_links.near_vectors(frame).collect()}
    assert time.monotonic() - begin < 40
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert true[1000:].min() > 900
    assert [found[i][0] for i in range(1000, 2000)] == true[1000:].tolist()
    assert len({found[i][1] for i in range(1000, 2000)}) == 1


def test_block_products_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(embedding_links, "BLOCK", (7, 11))
    rows = clouds(60, 6, 3, groups=4)
    q, node = embedding_links.compare_all(rows, rows[:50], 0.9)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert sorted(zip(q.tolist(), node.tolist())) == [(int(a), int(b)) for a, b in np.argwhere(unit[:50] @ unit.T >= 0.9)]


def test_a_widened_beam_gives_way_to_products_before_it_costs_more(monkeypatch):
    r = np.random.default_rng(9)
    group = r.normal(size=(1, 16)) + 0.02 * r.normal(size=(300, 16))
    rows = np.concatenate([group, r.normal(size=(9000, 16))])
    graph = Graph.build((rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32))
    beams = []
    monkeypatch.setattr(Graph, "search", lambda self, queries, beam, layer=0, original=Graph.search: beams.append(beam) or original(self, queries, beam, layer))
    q, node = embedding_links.ask(graph, rows, rows[:20], embedding_links.BEAM, 0.9)
    assert beams == [embedding_links.BEAM]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert sorted(zip(q.tolist(), node.tolist())) == [(int(a), int(b)) for a, b in np.argwhere(unit[:20] @ unit.T >= 0.9)]


def test_a_narrow_beam_finds_planted_neighbours_of_a_large_shard():
    r = np.random.default_rng(10)
    unit = r.normal(size=(12_000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = Graph.build(unit.astype(np.float32))
    own = unit[:400]
    noise = r.normal(size=own.shape)
    noise -= (noise * own).sum(1, keepdims=True) * own
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    planted = (0.901 * own + np.sqrt(1 - 0.901**2) * noise).astype(np.float32)
    ids, _ = graph.search(planted, embedding_links.BEAM)
    assert (ids == np.arange(400)[:, None]).any(axis=1).mean() > 0.99


def test_shards_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "SHARD_ROWS", 10)
    written = []
    monkeypatch.setattr(embedding_links, "stage", lambda df, label, original=embedding_links.stage: written.append((label, original(df, label))) or written[-1][1])
    rows = clouds(50, 4, 6, groups=5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links.near_vectors(frame).collect()}
    assert found == slow([(i, v.tolist()) for i, v in enumerate(rows)])
    assert dict(written)["graph"].select("unit").distinct().count() > 4
