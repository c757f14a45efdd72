"""Sharded Lloyd rounds against plain integers."""

import hashlib
import math
import random

import pytest

from creditmill.llm import centroids


def slow(rows, clusters, rounds, dimensions, seed=3):
    kept = []
    for vec_id, v in rows:
        if v is None or len(v) != dimensions or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(1024 * x) for x in v]))
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centers)]
    done = [(i, *nearest(v)[::-1]) for i, v in kept] if centers else []
    sums = {}
    for _, k, d in done:
        sums[k] = sums.get(k, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, k, d, sums[k], sum(sums.values()), digests[k]) for i, k, d in done), key=str)


def vectors(seed, n, dimensions):
    r = random.Random(seed)
    middles = [[r.uniform(-2, 2) for _ in range(dimensions)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(n // 3)]  # copies of one vector
    rows += [(None, list(rows[1][1])), (5, list(rows[2][1])), (2000, None), (2001, []), (2002, [0.5] * (dimensions - 1)), (2003, [None] + [0.0] * (dimensions - 1))]
    rows += [(2004, [float("nan")] + [0.0] * (dimensions - 1)), (2005, [float("-inf")] + [0.0] * (dimensions - 1)), (2006, [0.0] * dimensions), (2007, [-1e5] * dimensions)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS block", "3 AS distance", "4 AS chunk")


@pytest.mark.parametrize("dimensions, block, clusters", [(10, 4, 3), (16, 16, 8)])
def test_equals_plain_integers(spark, dimensions, block, clusters):
    rows = vectors(dimensions, 90, dimensions)
    found = centroids.cluster(frame(spark, rows).repartition(3), clusters=clusters, rounds=4, dimensions=dimensions, block=block)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == slow(rows, clusters, 4, dimensions)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lloyd")]


def test_empty_clusters_stay_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)] + [(9, [3.0, 3.0])]
    for some in (rows, rows[:2], rows[:1]):
        found = centroids.cluster(frame(spark, some), clusters=4, rounds=3, dimensions=2)
        assert sorted(map(tuple, found.collect()), key=str) == slow(some, 4, 3, 2)


def test_no_usable_vector(spark):
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        assert centroids.cluster(frame(spark, rows), dimensions=2, rounds=2).count() == 0


def test_components_too_large_are_refused(spark):
    with pytest.raises(Exception, match="leave 64 bits"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])]), dimensions=2, rounds=1)


def test_sums_beyond_64_bits(spark):
    rows = [(i, [131000.0, -131000.0]) for i in range(40)]
    found = centroids.cluster(frame(spark, rows), clusters=2, rounds=2, dimensions=2)
    assert sorted(map(tuple, found.collect()), key=str) == slow(rows, 2, 2, 2)
