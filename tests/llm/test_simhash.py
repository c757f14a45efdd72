import random
import re

import numpy as np
import pytest
import xxhash

from creditmill.llm import simhash
from creditmill.llm.components import connected_components
from creditmill.llm.simhash import fingerprint, link_lanes


def slow_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def slow_components(rows, radius=2):
    """{(id, fingerprint): smallest reachable id} by comparing all pairs."""
    nodes = list(dict.fromkeys(rows))
    group = {n: n[0] for n in nodes}
    while True:
        changed = False
        for a in nodes:
            for b in nodes:
                near = bin(a[1] ^ b[1]).count("1") <= radius and group[b] < group[a]
                if near:
                    group[a], changed = group[b], True
        if not changed:
            return group


@pytest.mark.parametrize(
    "text", [None, "", " \n\t", "one", "Two words", "A b C d É f", "a b c d e", "x " * 70000, "ÀB\x0bc\x0cD e f g"]
)
def test_fingerprint_is_the_definition(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_links_match_all_pairs_in_every_group():
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(12)]
    values, groups = [], []
    for g in range(40):
        for _ in range(r.randint(1, 70)):
            v = r.choice(centres)
            for _ in range(r.randint(0, 3)):
                v ^= 1 << r.randrange(64)
            values.append(v)
            groups.append(g)
    values, groups = np.array(values, np.uint64), np.array(groups)
    found = link_lanes(values, groups)
    for g in range(40):
        own = np.flatnonzero(groups == g)
        root = {int(i): int(i) for i in own}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in own:
            for j in own:
                if i < j and bin(int(values[i]) ^ int(values[j])).count("1") <= 2:
                    a, b = find(int(i)), find(int(j))
                    root[max(a, b)] = min(a, b)
        assert [int(found[i]) for i in own] == [find(int(i)) for i in own]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_distances_at_the_radius(radius):
    base = 0x0123456789ABCDEF
    for differing in range(4):
        other = base
        for bit in range(differing):
            other ^= 1 << (bit * 21)
        linked = link_lanes(np.array([base, other], np.uint64), np.zeros(2, int), radius)[1] == 0
        assert linked == (differing <= radius)


def test_components_of_repeats_nulls_and_empty_texts(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, long, "x"), (3, long + " end", "x"), (9, long, "y"), (9, long, "y"), (7, None, "z"), (8, "", "z"), (1, " ", "z"),
        (20, "other words here now", "q"), (None, long, "n"), (5, "a second text of a repeated id", "n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint_bits string")
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == len(rows)
    expected = slow_components([(i, slow_fingerprint(t)) for i, t, _ in rows if i is not None])
    # An id that two texts bear belongs to both their groups, so components are named by ids.
    for doc, bits, component in found:
        if doc is None:
            assert component is None
        else:
            assert component == expected[doc, bits & (1 << 64) - 1]


def test_one_row_of_each_group_stays(spark):
    rows = [(2, "a b c d", 0), (1, "a b c d", 1), (1, "a b c d", 1), (4, None, 2), (6, "", 3), (None, "a b c d", 4), (8, "q r s t u", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_blocks_of_a_large_file(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = [(i, (7 << 32) | (1 << (i % 16)) | (1 << (i // 16))) for i in range(60)]
    unique = {}
    for i, b in rows:
        unique.setdefault(b, i)
    found = spark.createDataFrame([(b, i) for b, i in unique.items()], "bits bigint, rep bigint")
    edges = simhash.near_fingerprints(found)
    components = {r.node: r.component for r in connected_components(edges).collect()}
    expected = slow_components([(i, b) for b, i in unique.items()])
    assert {i: components.get(i, i) for i, _ in expected} == {i: c for (i, _), c in expected.items()}


@pytest.mark.parametrize("radius", [1, 2, 3, 6, 8])
def test_every_link_within_the_radius_is_filed(spark, radius):
    r = random.Random(radius)
    values = []
    for _ in range(60):
        base = r.getrandbits(64)
        values.append(base)
        for differing in (radius - 1, radius, radius + 1):
            other = base
            for bit in r.sample(range(64), differing):
                other ^= 1 << bit
            values.append(other)
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = spark.createDataFrame(list(zip(signed, range(len(values)))), "bits bigint, rep bigint")
    edges = simhash.near_fingerprints(found, radius)
    components = {x.node: x.component for x in connected_components(edges).collect()}
    expected = slow_components(list(zip(range(len(values)), values)), radius)
    assert {i: components.get(i, i) for i, _ in expected} == {i: c for (i, _), c in expected.items()}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (5, 5), (300, 299)]
    edges += [(None, 4), (2, None)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 299: 299, 300: 299}
