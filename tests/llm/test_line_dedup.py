"""Line dedup against a plain version, both ways of rewriting, and reversibility."""

import random

import numpy as np
import pytest

from creditmill.llm import line_dedup
from creditmill.llm.line_dedup import CuckooFilter


def slow(rows, threshold):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans(upper, lower))

    seen = {}
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < threshold]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, docs=70):
    r = random.Random(seed)
    common = ["All rights reserved", "", " ", "\u00c9t\u00e9", "\u00e9t\u00e9", "menu | home", "\u00a0x"] + [f"line {i}" for i in range(30)]
    rows = []
    for i in range(docs):
        lines = [r.choice(["", "  ", "\t"]) + (x.upper() if r.random() < 0.3 else x) + r.choice(["", " ", "\r"]) for x in r.choices(common, k=r.randint(0, 9))]
        lines += [f"own {i} {k}" for k in range(r.randint(0, 3))]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, None), (900, ""), (901, None), (3, rows[3][1]), (3, rows[3][1]), (902, "x" * 200_000 + "\nline 1\n"), (903, "\n" * 5000)]


def found(index, docs):
    return sorted(map(tuple, index.apply(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_lines", "2 AS shard", "3 AS low", "map('a', 1) AS __m", "4 AS __own", "5 AS __packed", "6 AS own", "7 AS part")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_the_plain_version(spark, seed, broadcast, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 64 << 20 if broadcast else -1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    monkeypatch.setattr(line_dedup, "HELD", 20)
    rows = corpus(seed)
    docs = frame(spark, rows)
    expected = slow(rows, 10)
    assert any(x[2] for x in expected)
    assert found(line_dedup.build_index(docs), docs) == expected


@pytest.mark.parametrize("broadcast", [True, False])
def test_false_members_are_exceptions(spark, broadcast, monkeypatch):
    """With marks of two bits most keys pass the filters; the results stay exact."""
    places = CuckooFilter.places

    def few(self, low, high):
        return places(self, low, high.view(np.uint64) & np.uint64(3) | np.uint64(1) << np.uint64(32))

    monkeypatch.setattr(CuckooFilter, "places", few)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 64 << 20 if broadcast else -1)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(line_dedup)  # workers get the changed class
    try:
        rows = corpus(3)
        docs = frame(spark, rows)
        index = line_dedup.build_index(docs)
        assert index.exceptions.count() > 5
        assert found(index, docs) == slow(rows, 10)
    finally:
        cloudpickle.unregister_pickle_by_value(line_dedup)


def test_insertions_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    rows = corpus(4, 120)
    first, second, third = rows[:50], rows[50:90], rows[90:]
    parts = [frame(spark, p) for p in (first, second, third)]
    index = line_dedup.build_index(parts[0], threshold=6)
    grown = index.insert(parts[1]).insert(parts[2])
    for part, own in zip(parts, (first, second, third)):
        whole = slow(rows, 6)
        assert set(map(str, found(grown, part))) <= set(map(str, whole))
    back = grown.delete(parts[2]).delete(parts[1])
    assert found(back, parts[0]) == slow(first, 6)
    table = sorted(map(tuple, index.counts.select("low", "high", "n").collect()))
    assert sorted(map(tuple, back.counts.select("low", "high", "n").collect())) == table
    empty = back.delete(parts[0])
    assert empty.counts.count() == 0 and all(x[2] == 0 for x in found(empty, parts[0]))


def test_empty_table(spark):
    docs = frame(spark, []).limit(0)
    assert found(line_dedup.build_index(docs), docs) == []


def test_filter_remembers_and_forgets():
    r = np.random.default_rng(1)
    low, high = r.integers(-(2**62), 2**62, (2, 5000))
    own = CuckooFilter(3000)
    own.insert(low[:3000], high[:3000])
    own.insert(low[:5], high[:5])
    again = CuckooFilter.from_bytes(own.to_bytes())
    assert again.contains(low[:3000], high[:3000]).all() and again.contains(low[3000:], high[3000:]).sum() == 0
    again.delete(low[:1000], high[:1000])
    assert again.contains(low[:5], high[:5]).all() and again.contains(low[5:1000], high[5:1000]).sum() == 0
    assert again.contains(low[1000:3000], high[1000:3000]).all()


def test_a_crowded_filter_denies_no_key():
    r = np.random.default_rng(2)
    low, high = r.integers(-(2**62), 2**62, (2, 400))
    own = CuckooFilter(10)
    own.insert(low, high)
    own = CuckooFilter.from_bytes(own.to_bytes())
    assert own.crowded and own.contains(low, high).all()
    own.delete(low[:300], high[:300])
    assert own.contains(low[300:], high[300:]).all()
