"""Spelling variants against brute force over all pairs."""

import random
import zlib

import pytest

from creditmill.llm import spelling


def slow_words(rows):
    """Counts letter by letter, for texts of any case."""
    counts = {}
    for doc, text in rows:
        runs, now = [], ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u00ff":
                now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif now:
                runs.append(now)
                now = ""
        for run in runs:
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode()) & 0xFFFFFFFF
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    counts = slow_words(rows)
    form, near = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed, words=120, docs=60):
    """Words over a small alphabet, so that many are near, each with variants of its own."""
    r = random.Random(seed)
    letters = "abAB\u00e9\u00c9\u00fc\u00d7"
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(words)]
    for w in list(vocabulary):
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            vocabulary.append(r.choice([w[:at] + r.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at + 1 :]]))
    weights = [1 / (1 + k) for k in range(len(vocabulary))]
    rows = [(i, r.choice([" ", "\n", "1", "-", "\u0100"]).join(r.choices(vocabulary, weights, k=r.randint(0, 80)))) for i in range(docs)]
    return rows + [(None, rows[3][1]), (5, rows[3][1]), (5, rows[3][1]), (7, None), (8, ""), (9, "abcde " * 3000)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [2, 256])
def test_variants_equal_brute_force(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(spelling, "FILE", limit)
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (limit,))
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n", "doc_id AS form")
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = slow_variants(rows)
    assert sum(x[4] for x in expected) > 40 and any(x[1] for x in expected)
    assert sorted(map(tuple, found.collect())) == expected


def test_scan_of_one_list_equals_brute_force():
    r = random.Random(5)
    for _ in range(400):
        m = r.randint(1, 7)
        words = sorted({"".join(r.choice("abc") for _ in range(m + r.randint(0, 1))) for _ in range(r.randint(0, 40))})
        found = sorted(spelling.pairs_of_file(words, m, 0, 0, 1 << 30))
        n = len(words)
        assert found == [
            (i, j) for i in range(n) for j in range(i + 1, n) if one_edit(words[i], words[j]) and min(len(words[i]), len(words[j])) == m
        ]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variants(docs).count() == 0


def test_long_chains_and_ties(spark):
    """Each word is twice as frequent as the one before and one edit away."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    text = " ".join(" ".join([w] * (3 << k)) for k, w in enumerate(chain))
    tied = " ".join(["zzzzz"] * 3 + ["zzzza"] * 6 + ["zzzzb"] * 6)
    rows = [(None, text + " " + tied)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {found[w].root for w in chain} == {"abbbbb"} and found["aaaaaa"].form == "aaaaab"
    assert found["zzzzz"].form == "zzzza" and found["zzzza"].form is None and found["zzzza"].n_near == 2
