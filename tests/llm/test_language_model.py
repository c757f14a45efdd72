import math
from collections import Counter

import numpy as np
import pytest

from creditmill.llm import language_model as lm

DOCS = [
    (1, "the cat sat on the mat", "x"), (2, "The cat sat on the cat", "x"), (3, "buy cheap pills now buy now", "x"),
    (4, "buy cheap cheap pills", "x"), (5, None, "x"), (5, "", "x"), (6, "rare", "x"), (None, "the the the", "x"), (1, "the cat sat on the mat", "x"),
]


def slow(docs, good):
    texts = [((t or "").lower().split(), i in good) for i, t, _ in docs]
    words = [(w, g) for ws, g in texts for w in ws]
    counts = Counter(w for w, _ in words)
    vocabulary = set(counts)
    pairs = [(u, v, g) for ws, g in texts for u, v in zip(["<s>", *ws], ws)]
    out = []
    for want in (True, False):
        own = Counter(w for w, g in words if g or not want)
        n = sum(own.values())
        two = Counter((u, v) for u, v, g in pairs if g or not want)
        heads = Counter()
        for (u, _), c in two.items():
            heads[u] += c
        out.append((own, n, two, heads))

    def loss(ws, model):
        own, n, two, heads = model
        total = 0.0
        for u, v in zip(["<s>", *ws], ws):
            single = (own[v] + 1) / (n + len(vocabulary) + 1)
            total -= math.log((two[u, v] + lm.BACK_OFF * single) / (heads[u] + lm.BACK_OFF))
        return total / len(ws)

    return [(len(ws), *[loss(ws, m) if ws else None for m in out]) for ws, _ in texts]


def key(row):
    return str(tuple(row))


@pytest.mark.parametrize("block, part", [(12_000_000, 12_000_000), (20, 7), (1, 1)])
def test_losses_match_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(lm, "BLOCK_CHARS", block)
    monkeypatch.setattr(lm, "PART_CHARS", part)
    monkeypatch.setattr(lm, "HASHES", 3)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, difference string").selectExpr("*", "map('a', 1) AS m", "1 AS __block", "2 AS __role", "3 AS __id")
    target = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id bigint")
    found = lm.add_scores(docs, target)
    assert found.columns == ["doc_id", "text", "m", "__block", "__role", "__id", "n_tokens", "target_loss", "background_loss", "difference"]
    scored = sorted(found.drop("m").collect(), key=lambda r: key((r.doc_id, r.text)))
    expected = [e for _, e in sorted(zip(DOCS, slow(DOCS, {1, 2})), key=lambda p: key(p[0][:2]))]
    assert len(scored) == len(DOCS)
    for row, (n, a, b) in zip(scored, expected):
        assert row.n_tokens == n and row["__block"] == 1
        if n:
            assert row.target_loss == pytest.approx(a) and row.background_loss == pytest.approx(b)
            assert row.difference == pytest.approx(a - b)
        else:
            assert row.target_loss is None and row.difference is None


def test_target_documents_score_lower(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, x string")
    target = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    rows = lm.add_scores(docs, target).collect()
    by_id = {r.doc_id: r.difference for r in rows if r.difference is not None}
    assert max(by_id[1], by_id[2]) < min(by_id[3], by_id[4])


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, x string")
    none = spark.createDataFrame([], "doc_id bigint")
    assert lm.add_scores(docs.limit(0), none).count() == 0
    scored = lm.add_scores(docs, none)
    assert scored.where("n_tokens > 0 and difference is null").count() == 0


def test_rare_words_and_bigrams_count_in_a_large_corpus(spark):
    """A phrase seen twice among 1,200,000 words is known, however large the corpus is."""
    noise = [(i, "one two three four " * 3000, "x") for i in range(100, 200)]
    rows = noise + [(1, "quite unusual phrase", "x"), (2, "quite unusual phrase", "x"), (3, "unusual quite", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x string")
    scored = lm.add_scores(docs, spark.createDataFrame([(1,)], "doc_id bigint")).collect()
    found = {r.doc_id: r for r in scored}
    expected = {d[0]: e for d, e in zip(rows, slow(rows, {1}))}
    for i in (1, 2, 3, 100):
        assert found[i].target_loss == pytest.approx(expected[i][1])
        assert found[i].background_loss == pytest.approx(expected[i][2])


def test_other_documents_are_scored_by_the_counted_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 20)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, x string")
    target = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    other = spark.createDataFrame([(1, "mat the cat"), (2, "unheard of"), (3, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in lm.add_scores(other, target, counted=docs).collect()}
    assert found[1].difference < 0 and found[2].background_loss > found[1].background_loss and found[3].target_loss is None
    expected = {(d[1]): e for d, e in zip(DOCS, slow(DOCS, {1, 2}))}
    for r in lm.add_scores(docs, target, counted=docs).collect():
        assert r.difference is None or r.target_loss == pytest.approx(expected[r.text][1])


def test_packing_is_exact():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 300_000):
        codes = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        assert (lm.unpack_codes(lm.pack_codes(codes), len(codes)) == codes).all()
        counts = r.integers(0, [[3], [300], [1 << 40]], (3, n))
        assert (lm.unpack_counts(lm.pack_counts(counts), n) == counts).all()
    near = np.array([5, 6, (1 << 64) - 1], np.uint64)
    assert (lm.unpack_codes(lm.pack_codes(near), 3) == near).all()
