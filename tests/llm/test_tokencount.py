import math
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from creditmill.llm import tokencount

PARTS = ["a", "the", " ", "  ", "\n", "é", "字", "😀", "▁", "ing", "<s>", "<0x0A>", "th", "er", "1", "\t", "ﬀ", "\x00", "ꙮ"]


def library(vocabulary):
    own = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return own


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 15))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return tokencount.unigram_vocabulary(public_tokenizers.path(tokencount.VOCABULARY))


def test_counts_as_the_library(vocabulary):
    many = texts(1500, 2) + ["", " ", "x" * 3000, "the " * 500, "字" * 400]
    exact = [len(e.ids) for e in library(vocabulary).encode_batch(many)]
    assert [c for c, _ in tokencount.Counter(vocabulary).counts(many)] == exact


def test_ties_as_the_library(vocabulary):
    """Equal scores of different piece counts, where only the tie rule decides."""
    bytes_ = [p for p in vocabulary if p[0].startswith("<0x")]
    tied = [("<unk>", -50.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bab", -3.0), ("aab", -3.0)] + bytes_
    r = random.Random(5)
    many = ["".join(r.choice("ab cé") for _ in range(r.randint(1, 12))) for _ in range(600)]
    exact = [len(e.ids) for e in library(tied).encode_batch(many)]
    assert [c for c, _ in tokencount.Counter(tied).counts(many)] == exact


def test_score_is_the_best_path(vocabulary):
    small = tokencount.Counter([("<unk>", -9.0), ("▁", -1.0), ("x", -1.5), ("xx", -2.0), ("▁x", -1.0)])

    def slow(word):
        if not word:
            return 0.0
        return max(
            s + slow(word[len(p) :]) for p, s in [("▁", -1.0), ("x", -1.5), ("xx", -2.0), ("▁x", -1.0), (word[0], -19.0)] if word.startswith(p)
        )

    for word in ("x", "xxx", "xxxxxx", "qx"):
        assert math.isclose(small.counts([word])[0][1], slow("▁" + word))


def test_small_caches_change_nothing(vocabulary, monkeypatch):
    many = texts(100, 3)
    expected = tokencount.Counter(vocabulary).counts(many)
    monkeypatch.setattr(tokencount, "CACHE", 2)
    own = tokencount.Counter(vocabulary)
    assert [own.counts([t])[0] for t in many] == expected


def test_rows(spark, vocabulary):
    rows = [(1, "the same", 0), (1, "the same", 0), (2, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    found = tokencount.add_counts(docs).collect()
    exact = library(vocabulary)
    assert [r.n_tokens for r in found] == [len(exact.encode(t or "").ids) for _, t, _ in rows]
    assert found[2].log_prob == 0.0
    assert tokencount.add_counts(docs.limit(0)).count() == 0
