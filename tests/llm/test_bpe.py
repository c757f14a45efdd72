import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditmill.llm import bpe


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


TEXTS = [
    "", " ", "a", "Hello  world", "it's we'll 'S", "x\n\n y \t z ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "ÀÉ ß 字 😀 é", "123 4567 ²Ⅷ", "\x00\x1c\x85\xa0  x", "﻿q", "...!!! ?", "ab" * 5000, "͸Ᲊ \U0001e5d0",
]


def test_ids_and_texts_as_the_library_has_them(exact):
    codec = bpe.codec()
    for text, ids in zip(TEXTS, codec.encode_batch(TEXTS)):
        assert ids.tolist() == exact.encode(text, add_special_tokens=False).ids, text[:40]
        assert codec.decode(ids) == exact.decode(ids.tolist(), skip_special_tokens=False)


def test_random_texts(exact):
    r = random.Random(8)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "字", "<|endoftext|>", "'s", "12", ".", "\r\n", "A", "&&&", "th", "er"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    codec = bpe.codec()
    assert [i.tolist() for i in codec.encode_batch(texts)] == [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_trees_in_step_and_alone_agree():
    codec, r = bpe.codec(), random.Random(3)
    pieces = [bytes(r.choice(b"abcdeth ing") for _ in range(r.randint(1, 90))) for _ in range(800)]
    assert codec.merge_many(pieces) == [np.array(codec.merge(p), "<u4").tobytes() for p in pieces]


def test_bytes_that_are_no_text(exact):
    codec = bpe.codec()
    half = codec.encode("字").tolist()[:1]
    assert codec.decode(half) == exact.decode(half, skip_special_tokens=False)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCABULARY))
    assert [codec.encode(t).tolist() for t in TEXTS[:8]] == [i.tolist() for i in bpe.codec().encode_batch(TEXTS[:8])]


def test_rows(spark, exact):
    rows = [(1, None, "old"), (2, "", "old"), (3, "same text", "old"), (3, "same text", "old"), (None, "<|endoftext|>", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    found = bpe.digests(docs).collect()
    assert len(found) == 5
    for row in found:
        ids = exact.encode(row.text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    encoded = bpe.decode_ids(bpe.encode_texts(docs))
    assert all(r.round_trip and r.decoded == (r.text or "") for r in encoded.collect())
    assert bpe.digests(docs.limit(0)).count() == 0
