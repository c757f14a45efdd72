"""The pipeline against a plain version on a small corpus."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from creditmill.llm import bpe, pii, toxicity
from test_contamination import slow as slow_contamination
from test_simhash import slow_components, slow_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(12)
    vocabulary = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        words = [r.choice(vocabulary) for _ in range(r.randint(4, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "horrid", "rotten"]))
        rows.append([i, " ".join(words), "en", "s", 0])
        if i % 3:
            labels.append((i, int(toxic)))
    passage = " ".join(r.choice(vocabulary) for _ in range(14))
    rows += [[200 + k, rows[1][1], "en", "s", 0] for k in range(20)]  # exact copies
    changed = [r.choice(vocabulary) for _ in range(600)]
    rows.append([220, " ".join(changed), "en", "s", 0])
    changed[300] = near_word(changed)
    rows.append([221, " ".join(changed), "en", "s", 0])  # a near copy
    rows += [[230, "Intro " + passage.upper() + " outro", "en", "s", 0], [231, "mail a.b@c.org now " + rows[2][1], "fr", "s", 0]]
    rows += [[240, None, None, None, None], [241, "", "en", "s", 0], [2, rows[2][1], "en", "s", 0], [None, "no id here at all", "en", "s", 0]]
    return [tuple(x) for x in rows], labels, [(1, passage), (2, None)]


def near_word(words):
    """A word for place 300 that moves the fingerprint by one or two bits."""
    own = slow_fingerprint(" ".join(words), 3)
    for n in range(10_000):
        other = [*words[:300], f"another{n}", *words[301:]]
        if 0 < (own ^ slow_fingerprint(" ".join(other), 3)).bit_count() <= 2:
            return f"another{n}"
    raise AssertionError("no such word")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_a_plain_version(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 150)
    rows, _, items = corpus()
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model.network, model.shift)
    kept = [r for r in rows if scorer.scores([r[1]])[0] < model.thresholds.get(r[2], toxicity.CUT)]
    assert 0 < len(kept) < len(rows)
    prints = [(r[0], slow_fingerprint(r[1], 3)) for r in kept]
    group = slow_components([p for p in prints if p[0] is not None], 2)
    seen, firsts = set(), []
    for row, p in zip(kept, prints):
        if p[0] is None or (group[p] == p[0] and p not in seen):
            firsts.append(row)
            seen.add(p)
    assert 220 in {r[0] for r in firsts} and 221 not in {r[0] for r in firsts}
    clean = [r for r in firsts if not slow_contamination([(r[0], r[1])], items)[0][5]]
    assert len(clean) < len(firsts) < len(kept)
    accepted = pii.fit(spark.createDataFrame(clean, SCHEMA))
    exact = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    expected = []
    for doc, text, lang, source, _ in clean:
        text = None if text is None else pii.redact_text(text, pii.spans(text, accepted)[1])
        ids = exact.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, lang, source, None if text is None else len(text), ids, len(ids), True))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens", "round_trip"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
    documents = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, documents, folder)
        assert out.columns == documents.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, documents, folder).count() == 0


def test_clashing_columns_survive(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    documents = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    for name in ("score", "toxic", "fingerprint_bits", "component_id", "carried", "word", "spans"):
        documents = documents.selectExpr("*", f"doc_id AS {name}")
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, documents, folder)
        assert out.columns == documents.columns
        assert out.where("not (score <=> doc_id) or not (word <=> doc_id)").count() == 0
