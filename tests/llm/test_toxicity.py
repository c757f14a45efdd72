import random
import zlib

import numpy as np
import pytest

from creditmill.llm import toxicity


def make(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfgaeiou") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    bad = ["vilest", "horrid", "rotten"]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        label = int(r.random() < 0.3)
        if label:
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), r.choice(bad) + r.choice(["", "!!", "a", "en"]))
        texts.append(" ".join(words))
        labels.append(label)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def trained():
    texts, labels = make(800, 1)
    return toxicity.train(texts, labels, steps=250)


def test_held_out_accuracy(trained):
    texts, labels = make(400, 1 + 1)
    texts += ["lorem VILEST*** ipsum", "lorem ipsum"]
    labels = np.append(labels, [1, 0])
    logits = toxicity.Scorer(trained, 0.0).logits(texts)
    order = np.argsort(logits)
    rank = np.empty(len(logits))
    rank[order] = np.arange(len(logits))
    positives = labels.sum()
    auc = (rank[labels == 1].sum() - positives * (positives - 1) / 2) / (positives * (len(labels) - positives))
    assert auc > 0.95


def test_a_word_deep_in_a_long_text_counts(trained):
    texts, _ = make(60, 5)
    long = " ".join(texts * 3)
    scorer = toxicity.Scorer(trained, 0.0)
    plain, toxic = scorer.logits([long, long + " vilest horrid rotten"])
    assert toxic > plain


def test_batches_and_tables_change_nothing(trained, monkeypatch):
    texts, _ = make(50, 7)
    texts += ["", None, "***"]
    together = toxicity.Scorer(trained, 0.3).scores(texts)
    monkeypatch.setattr(toxicity, "WORDS", 10)
    scorer = toxicity.Scorer(trained, 0.3)
    alone = np.array([scorer.scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6)
    assert ((together >= 0) & (together <= 1)).all()


def test_cut_is_the_middle_of_the_best_gap():
    assert toxicity.best_cut(np.array([3.0, 2.0, 0.0, -1.0]), np.array([1, 1, 0, 0])) == 1.0
    assert toxicity.best_cut(np.array([1.0, 1.0]), np.array([1, 1])) == 0.0
    assert toxicity.best_cut(np.array([1.0, 2.0]), np.array([0, 0])) > 2.0


def test_rows_and_held_out_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    texts, labels = make(120, 9)
    rows = [(i, t, "en" if i % 2 else None, 1.5) for i, t in enumerate(texts)] + [(500, None, "en", 0.0), (500, "", "xx", 0.0), (None, "vilest", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    marks = [(i, int(label)) for i, label in enumerate(labels)] + [(0, int(labels[0])), (None, 1), (3, None), (9999, 1)]
    marked = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    picked = {r["id"] for r in toxicity._sample(docs, marked, "doc_id", "text", "lang")}
    assert picked and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in picked)
    model = toxicity.fit(docs, marked)
    scored = toxicity.add_scores(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    # The language is no input of a score.
    other = toxicity.add_scores(docs.withColumn("lang", docs.lang.substr(9, 1)), model).collect()
    assert [r.score for r in scored] == [r.score for r in other]
    assert toxicity.drop_toxic(docs, marked).columns == docs.columns


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r.score for r in toxicity.add_scores(docs, None).collect()] == [0.0, 0.0]
    assert toxicity.drop_toxic(docs, labels).count() == 2
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_best_bin_is_the_best_cut_of_its_rows():
    assert toxicity.best_bin({600: [0, 1], 400: [0, 1], 0: [1, 0], -200: [1, 0]}) == 1.0
    assert toxicity.best_bin({200: [0, 2]}) == 0.0
    assert toxicity.best_bin({200: [1, 0], 400: [1, 0]}) > 2.0


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    """A language with few of the toxic labels has its own threshold however small the sample is."""
    monkeypatch.setattr(toxicity, "STEPS", 60)
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 60, 0: 120})
    texts, labels = make(1500, 11)
    rows = [(i, t, "xx" if i % 8 == 0 else "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marked = spark.createDataFrame([(i, int(n)) for i, n in enumerate(labels)], "doc_id bigint, toxic int")
    sampled = {r["id"] for r in toxicity._sample(docs, marked, "doc_id", "text", "lang")}
    assert len(sampled) == 180
    model = toxicity.fit(docs, marked)
    assert set(model.thresholds) == {"xx", "en"}
    counts = toxicity._calibration(toxicity._rows(docs, "doc_id", "text", "lang"), toxicity._known(marked, "doc_id"), model.network, [])
    known = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 4 != 2]
    found = np.array([v for own in counts.values() for v in own.values()]).sum(axis=0)
    assert found.tolist() == [sum(labels[i] == 0 for i in known), sum(labels[i] == 1 for i in known)]


def plain_logit(network, text):
    """Embedding means, filters at every place, maxima and the logistic layer, number by number."""
    words = (text or "").lower().split() or [""]
    vectors = [np.mean([network.embedding[b].astype(float) for b in toxicity.buckets(w)], axis=0) for w in words]
    pad = np.mean([network.embedding[b].astype(float) for b in toxicity.buckets("")], axis=0)
    pooled = []
    for width, filters, bias in zip(toxicity.WIDTHS, network.filters, network.bias):
        for k in range(toxicity.FILTERS):
            best = -np.inf
            for at in range(len(words)):
                total = 0.0
                for o in range(width):
                    v = vectors[at + o] if at + o < len(words) else pad
                    total += float(v @ filters[o * toxicity.DIM : (o + 1) * toxicity.DIM, k])
                best = max(best, total)
            pooled.append(max(best + float(bias[k]), 0.0))
    return float(np.dot(pooled, network.out) + network.shift)


def test_logits_equal_a_plain_forward_pass(trained):
    texts, _ = make(25, 21)
    texts += ["", None, "one", "vilest", "two words", "*** !!!", "A vilest a vilest"]
    found = toxicity.Scorer(trained, 0.0).logits(texts)
    assert np.allclose(found, [plain_logit(trained, t) for t in texts], atol=1e-4)


def test_cuts_of_few_rows_are_drawn_to_the_general_one():
    clear = {600: [0, 1], -200: [1, 0]}
    assert toxicity.drawn_cut({}, 0.5) == 0.5 and toxicity.drawn_cut({-200: [4, 0]}, 0.5) == 0.5
    own = toxicity.best_bin(clear)
    assert toxicity.drawn_cut(clear, 0.0) == pytest.approx(own / 21)
    many = {600: [0, 20_000], -200: [20_000, 0]}
    assert toxicity.drawn_cut(many, 0.0) == pytest.approx(own, rel=0.002)
