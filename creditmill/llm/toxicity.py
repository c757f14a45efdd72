"""Toxicity by a convolutional classifier over hashed word embeddings.

A word's embedding is the mean over the buckets of its letters and of their prefixes.
Filters of several widths slide over whole texts; their maxima feed a logistic
layer. Training is plain numpy on a bounded, documented sample of labelled rows; scoring is a map.
Thresholds come from counts over all labelled rows that are neither held out nor trained on.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import add_columns, broadcast_if_small

#: Labelled rows of each class that training uses at most, chosen by a hash of the id.
SAMPLE = {1: 2000, 0: 4000}
BUCKETS = 1 << 18
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (3, 4, 5, 6, 7)
#: Gradient steps, as many for any sample; the sample is gone through again and again.
STEPS = 750
DOCS_PER_STEP = 32
#: Share of a text's words that a step leaves out, so that no single rare word explains a text.
WORD_DROPOUT = 0.3
RATE = 0.01
#: The score from which a text is predicted toxic when its language has no threshold of its own.
CUT = 0.3
#: Toxic rows that a cut of few rows is weighed against: a language's against the cut of all, that of all against even odds.
PRIOR_POSITIVES = 20
#: Bins of a logit of one, and the largest logit that has a bin of its own.
BINS, LARGEST = 200, 30
#: Words whose filter responses a worker keeps; the table is then begun anew.
WORDS = 120_000
_FEATURES = len(PREFIXES) + 1


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def buckets(word: str) -> list[int]:
    """The hash buckets of a word, always as many; a word without letters or digits has bucket zero only."""
    plain = word if word.isalnum() else "".join(filter(str.isalnum, word))
    if not plain:
        return [0] * _FEATURES
    raw = plain.encode("utf-8", "replace")
    parts = [b"=" + raw] + [plain[:n].encode("utf-8", "replace") for n in PREFIXES]
    return [zlib.crc32(p) % (BUCKETS - 1) + 1 for p in parts]


def bucket_table(some) -> np.ndarray:
    """(words, buckets of each), filled word by word, so that no list of numbers is held."""
    flat = np.fromiter((b for word in some for b in buckets(word)), np.int32, len(some) * _FEATURES)
    return flat.reshape(-1, _FEATURES)


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Network:
    """Weights and the forward pass over word embeddings."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS, DIM), np.float32)
        self.seed = seed
        self.filters = [r.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)

    def fill(self, touched: np.ndarray) -> None:
        """Random starts for the buckets that occur in training; all others stay zero."""
        r = np.random.default_rng(self.seed + 1)
        self.embedding[touched] = r.normal(0, 0.3, (len(touched), DIM)).astype(np.float32)
        self.embedding[0] = 0

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """Each word's part in every filter at every offset: (words, sum of widths x filters)."""
        blocks = [f[o * DIM : (o + 1) * DIM] for f, w in zip(self.filters, WIDTHS) for o in range(w)]
        return vectors @ np.concatenate(blocks, axis=1)

    def pool(self, responses: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Maxima of every filter over the positions starts:ends, and where they are.

        ``ids`` has two padding words after each text, so a window may run over its end.
        """
        maxima, n = [], len(ids)
        cuts = np.stack([starts, ends], axis=1).ravel()
        column = 0
        for w, bias in zip(WIDTHS, self.bias):
            total = np.zeros((n, FILTERS), np.float32)
            for o in range(w):
                total[: n - o] += responses[ids[o:], column : column + FILTERS]
                column += FILTERS
            maxima.append((np.maximum.reduceat(total, cuts, axis=0)[::2] + bias, total))
        return maxima

    def logits(self, responses, ids, starts, ends) -> np.ndarray:
        pooled = np.concatenate([m for m, _ in self.pool(responses, ids, starts, ends)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.shift


def _lay_out(texts_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenated word numbers, two pads (0) after each text; a text without words is one pad."""
    lengths = np.array([max(1, len(i)) for i in texts_ids])
    ends = np.cumsum(lengths + 2) - 2
    starts = ends - lengths
    ids = np.zeros(int(ends[-1]) + 2, np.int64)
    for i, s in zip(texts_ids, starts):
        ids[s : s + len(i)] = i
    return ids, starts, ends


def train(texts: list[str], toxic: np.ndarray, steps: int = STEPS) -> Network:
    """Fit a network by Adam on the logistic loss, both classes weighted alike."""
    network = Network()
    vocabulary: dict[str, int] = {"": 0}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int32) for t in texts]
    table = bucket_table(vocabulary)
    del vocabulary
    network.fill(np.unique(table))
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum())) * len(toxic)
    r = np.random.default_rng(network.seed)
    dense = [*network.filters, *network.bias, network.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense] + [(np.zeros(1), np.zeros(1))]
    slow = np.zeros((BUCKETS, DIM), np.float32)
    step = 0
    while step < steps:
        order = r.permutation(len(rows))
        for lo in range(0, len(order), DOCS_PER_STEP):
            some = order[lo : lo + DOCS_PER_STEP]
            ids, starts, ends = _lay_out([rows[i][r.random(len(rows[i])) >= WORD_DROPOUT] for i in some])
            unique, inner = np.unique(ids, return_inverse=True)
            vectors = network.embedding[table[unique]].mean(axis=1)
            pooled = network.pool(network.responses(vectors), inner, starts, ends)
            value = np.concatenate([m for m, _ in pooled], axis=1)
            active = np.maximum(value, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ network.out + network.shift, -30, 30)))
            error = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            back = np.outer(error, network.out) * (value > 0)
            grads_f, grads_b = [np.zeros_like(f) for f in network.filters], []
            rows_at, rows_grad = [], []
            for k, (w, (_, total)) in enumerate(zip(WIDTHS, pooled)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads_b.append(part.sum(axis=0))
                for d, (s, e) in enumerate(zip(starts, ends)):
                    if not part[d].any():
                        continue
                    at = s + total[s:e].argmax(axis=0)
                    for o in range(w):
                        word = inner[at + o]
                        span = slice(o * DIM, (o + 1) * DIM)
                        grads_f[k][span] += vectors[word].T * part[d]
                        rows_at.append(word)
                        rows_grad.append((network.filters[k][span] * part[d]).T)
            step += 1
            grads = [*grads_f, *grads_b, active.T @ error, np.array([error.sum()])]
            for p_, g, (m1, m2) in zip([*dense, None], grads, moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
                if p_ is None:
                    network.shift = np.float32(network.shift - move[0])
                else:
                    p_ -= move.astype(np.float32)
            if rows_at:
                at = table[unique[np.concatenate(rows_at)]]
                grad = np.repeat(np.concatenate(rows_grad)[:, None, :] / _FEATURES, _FEATURES, axis=1)
                hit, place = np.unique(at.ravel(), return_inverse=True)
                g = np.zeros((len(hit), DIM), np.float32)
                np.add.at(g, place, grad.reshape(-1, DIM))
                slow[hit] += g * g
                network.embedding[hit] -= 5 * RATE * g / (np.sqrt(slow[hit]) + 1e-6)
                network.embedding[0] = 0
    return network


class Scorer:
    """Scores of batches of whole texts, with the responses of known words kept."""

    def __init__(self, network: Network, shift: float):
        self.network, self.shift = network, shift
        self._begin()

    def _begin(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.responses = np.zeros((1, sum(WIDTHS) * FILTERS), np.float32)
        self.used = 1

    def _vectors(self, new: list[str]) -> np.ndarray:
        """Mean embeddings, some words at a time."""
        parts = [new[lo : lo + 20_000] for lo in range(0, len(new), 20_000)]
        return np.concatenate([self.network.embedding[bucket_table(p)].astype(np.float32).mean(axis=1) for p in parts])

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.used > WORDS:
            self._begin()
        split = [words(t) for t in texts]
        unknown: set[str] = set()
        for s in split:
            unknown.update(s)
        new = sorted(unknown.difference(self.numbers))
        if new:
            vectors = self._vectors(new)
            need = self.used + len(new)
            if need > len(self.responses):
                grown = np.zeros((need + need // 2, self.responses.shape[1]), np.float32)
                grown[: self.used] = self.responses[: self.used]
                self.responses = grown
            self.responses[self.used : need] = self.network.responses(vectors)
            self.numbers.update(zip(new, range(self.used, need)))
            self.used = need
        number = self.numbers.__getitem__
        out, held, size = [], [], 0
        for s in split:  # some texts at a time, so that a batch of long ones stays small
            held.append(np.fromiter(map(number, s), np.int64, len(s)))
            size += len(s)
            if size > 200_000:
                out.append(self.network.logits(self.responses, *_lay_out(held)))
                held, size = [], 0
        if held:
            out.append(self.network.logits(self.responses, *_lay_out(held)))
        return np.concatenate(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(float) + self.shift, -30, 30)))


def best_cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest range of cuts with the highest F1."""
    if not toxic.any():
        return float(logits.max(initial=0)) + 1.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    ranked = logits[order].astype(float)
    below = np.append(ranked[1:], ranked[-1] - 2.0)
    gap = np.where(ranked > below, ranked - below, -1.0)
    good = (f1 >= f1[gap > 0].max() - 1e-9) & (gap > 0)
    at = int(np.argmax(np.where(good, gap, -1.0)))
    return float((ranked[at] + below[at]) / 2)


def best_bin(counts: dict[int, list[int]]) -> float:
    """``best_cut`` over {bin: [others, toxic]}."""
    bins = np.array(sorted(counts, reverse=True))
    other, toxic = np.array([counts[b] for b in bins]).T
    ranked = bins / BINS
    if not toxic.any():
        return float(ranked.max(initial=0)) + 1.0
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(toxic + other) + toxic.sum())
    below = np.append(ranked[1:], ranked[-1] - 2.0)
    good = f1 >= f1.max() - 1e-9
    at = int(np.argmax(np.where(good, ranked - below, -1.0)))
    return float((ranked[at] + below[at]) / 2)


def drawn_cut(counts: dict[int, list[int]], general: float) -> float:
    """The best cut of some rows, weighed by their toxic rows against a more general cut."""
    positives = sum(bad for _, bad in counts.values())
    if not positives:
        return general
    return (positives * best_bin(counts) + PRIOR_POSITIVES * general) / (positives + PRIOR_POSITIVES)


class Model:
    """A trained network, its calibration and one threshold per language."""

    def __init__(self, network: Network, shift: float, thresholds: dict[str, float]):
        self.network, self.shift, self.thresholds = network, shift, thresholds


def _known(labels: DataFrame, doc_id: str) -> DataFrame:
    """(id, toxic) of labels not held out; a doubly labelled id counts once, with its highest label."""
    return (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )


def _rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), language.alias("lang"))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str):
    """At most SAMPLE labelled rows of each class as (text, lang, toxic), none of them held out."""
    known = _known(labels, doc_id)
    picked = None
    for label, limit in SAMPLE.items():
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(limit)
        picked = own if picked is None else picked.unionByName(own)
    rows = _rows(docs, doc_id, text, lang)
    return rows.join(F.broadcast(picked), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").collect()


def _calibration(rows: DataFrame, known: DataFrame, network: Network, trained: list) -> dict[str, dict[int, list[int]]]:
    """{language: {bin: [others, toxic]}} over all labelled rows but the trained ones; a repeated id counts once."""
    if trained:
        ids = rows.sparkSession.createDataFrame([(i,) for i in trained], rows.select("id").schema)
        known = known.join(F.broadcast(ids), "id", "left_anti")
    marked = rows.join(broadcast_if_small(known, 24), "id")
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def task():
        own = Scorer(shared.value, 0.0)
        return lambda texts: [own.logits(texts).astype(float)]

    scored = add_columns(marked, "text", [("logit", "double")], task).drop("text")
    place = F.round(F.least(F.greatest(F.col("logit"), F.lit(-LARGEST)), F.lit(LARGEST)) * BINS).cast("int")
    once = scored.groupBy("id", "toxic").agg(F.min(F.struct(place.alias("bin"), F.coalesce("lang", F.lit("")).alias("lang"))).alias("s"))
    counts: dict[str, dict[int, list[int]]] = {}
    for r in once.groupBy("s.lang", "s.bin", "toxic").count().collect():
        counts.setdefault(r["lang"], {}).setdefault(r["bin"], [0, 0])[r["toxic"]] += r["count"]
    return counts


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on four fifths of the sample and calibrate on all other labelled rows; None without both classes.

    Scores are shifted so that CUT is the best threshold over all languages, and each language has a threshold of its own. A cut
    found from few toxic rows is drawn towards a more general one by PRIOR_POSITIVES, whatever the number of rows.
    Languages serve only to calibrate thresholds; no score depends on them.
    """
    rows = _sample(docs, labels, doc_id, text, lang)
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    # The last fifth of either class is left to calibration.
    rank = np.zeros(len(rows))
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        rank[own] = np.arange(len(own)) / len(own)
    fitted = rank < 0.8
    network = train([r["text"] for r, f in zip(rows, fitted) if f], toxic[fitted])
    trained = [r["id"] for r, f in zip(rows, fitted) if f]
    del rows
    counts = _calibration(_rows(docs, doc_id, text, lang), _known(labels, doc_id), network, trained)
    every: dict[int, list[int]] = {}
    for own in counts.values():
        for place, (other, bad) in own.items():
            both = every.setdefault(place, [0, 0])
            both[0] += other
            both[1] += bad
    # Training weighs both classes alike, so a logit of zero is even odds.
    overall = drawn_cut(every, 0.0)
    shift = float(np.log(CUT / (1 - CUT))) - overall
    thresholds = {
        language: float(1 / (1 + np.exp(-(drawn_cut(own, overall) + shift)))) for language, own in sorted(counts.items())
    }
    network.embedding = network.embedding.astype(np.float16)
    return Model(network, shift, thresholds)


def add_scores(
    docs: DataFrame,
    model: Model | None,
    text: str = "text",
    lang: str = "lang",
    names: tuple[str, str, str] = ("score", "threshold", "toxic"),
) -> DataFrame:
    """Append score (0 to 1), threshold (of the row's language) and toxic, under ``names``.

    Null and empty texts are scored as texts without words. Without a model, as when no
    labels exist, every score is 0. The weights go to the workers by broadcast; their size
    is fixed by BUCKETS and DIM. Columns of ``docs`` with one of the names are replaced.
    """
    score, threshold, toxic = names
    if model is None:
        scored = docs.withColumn(score, F.lit(0.0))
        cuts = F.lit(CUT)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def task():
            own = Scorer(shared.value.network, shared.value.shift)
            return lambda texts: [own.scores(texts)]

        scored = add_columns(docs, text, [(score, "double")], task)
        cuts = F.lit(CUT)
        for language, cut in model.thresholds.items() if lang in docs.columns else ():
            cuts = F.when(F.col(lang) == language, F.lit(cut)).otherwise(cuts)
    return scored.withColumn(threshold, cuts).withColumn(toxic, F.col(score) >= F.col(threshold))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score stays below their language's threshold, with their own columns."""
    names = ("__score", "__threshold", "__toxic")
    scored = add_scores(docs, fit(docs, labels, doc_id, text, lang), text, lang, names)
    return scored.where(~F.col(names[2])).select(*docs.columns)
