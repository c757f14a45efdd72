"""Retrieval over document chunks: chunking, TF-IDF vectors, top-k scoring.

The stored tables have columns for these results; the formulas here are this
package's own: raw term counts, idf = ln((1 + N) / (1 + df)) + 1, vectors of
length one, cosine as the score.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditmill.functions.text import strip
from creditmill.session import stage

CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
TOP_K = 5

#: Chunks of a frequent term that meet its idf in one part.
TERM_PART = 100_000
#: Distinct terms whose idf is broadcast, those in the most chunks, counted first.
BROADCAST_VOCABULARY = 1_000_000
#: Frequent terms up to which their parts are broadcast, counted first; beyond it the join is left to the optimizer.
BROADCAST_TERMS = 100_000


def chunk_texts(
    documents: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk of ``size`` blank-separated tokens, sharing ``overlap`` with the next.

    The chunks of a text are cut inside its row and only then exploded, so the
    token list is not copied once per chunk. A text with a token has a chunk, so
    the outer form of explode adds no rows; it keeps the optimizer from adding a
    "not empty" filter that would cut every text a second time.
    """
    tokens = F.split(strip(F.col(text)), r"[ \t\n\r\f]+")
    kept = [name for name in documents.columns if name != text]
    cut = documents.where(strip(F.col(text)) != "").withColumn("_tokens", tokens)
    count = F.size("_tokens")
    starts = F.sequence(F.lit(0), F.greatest(count - overlap - 1, F.lit(0)), F.lit(size - overlap))
    pieces = F.transform(
        starts,
        lambda start: F.struct(
            F.array_join(F.slice("_tokens", start + 1, size), " ").alias("chunk_text"),
            F.least(count - start, F.lit(size)).alias("token_count"),
        ),
    )
    return (
        cut.withColumn("_pieces", pieces)
        .select(*kept, F.posexplode_outer("_pieces").alias("chunk_index", "_piece"))
        .select(*kept, "chunk_index", "_piece.*")
    )


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


@dataclass(frozen=True)
class Vocabulary:
    """The counted terms of all chunks.

    ``counted`` has (key, terms, tfs) in a row per key, ``held`` (term, df). ``common`` has (term, idf) of the terms in the
    most chunks, as many as a broadcast may hold; ``rare`` has (term, df, idf) of the others, if there are any.
    """

    counted: DataFrame
    held: DataFrame
    common: DataFrame
    rare: DataFrame | None


def vocabulary(chunks: DataFrame, key: str, text: str) -> Vocabulary:
    """Texts are shuffled by chunk and their terms counted inside its row, once, into a scratch table that also keeps the
    chunks without a term, so it gives their number too."""
    placed = chunks.select(key, text).repartition(key)
    # A line feed is no letter, so the texts of a repeated key keep their terms.
    whole = placed.groupBy(key).agg(F.concat_ws("\n", F.collect_list(text)).alias("whole"))
    words = whole.select(key, F.sort_array(terms(F.col("whole"))).alias("words")).withColumn("count", F.size("words"))
    at = F.when(F.col("count") > 0, F.sequence(F.lit(0), F.col("count") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(at, lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1)))
    runs = words.select(key, "words", "count", first.alias("first"))
    after = F.concat(F.slice("first", 2, F.greatest(F.col("count"), F.lit(1))), F.array("count"))
    tfs = F.when(F.col("count") > 0, F.zip_with("first", after, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))
    counted = runs.select(key, F.transform("first", lambda i: F.get("words", i)).alias("terms"), tfs.alias("tfs"))
    counted = stage(counted, "term-counts")
    size = counted.count()
    found = counted.select(F.explode("terms").alias("term"))
    held = stage(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-chunks")
    rarity = (F.log(F.lit(1.0 + size) / (F.col("df") + 1.0)) + 1.0).alias("idf")
    digits = held.groupBy(F.length(F.bin("df")).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    least, kept, total = 1 << 62, 0, 0
    for digit, n in sorted(digits.collect(), reverse=True):
        total += n
        if total <= BROADCAST_VOCABULARY:
            least, kept = 1 << (digit - 1), total
    common = held.where(F.col("df") >= least).select("term", rarity)
    return Vocabulary(counted, held, common, held.where(F.col("df") < least).select("term", "df", rarity) if total > kept else None)


def _counts(counted: DataFrame, key: str) -> DataFrame:
    """(key, term, tf)"""
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))
    return counted.select(key, F.inline(pairs).alias("term", "tf"))


def _weight() -> Column:
    return (F.col("tf") * F.col("idf")).alias("weight")


def _rare_weights(own: Vocabulary, key: str) -> DataFrame:
    """(key, term, weight) of the rare terms. No more than BROADCAST_VOCABULARY terms are in twice as many chunks as any of
    them, so these are few rows; a term of more than TERM_PART chunks is dealt, by a hash of the chunk, to as many parts as
    it needs, each of which gets the term's idf."""
    rows = _counts(own.counted, key).join(F.broadcast(own.common.select("term")), "term", "left_anti")
    parts = F.ceil(F.col("df") / TERM_PART).cast("int")
    idf = own.rare.select("term", "idf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    frequent = own.rare.where(F.col("df") > TERM_PART).select("term", parts.alias("parts"))
    if frequent.count() <= BROADCAST_TERMS:
        frequent = F.broadcast(frequent)
    part = F.pmod(F.xxhash64(key), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows.join(frequent, "term", "left").withColumn("part", part)
    return dealt.join(idf, ["term", "part"]).select(key, "term", _weight())


def tfidf_weights(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight) with idf applied, before normalisation.

    The idf of common terms is broadcast, so that the terms of a chunk stay together; only rare terms are moved.
    """
    own = vocabulary(chunks, key, text)
    weights = _counts(own.counted, key).join(F.broadcast(own.common), "term").select(key, "term", _weight())
    return weights if own.rare is None else weights.unionByName(_rare_weights(own, key))


def weighted_terms(own: Vocabulary, key: str) -> DataFrame:
    """(key, entries): the (term, weight) of each chunk with a term, in order of the terms.

    Chunks are shuffled as lists, in one row each; their terms then meet the common idf and are put together again where
    they are. The weights of rare terms are moved to them.
    """
    entries = F.collect_list(F.struct("term", "weight"))
    # A structure, as rows without a key are put together, too.
    placed = own.counted.select(F.struct(key).alias("of"), "terms", "tfs").repartition("of")
    lists = _counts(placed, "of").join(F.broadcast(own.common), "term").select("of", "term", _weight())
    lists = lists.groupBy("of").agg(entries.alias("entries"))
    if own.rare is not None:
        rare = _rare_weights(own, key).select(F.struct(key).alias("of"), "term", "weight").repartition("of")
        lists = lists.join(rare.groupBy("of").agg(entries.alias("others")), "of", "full")
        none = F.array().cast(lists.schema["entries"].dataType)
        lists = lists.select("of", F.concat(F.coalesce("entries", none), F.coalesce("others", none)).alias("entries"))
    return lists.select(F.col("of").getField(key).alias(key), F.sort_array("entries").alias("entries"))


def per_length(entries: str, made: Callable[[Column, Column], Column]) -> Column:
    """What ``made`` gives for each (term, weight) of a chunk and the length of its vector.

    The length is an argument of the list's function, as the optimizer would put it inside and sum anew for each term.
    """
    length = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["weight"] * e["weight"]))
    return F.zip_with(entries, F.array_repeat(length, F.size(entries)), made)


def tfidf_vectors(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tfidf_vector): a term-to-weight map of length one per chunk.

    A map holds the terms of one chunk, so its size is bounded by the chunk size.
    """
    lists = weighted_terms(vocabulary(chunks, key, text), key)
    scaled = per_length("entries", lambda e, n: F.struct(e["term"].alias("key"), (e["weight"] / n).alias("value")))
    return lists.select(key, F.map_from_entries(scaled).alias("tfidf_vector"))


def _ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each query; Spark keeps only k per task before the shuffle.

    Sums depend on their order beyond the twelfth decimal, so closer scores are ties and go to the smaller key.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tfidf_top_k(
    chunks: DataFrame, key: str, text: str, queries: Mapping[str, str], k: int = TOP_K
) -> DataFrame:
    """(query_id, key, score, rank) for a handful of query texts given by the caller.

    A query's score of a chunk is the sum of the weights of its distinct terms, over the chunk's
    length and the square root of their number. One aggregate per chunk gives its length and
    all sums; chunks without any of the terms are left out.
    """
    weights = tfidf_weights(chunks, key, text)
    wanted = {q: F.array_distinct(terms(F.lit(t))) for q, t in queries.items()}
    weight = F.col("weight")
    sums = weights.groupBy(key).agg(
        F.sqrt(F.sum(weight * weight)).alias("norm"),
        *[
            F.sum(F.when(F.array_contains(own, F.col("term")), weight).otherwise(0.0)).alias(f"q{i}")
            for i, own in enumerate(wanted.values())
        ],
    )
    scores = [
        F.struct(F.lit(q).alias("query_id"), (F.col(f"q{i}") / F.col("norm") / F.sqrt(F.size(own))).alias("score"))
        for i, (q, own) in enumerate(wanted.items())
    ]
    scored = sums.select(key, F.explode(F.array(*scores)).alias("hit")).select("hit.*", key)
    return _ranked(scored.where("score > 0"), key, k)


def cosine(left: Column, right: Sequence[float]) -> Column:
    fixed = F.array(*[F.lit(float(x)) for x in right])
    length = sum(float(x) ** 2 for x in right) ** 0.5
    products = F.zip_with(left, fixed, lambda a, b: a.cast("double") * b)
    dot = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    squares = F.aggregate(
        left, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.try_divide(dot, F.sqrt(squares) * F.lit(length))


def vector_top_k(
    vectors: DataFrame,
    key: str,
    column: str,
    queries: Mapping[str, Sequence[float]],
    k: int = TOP_K,
) -> DataFrame:
    """The k stored vectors closest by cosine to each of a handful of query vectors."""
    scores = [
        F.struct(
            F.lit(query_id).alias("query_id"),
            cosine(F.col(column), vector).alias("score"),
        )
        for query_id, vector in queries.items()
    ]
    scored = vectors.select(key, F.explode(F.array(*scores)).alias("hit")).select("hit.*", key)
    return _ranked(scored, key, k)


def retrieval_scores(chunks: DataFrame) -> DataFrame:
    """(explanation_id, retrieval_scores): document-to-score map of each explanation.

    An explanation retrieves k chunks, so a map has k entries. The rows are shuffled once, by explanation; both
    groupings are then in place.
    """
    entry = F.struct("document_id", F.col("retrieval_score").cast("double"))
    own = chunks.select("explanation_id", "document_id", "retrieval_score").repartition("explanation_id")
    best = own.groupBy("explanation_id", "document_id").agg(
        F.max("retrieval_score").alias("retrieval_score")
    )
    return best.groupBy("explanation_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("retrieval_scores")
    )
