"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame operations only.

A window of an item occurs in a document only where all its words do, so one
necessary word of each window suffices as its prefix: the rarest by document words.
Occurrences of these words are joined with the windows, the word's offset bounds the place of the window, the
document's length bounds its end, and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import BROADCAST_BYTES, broadcast_if_small, stage

WINDOW = 10
#: Bytes of a value's and a row's bookkeeping in a broadcast, beside its characters.
VALUE_BYTES, ROW_BYTES = 24, 64
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text as they are written; null has none. Case is folded where words are compared."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def _fold(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def _key(word: Column) -> Column:
    """A join key that equal words share; ``lower`` folds more than A-Z and is fast. Equality is verified."""
    return F.lower(word)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): distinct windows with the ids of their items; items without words have none."""
    split = items.select(F.col(item_id).alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    one = split.select("item", "w", F.explode(starts).alias("start")).select(
        "item", F.transform(F.slice("w", F.col("start"), window), _fold).alias("words")
    )
    return one.groupBy("words").agg(F.collect_set("item").alias("items"))


def _bytes(*texts: Column) -> Column:
    """Bytes that the rows of a frame take in a broadcast: arrays of texts and texts, UTF-8, with their bookkeeping."""
    total = F.lit(ROW_BYTES)
    for text in texts:
        total = total + F.octet_length(text) + VALUE_BYTES
    return F.coalesce(F.sum(total), F.lit(0))


def _rarest(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows with their rarest word (ties: the first) and its offset."""
    vocabulary = windows.select(F.explode("words").alias("word")).select(_key(F.col("word")).alias("word")).distinct()
    seen = docs.select(F.explode("doc_words").alias("word")).select(_key(F.col("word")).alias("word"))
    vocabulary = stage(vocabulary, "window-words")
    if vocabulary.agg(_bytes(F.col("word"))).first()[0] <= BROADCAST_BYTES:
        vocabulary = F.broadcast(vocabulary)
    counts = seen.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("words", "items", F.posexplode("words").alias("offset", "word")).withColumn("word", _key(F.col("word")))
    counted = placed.join(counts, "word", "left")
    first = F.min_by(F.struct("word", "offset"), F.struct(F.coalesce("n", F.lit(0)), "offset"))
    return counted.groupBy("words").agg(first.alias("prefix"), F.first("items").alias("items")).select(
        F.col("prefix.word").alias("word"), F.col("prefix.offset").alias("offset"), "words", "items"
    )


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    carry: Column | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``carry`` also carried.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.
    Words within any occurrence of a window are hit, each once. Null and empty texts have no words and no
    hits; repeated rows and ids keep their rows; an empty benchmark hits nothing. Items
    without an id count as hits without an item.
    """
    held = F.lit(None).cast("bigint") if carry is None else carry
    base = docs.select(F.col(doc_id).alias("doc_id"), held.alias("carried"), words_of(F.col(text)).alias("doc_words"))
    windows = stage(_rarest(item_windows(items, item_id, item_text, window), base), "windows")
    # Every document meets the entry of the empty word once, which keeps documents without hits.
    by_word = windows.select("word", F.struct("offset", "words", "items").alias("w"))
    marker = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast(by_word.schema["w"].dataType).alias("w"))
    lookup = by_word.unionByName(marker)
    told = F.concat_ws(" ", "words", F.transform("items", lambda i: i.cast("string")))
    size = windows.agg(_bytes(told) + F.coalesce(F.sum((F.size("words") + F.size("items")) * VALUE_BYTES), F.lit(0))).first()[0]
    rows = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "carried", "doc_words", F.size("doc_words").cast("bigint").alias("n_words")
    )
    places = (
        rows.select("*", F.posexplode(F.concat("doc_words", F.array(F.lit("")))).alias("place", "word"))
        .withColumn("word", _key(F.col("word")))
        .withColumn("first", F.lit(0))
    )
    if size <= BROADCAST_BYTES:
        met = places.join(F.broadcast(lookup), "word")
    else:  # a join that shuffles carries the words around the place, not the document
        first = F.greatest(F.col("place") - (window - 1), F.lit(0))
        near = F.slice("doc_words", first + 1, 2 * window - 1)
        met = places.withColumn("first", first).withColumn("doc_words", near).join(lookup, "word")
    start = F.col("place") - F.col("w.offset")
    fits = (start >= 0) & (start + F.size("w.words") <= F.col("n_words"))
    words = F.slice("doc_words", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size("w.words"))
    same = _fold(F.array_join(words, " ")) == F.array_join("w.words", " ")
    found = met.where(F.col("w").isNull() | (fits & same)).select(
        "row",
        "doc_id",
        "carried",
        "n_words",
        F.when(F.col("w").isNotNull(), F.struct(start.alias("a"), (start + F.size("w.words")).alias("b"))).alias("span"),
        F.col("w.items").alias("items"),
    )
    gathered = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("carried").alias("carried"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["b"]).alias("end"),
            (s["total"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("total"),
        ),
        lambda s: s["total"],
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return gathered.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *([] if carry is None else ["carried"]),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with their own columns.

    A dropped row is known by its id and a hash of its text, so rows that repeat an id are judged each by itself.
    """
    mark = F.xxhash64(F.col(text))
    hit = find_passages(docs, items, doc_id, text, carry=mark).where("contaminated")
    keys = stage(hit.select(F.col("doc_id").alias("__id"), F.col("carried").alias("__mark")).distinct(), "contaminated")
    keys = broadcast_if_small(keys, 24)
    return docs.join(keys, F.col(doc_id).eqNullSafe(keys["__id"]) & (mark == keys["__mark"]), "left_anti")


def oracle_sql(window: int = WINDOW) -> str:
    """The same rows in DuckDB, from all windows of all documents."""
    words = (
        "list_filter(string_split_regex(translate(coalesce(text, ''), "
        f"'{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + {window - 1}], ' ') AS t, least(len(w), {window}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS s FROM items WHERE len(w) > 0) AS i
),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n) AS d
),
found AS (SELECT DISTINCT r, s, n, item_id FROM grams JOIN windows USING (t, n)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM found) AS f GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) AS f GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
