"""Near duplicates of text chunks by an exact set-similarity join.

A chunk is its set of five-word shingles. Equal sets are one class, and links are sought between
classes only. Shingles are ordered by how many sets hold them, the rarest first. Two sets of similarity 85 % or
more share a shingle among the first n - ceil(0.85 n) + 1 of each, so only these prefixes are joined; shingles
of a single set fill a prefix without being moved. Sizes and positions bound the overlap that
a candidate can reach, and what is left is compared exactly. A shingle in very many prefixes is dealt to blocks
that meet in pairs, so no task holds all its sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.session import broadcast_up_to, stage

# Fixed value: the similarity from which chunks are near duplicates, in hundredths.
SIMILARITY = 85
WIDTH = 5
#: Sets of one block of a shingle.
BLOCK = 2048
#: Ids that a join broadcasts, counted first, so that sets stay where they are; beyond it the join is left to the optimizer.
BROADCAST_IDS = 1_000_000


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of the runs of ``width`` words, in order; fewer words are one shingle, none give none."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\r\f]+"), lambda w: w != "")

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
        made = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))
        return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(made))).otherwise(F.array().cast("array<bigint>"))

    # The words of a text are bound to a variable, so that they are split once and not once per shingle.
    return F.transform(F.array(words), of)[0]


def shingle_sets(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(id, set_id, shingles) of every chunk, written once; null texts have no shingle."""
    own = chunks.select(F.col(key).alias("id"), F.coalesce(shingles(F.col(text)), F.array().cast("array<bigint>")).alias("shingles"))
    return stage(own.select("id", F.sha2(F.array_join("shingles", ","), 256).alias("set_id"), "shingles"), "shingle-sets")


def classes(sets: DataFrame) -> DataFrame:
    """(id, class_id, class_size): chunks of equal sets share the smallest id among them; chunks without words are alone."""
    wordy = F.size("shingles") > 0
    found = sets.where(wordy).groupBy("set_id").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return sets.select("id", F.when(wordy, F.col("set_id")).alias("set_id")).join(found, "set_id", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size")
    )


def _prefixes(sets: DataFrame, hundredths: int) -> DataFrame:
    """(shingle, id, n, place): the prefix shingles that more than one set holds."""
    n = F.size("shingles").alias("n")
    held = sets.select("id", n, F.explode("shingles").alias("shingle"))
    shared = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ordered = held.join(shared, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("order"))
    length = F.col("n") - F.expr(f"(n * {hundredths} + 99) div 100") + 1
    ordered = ordered.withColumn("alone", F.col("n") - F.size("order"))
    first = F.slice("order", 1, F.greatest(length - F.col("alone"), F.lit(0)).cast("int"))
    return ordered.select("id", "n", "alone", F.posexplode(first).alias("at", "s")).select(
        F.col("s.shingle").alias("shingle"), "id", "n", (F.col("alone") + F.col("at")).alias("place")
    )


def candidates(sets: DataFrame, hundredths: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b) with a < b: pairs of sets that may reach the similarity; none that does is missing."""
    prefix = stage(_prefixes(sets, hundredths), "prefixes")
    sizes = prefix.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    dealt = prefix.join(sizes.where("m > 1").drop("m"), "shingle").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = dealt.select(
        "shingle", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "place"
    )
    left = unit.select("shingle", "lo", "hi", *[F.col(c).alias(f"{c}_a") for c in ("own", "id", "n", "place")])
    right = unit.select("shingle", "lo", "hi", *[F.col(c).alias(f"{c}_b") for c in ("own", "id", "n", "place")])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    # Shingles before the first shared one are in one set only.
    reach = F.least(n_a - F.col("place_a"), n_b - F.col("place_b"))
    met = left.join(right, ["shingle", "lo", "hi"]).where(
        (F.col("id_a") < F.col("id_b"))
        # Inside a block, or between the two blocks of the unit.
        & ((F.col("lo") == F.col("hi")) | (F.col("own_a") != F.col("own_b")))
        & (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * hundredths)
        & (reach * (100 + hundredths) >= (n_a + n_b) * hundredths)
    )
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(chunks: DataFrame, key: str, text: str, hundredths: int = SIMILARITY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, classes): all pairs (a, b, shared, similarity) of class ids of that similarity or more, and each chunk's class.

    Copies are members of a class and not expanded into pairs. Ids are taken to be unique; null texts
    and texts without words have no links. An empty table gives two empty results.
    """
    sets = shingle_sets(chunks, key, text)
    members = classes(sets)
    copies = stage(members.groupBy("id").agg(F.max(F.col("id") == F.col("class_id")).alias("head")).where("not head").select("id"), "copies")
    wordy = sets.where((F.size("shingles") > 0) & F.col("id").isNotNull()).select("id", "shingles")
    heads = wordy.join(broadcast_up_to(copies, BROADCAST_IDS), "id", "left_anti")
    pairs = stage(candidates(heads, hundredths, block), "candidates")
    # Only sets of a candidate are moved to be compared.
    paired = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    compared = heads.join(broadcast_up_to(paired, BROADCAST_IDS), "id", "left_semi")
    left = compared.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = compared.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.cast("bigint").alias("shared"), (F.size("of_a") + F.size("of_b")).alias("n")
    )
    links = met.where(F.col("shared") * (100 + hundredths) >= F.col("n") * hundredths)
    return links.select("a", "b", "shared", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("similarity")), members
