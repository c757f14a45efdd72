"""Spelling variants: words one edit apart, each led to its most frequent form.

Two words one edit apart whose shorter one has m code points agree on the first m // 2 of them or
on the last m - m // 2. So every word is filed under both parts, once as the shorter and once
as the longer of a pair, and pairs are sought inside files. A file of more than FILE words is cut
again by the same rule applied to the part that is still open, until files are small or one
code point is open, which bounds a file by the alphabet. The length of a pair's common
prefix tells the one file that reports it.

Inside a file the words are sorted. One scan per word goes through the list, keeps the rows of the banded
edit matrix by prefix length, takes up the row at the length of the prefix shared with the word before, and
skips all words that share a prefix already beyond one edit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import stage

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs this many times as often as the word, at least.
RATIO = 2
#: Divisor of the hash that says which occurrences lose a code point.
NOISE = 97
#: Words of a file beyond which it is cut again.
FILE = 256
#: Distinct words that a counting task holds before it passes partial counts on.
HELD = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_LAST = chr(0x10FFFF)


def document_words(doc_id, text: str | None) -> Counter[str]:
    """Words of one text of at least LEAST_LENGTH code points, with their counts; null has none.

    Runs of letters with A-Z lowered; where NOISE divides the hash of id and run, the run loses the code point
    that the hash points at. Without an id nothing is lost.
    """
    found: Counter[str] = Counter()
    if not text:
        return found
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
        if len(run) < LEAST_LENGTH:
            continue
        if start is not None:
            h = zlib.crc32(run.encode(), start)
            if h % NOISE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
        found[run] += n
    return found


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all texts, for words that occur ``least`` times or more; tasks pass on partial counts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for own, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in document_words(own, one).items():
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(doc_id, text).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _file_key() -> Column:
    """What the words of a file share: length of the shorter word, both shared parts and where the open part lies."""
    return F.concat_ws("\t", "m", "low", "high", F.substr("word", F.lit(1), F.col("low")), F.right("word", F.col("high")))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row filed twice: with the first half of its open part shared, and with the second.

    A pair belongs to the second file only if it does not share the first half, so ``bound``, the length of
    prefix that its pairs must not reach, falls to the end of that half.
    """
    half = F.expr("(m - low - high) div 2").cast("int")
    first = F.struct((F.col("low") + half).alias("low"), F.col("high"), F.col("bound"))
    second = F.struct(F.col("low"), (F.col("m") - F.col("low") - half).alias("high"), F.least("bound", F.col("low") + half).alias("bound"))
    return rows.withColumn("_cut", F.explode(F.array(first, second))).select("word", "n", "m", "_cut.*").withColumn("key", _file_key())


def file_words(counts: DataFrame, limit: int = FILE) -> DataFrame:
    """(key, m, low, high, bound, word, n): the files in which all pairs one edit apart meet.

    Files above ``limit`` are cut again; a round halves the open part, so rounds are few whatever
    the number of words. Words alone in their file are left out.
    """
    length = F.length("word")
    shorter = F.explode(F.array(length, length - 1)).alias("m")
    whole = counts.select("word", "n", shorter).select("word", "n", "m", *(F.lit(0).alias(c) for c in ("low", "high")), F.lit(1 << 30).alias("bound"))
    done, now = [], _halved(whole)
    while True:
        now = stage(now, "spelling-files")
        sizes = now.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        sized = now.join(sizes, "key")
        wide = (F.col("size") > limit) & (F.col("m") - F.col("low") - F.col("high") > 1)
        done.append(sized.where(~wide).drop("size"))
        large = sized.where(wide).drop("size")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        now = _halved(large)


def pairs_of_file(words: list[str], m: int, low: int, high: int, bound: int) -> Iterator[tuple[int, int]]:
    """Positions i < j of words of a file one edit apart, the shorter of m code points, sharing less than ``bound`` at the start.

    ``words`` are sorted and distinct, of m or m + 1 code points, and share ``low`` code points at the start
    and ``high`` at the end; only what lies between is compared.
    """
    # The shared end is cut off; order within the open parts need not be that of the words.
    order = sorted(range(len(words)), key=lambda i: words[i][low : len(words[i]) - high])
    own = [words[i][low : len(words[i]) - high] for i in order]
    n = len(own)
    lcp = [0] * n
    for i in range(1, n):
        a, b = own[i - 1], own[i]
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        lcp[i] = k
    rest = m - low - high
    for q in range(n - 1):
        query = own[q]
        size = len(query)
        # rows[d]: edits between the first d code points of the list's word and the query's first d - 1, d, d + 1.
        rows: list[tuple[int, int, int]] = [(2, 0, 1)]
        i, shared = q + 1, lcp[q + 1]
        fresh = True
        while i < n:
            word = own[i]
            if fresh:
                # What the word shares with the query is on the diagonal: no edit there.
                rows = [(1 if d else 2, 0, 1) for d in range(shared + 1)]
                fresh = False
            del rows[shared + 1 :]
            below, on, above = rows[-1]
            depth, end = len(rows) - 1, len(word)
            while depth < end:
                c = word[depth]
                depth += 1
                # Columns depth - 1, depth and depth + 1 of the query.
                left = 1 + on
                if depth >= 2 and depth - 2 < size:
                    left = min(left, below + (c != query[depth - 2]))
                middle = min(1 + above, on + (c != query[depth - 1]) if depth - 1 < size else 2, 1 + left)
                right = min(above + (c != query[depth]) if depth < size else 2, 1 + middle)
                below, on, above = min(left, 2), min(middle, 2), min(right, 2)
                rows.append((below, on, above))
                if below > 1 and on > 1 and above > 1:
                    break
            else:
                gap = size - end
                if -1 <= gap <= 1 and rows[end][gap + 1] == 1 and min(size, end) == rest:
                    a, b = sorted((order[q], order[i]))
                    if _common(words[a], words[b]) < bound:
                        yield a, b
                i += 1
                shared = lcp[i] if i < n else 0
                continue
            # All words that go on with this prefix are further than one edit.
            j = bisect_left(own, word[:depth] + _LAST, i + 1)
            shared = min(lcp[j], depth - 1) if j < n else 0
            i = j


def _common(a: str, b: str) -> int:
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    return k


_FILE_COLUMNS = ("key", "m", "low", "high", "bound", "word", "n")


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the files of a partition, which come sorted by key and word."""
    key, head, words, counts = None, None, [], []

    def pairs() -> pa.RecordBatch:
        found = list(pairs_of_file(words, *head)) if len(words) > 1 else []
        a, b = ([p[i] for p in found] for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in a], pa.string()), pa.array([counts[i] for i in a], pa.int64()), pa.array([words[i] for i in b], pa.string()), pa.array([counts[i] for i in b], pa.int64())],
            names=["a", "n_a", "b", "n_b"],
        )

    for batch in batches:
        for k, m, low, high, bound, word, n in zip(*(batch.column(c).to_pylist() for c in range(len(_FILE_COLUMNS)))):
            if k != key:
                if len(words) > 1:
                    yield pairs()
                key, head, words, counts = k, (m, low, high, bound), [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield pairs()


def near_words(counts: DataFrame, limit: int = FILE) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words one edit apart, each once."""
    filed = file_words(counts, limit).select(*_FILE_COLUMNS)
    dealt = filed.repartition("key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(_near_pairs, "a string, n_a bigint, b string, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last.

    Counts at least double along a chain, so a few rounds of pointer doubling reach its end.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moves"))
        after = stage(moved, "roots")
        if after.where("moves").isEmpty():
            return after.drop("moves")
        now = after.drop("moves")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    A word's form is the most frequent of the words one edit apart, of equal ones the smallest, if it occurs RATIO
    times as often; else null, as is form_n. Null and empty texts have no words; repeated rows count each;
    an empty table gives an empty result.
    """
    counts = stage(count_words(docs, doc_id, text), "spelling-counts")
    pairs = near_words(counts)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")),
    )
    near = pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("order"), F.col("other").alias("other"))).alias("best")
    )
    enough = -F.col("best.order") >= RATIO * F.col("n")
    rows = counts.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    rows = stage(rows, "spelling-forms")
    led = roots(rows.where("form is not null"))
    return rows.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
