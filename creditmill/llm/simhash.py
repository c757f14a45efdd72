"""SimHash fingerprints and their near duplicates by bit-sliced comparison.

A fingerprint has the bits that more than half of a text's shingle hashes set.
Bits are cut into two parts more than the radius, so two fingerprints within it agree on
two parts at least (radius 2: on two of four 16-bit parts). Every fingerprint is filed under all
pairs of its parts, and only files with several fingerprints are compared. A file is
compared vertically: 64 bit planes over all its lanes, one machine word holding a bit
of 64 lanes. Lane i meets lane i+k for k = 1, 2, ...; carry-save counters add the
planes' differences for 64 pairs at once, and words whose pairs all exceed the
radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import add_columns, broadcast_if_small, stage
from creditmill.llm.components import connected_components

RADIUS = 2
#: Fingerprints of one block; a larger file is compared block by block.
BLOCK = 2048
#: Lanes that are compared together before the next files are taken.
LANES = 16384
HASH_SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text; zero for null and for no words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i : i + count] for i in range(min(width, len(words))))))
    digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(HASH_SEED)))
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    totals = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 15):
        totals += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > count).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def add_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint_bits") -> DataFrame:
    """Append the fingerprint of whole texts as a signed 64-bit column."""

    def task():
        return lambda texts: [[_signed(fingerprint(t, width)) for t in texts]]

    return add_columns(docs, text, [(name, "bigint")], task)


class Planes:
    """Bit planes over lanes; 64 lanes share a word."""

    #: From all four parts in turn, so that files agreeing on two are told apart early.
    ORDER = [part * 16 + bit for bit in range(16) for part in range(4)]

    def __init__(self, values: np.ndarray):
        self.lanes = len(values)
        self.words = -(-self.lanes // 64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        padded = np.zeros((64, (self.words * 2 + 2) * 64), np.uint8)
        padded[:, : self.lanes] = bits.T
        self.planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def within(self, shift: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Lanes i, of those wanted, whose distance to lane i + shift is at most radius."""
        packed = np.zeros(self.words * 64, np.uint8)
        packed[: len(wanted)] = wanted
        packed = np.packbits(packed, bitorder="little").view("<u8")
        at = np.flatnonzero(packed)
        over = ~packed[at]
        skip, rest = divmod(shift, 64)
        # The counters hold saturating counts of up to four; more bits for larger radii.
        counters = [np.zeros(len(at), np.uint64) for _ in range(max(1, (radius + 1).bit_length()))]
        for step, plane in enumerate(self.ORDER):
            row = self.planes[plane]
            other = row[at + skip]
            if rest:
                other = (other >> np.uint64(rest)) | (row[at + skip + 1] << np.uint64(64 - rest))
            carry = row[at] ^ other
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if step % 4 == 3:
                far = over | _above(counters, radius)
                left = far != np.uint64(0xFFFFFFFFFFFFFFFF)
                alive = int(left.sum())
                if not alive:
                    return np.empty(0, np.int64)
                if alive * 2 <= len(at):
                    at, over, counters = at[left], over[left], [c[left] for c in counters]
        near = ~(over | _above(counters, radius))
        lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, lane = np.nonzero(lanes)
        return at[word] * 64 + lane


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius, most significant counter first."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def link_lanes(values: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Per lane the first lane of its group that it reaches by links.

    Lanes are sorted by group. Pairs that are known to be connected are not
    compared again, which leaves every connection as it is.
    """
    lanes = np.arange(len(values))
    ends = np.searchsorted(group, group, side="right")
    parent = lanes.copy()
    planes = Planes(values)
    shift, longest = 1, int((ends - lanes).max(initial=0))
    while shift < longest:
        wanted = np.zeros(len(lanes), bool)
        reach = lanes[: len(lanes) - shift]
        wanted[: len(reach)] = (reach + shift < ends[: len(reach)]) & (parent[reach] != parent[reach + shift])
        if wanted.any():
            found = planes.within(shift, wanted, radius)
            for a, b in zip(found.tolist(), (found + shift).tolist()):
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
            if len(found):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
        shift += 1
    return parent


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def edges(table: pa.Table) -> pa.RecordBatch:
            unit = table.column("unit").to_numpy()
            rep = table.column("rep").to_numpy()
            root = link_lanes(table.column("bits").to_numpy().view(np.uint64), unit, radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["a", "b"]
            )

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < LANES:
                continue
            unit = held.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if whole:
                yield edges(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield edges(held)

    return run


def near_fingerprints(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between ids of distinct fingerprints, enough to connect all near ones.

    ``found`` has ``bits`` (distinct) and ``rep`` (an id, not null). A file
    of n fingerprints becomes n/BLOCK blocks, compared in pairs, so no task
    holds more than two blocks of one file; which links come out depends on nothing but
    the fingerprints. Only spanning links leave a task, never all its pairs.
    """
    count = radius + 2
    if not 3 <= count <= 16:
        raise ValueError("a radius of 1 to 14 bits")
    edges = [64 * i // count for i in range(count + 1)]
    parts = [
        F.shiftrightunsigned("bits", low).bitwiseAND((1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])
    ]
    keys = [
        F.lit(n << 44) + parts[i] * (1 << 22) + parts[j] for n, (i, j) in enumerate(combinations(range(count), 2))
    ]
    filed = found.select("bits", "rep", F.explode(F.array(*keys)).alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("bits"), F.col("blocks"))
    units = (
        filed.join(shared, "key")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("blocks = 1 or own <> other")
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
            "bits",
            "rep",
        )
    )
    dealt = units.repartition("unit").sortWithinPartitions("unit", "bits")
    return dealt.mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint_bits, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over fingerprints that differ in
    at most ``radius`` bits. Repeated ids keep their rows. Null and wordless texts have fingerprint
    zero and link as any other. Rows without an id link with nothing and
    get a null component. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return components_of(stage(add_fingerprints(narrow, width=width).drop("text"), "fingerprints"), radius)


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` for rows (doc_id, fingerprint_bits) that exist already."""
    distinct = stage(
        prints.where("doc_id is not null")
        .groupBy(F.col("fingerprint_bits").alias("bits"))
        .agg(F.min("doc_id").alias("rep")),
        "distinct",
    )
    components = connected_components(near_fingerprints(distinct, radius))
    named = distinct.join(components, distinct.rep == components.node, "left").select(
        F.col("bits").alias("fingerprint_bits"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fingerprint_bits", "left").select(
        "doc_id",
        "fingerprint_bits",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, with its own columns.

    Rows that share an id and a fingerprint count once; rows without an id stay. Fingerprints are computed
    again for the rows instead of being kept with their texts, and only the keys of dropped rows are joined.
    """
    name = "__fingerprint"
    marked = add_fingerprints(docs, text, width, name)
    prints = stage(marked.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("fingerprint_bits")), "fingerprints")
    groups = stage(
        components_of(prints, radius).groupBy("doc_id", "fingerprint_bits").agg(
            F.count("*").alias("n"), F.first("component_id").alias("component_id")
        ).where("component_id is not null and (n > 1 or doc_id <> component_id)"),
        "groups",
    )
    keys = groups.select(F.col("doc_id").alias("__id"), F.col("fingerprint_bits").alias("__bits"), (F.col("doc_id") == F.col("component_id")).alias("__first"))

    def joined(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        return rows.join(side, (rows[doc_id] == side["__id"]) & (rows[name] == side["__bits"]), how)

    kept = joined(marked, broadcast_if_small(keys, 24), "left_anti")
    repeated = keys.where("__first")
    if not repeated.isEmpty():
        again = joined(marked, broadcast_if_small(repeated, 24), "left_semi")
        kept = kept.unionByName(again.dropDuplicates([doc_id, name]))
    return kept.select(*docs.columns)
