"""Lines of many documents dropped, reversibly, by sharded cuckoo filters over exact reference counts.

A line's key is the line without ASCII white space at its ends and with A-Z lowered. The exact
table counts the documents of every key (128-bit digests); keys in at least ``threshold`` documents are
members of the cuckoo filter of their shard. A cuckoo filter forgets as well as it learns, so
documents can be added to and deleted from an index: counts go up and down, and
the keys that cross the threshold enter or leave the filters. Keys below the
threshold that a filter takes for members are found in the exact table and kept as exceptions, so a
test against filter and exceptions is exact.

Documents are rewritten by a map with the filters broadcast while filters and exceptions
measure up to FILTER_BYTES; beyond it the keys of distinct texts are dealt to the shards instead.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.llm.common import add_columns, stage

THRESHOLD = 10
#: Keys of the exact table per shard; filters hold only those at the threshold.
SHARD_KEYS = 1_000_000
#: Bytes of filters and exceptions up to which documents are rewritten by a map.
FILTER_BYTES = 64 << 20
#: Distinct keys that a counting task holds before it passes partial counts on.
HELD = 200_000
SLOTS = 4
KICKS = 500
#: Share of its slots that a filter fills at most when it is built.
LOAD = 0.8
#: Parts that equal texts are dealt to when dropped keys come back by a join.
SALTS = 32
_BLANKS = b" \t\n\r\x0b\x0c"
_DIGEST = 16


def line_keys(text: str | None) -> tuple[list[str], list[bytes]]:
    """The lines of a text and their keys; null and empty texts are one empty line."""
    lines = (text or "").split("\n")
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    return lines, [line.strip(_BLANKS) for line in raw]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=_DIGEST).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class CuckooFilter:
    """A set of 128-bit keys by 32-bit marks in buckets of four slots; it can forget keys it was given.

    The second bucket of a mark follows from the first and the mark alone. A mark that
    no kick can place is held apart, so no key that was given is ever denied.
    """

    def __init__(self, keys: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint32)
        self.apart: list[tuple[int, int]] = []

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, first bucket, second bucket) of keys."""
        high = high.view(np.uint64)
        mark = np.maximum((high & np.uint64(0xFFFFFFFF)).astype(np.uint32), 1)
        first = (high >> np.uint64(32)) & np.uint64(self.buckets - 1)
        return mark, first.astype(np.int64), self._other(first, mark)

    def _other(self, bucket, mark):
        jump = (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)
        return (np.asarray(bucket, np.uint64) ^ jump).astype(np.int64)

    def insert(self, low: np.ndarray, high: np.ndarray) -> None:
        random = np.random.default_rng(len(low))
        for mark, first, second in zip(*(x.tolist() for x in self.places(low, high))):
            for bucket in (first, second):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = second
                for _ in range(KICKS):
                    slot = int(random.integers(SLOTS))
                    mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                    bucket = int(self._other(bucket, mark))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    self.apart.append((bucket, mark))

    def delete(self, low: np.ndarray, high: np.ndarray) -> None:
        """Forget keys that were inserted before."""
        for mark, first, second in zip(*(x.tolist() for x in self.places(low, high))):
            for bucket in (first, second):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                for bucket in (first, second):
                    if (bucket, mark) in self.apart:
                        self.apart.remove((bucket, mark))
                        break

    def contains(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(low, high)
        found = ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)
        for bucket, held in self.apart:
            found |= (mark == held) & ((first == bucket) | (second == bucket))
        return found

    @property
    def crowded(self) -> bool:
        return bool(self.apart)

    def to_bytes(self) -> bytes:
        apart = np.array(self.apart, "<i8").reshape(-1, 2)
        return np.array([self.buckets, len(apart)], "<i8").tobytes() + apart.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        own = cls(1)
        buckets, apart = np.frombuffer(data, "<i8", 2).tolist()
        own.buckets = buckets
        own.apart = [tuple(x) for x in np.frombuffer(data, "<i8", 2 * apart, 16).reshape(-1, 2).tolist()]
        own.table = np.frombuffer(data, "<u4", offset=16 + 16 * apart).reshape(buckets, SLOTS).copy()
        return own


@dataclass(frozen=True)
class LineIndex:
    """Staged tables: counts (shard, low, high, n), filters (shard, data), exceptions (shard, low, high)."""

    counts: DataFrame
    filters: DataFrame
    exceptions: DataFrame
    shards: int
    threshold: int

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index with these documents added."""
        return self._changed(count_lines(docs, text), 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """The index with these documents, inserted before, taken out again."""
        return self._changed(count_lines(docs, text), -1)

    def _changed(self, change: DataFrame, sign: int) -> LineIndex:
        """Counts moved by a change, and filters by the keys that cross the threshold.

        Shards are dealt anew once they hold twice their keys; a crowded filter is built
        again at its new size from the exact table.
        """
        shard = F.pmod("low", F.lit(self.shards)).cast("int")
        delta = change.select(shard.alias("shard"), "low", "high", F.lit(0).alias("old"), (F.col("n") * sign).alias("moved"))
        before = self.counts.select("shard", "low", "high", F.col("n").alias("old"), F.lit(0).alias("moved"))
        both = before.unionByName(delta).groupBy("shard", "low", "high").agg(F.sum("old").alias("old"), F.sum("moved").alias("moved"))
        both = stage(both.withColumn("n", F.col("old") + F.col("moved")), "line-changes")
        counts = both.where("n > 0").select("shard", "low", "high", "n")
        if counts.count() > 2 * SHARD_KEYS * self.shards:
            return _indexed(counts.select("low", "high", "n"), self.threshold)
        up = both.where((F.col("old") < self.threshold) & (F.col("n") >= self.threshold))
        down = both.where((F.col("old") >= self.threshold) & (F.col("n") < self.threshold))
        moves = up.select("shard", "low", "high", F.lit(True).alias("enters")).unionByName(down.select("shard", "low", "high", F.lit(False).alias("enters")))
        filters = stage(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(_updated, _FILTERS), "line-filters")
        crowded = filters.where("crowded").select("shard")
        if not crowded.isEmpty():
            members = counts.where(F.col("n") >= self.threshold).join(crowded, "shard", "left_semi")
            rebuilt = members.groupBy("shard").applyInArrow(_built, _FILTERS)
            filters = stage(filters.where("not crowded").unionByName(rebuilt), "line-filters")
        changed = replace(self, counts=counts, filters=filters)
        return replace(changed, exceptions=_exceptions(changed))

    def apply(self, docs: DataFrame, text: str = "text", names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
        """Append lines before dropping, lines dropped, and the kept lines joined, under ``names``.

        Null and empty texts are one empty line, which is never dropped. Columns with one of the names are replaced.
        """
        if self.exact_bytes() <= FILTER_BYTES:
            return self._mapped(docs, text, names)
        return self._dealt(docs, text, names)

    def exact_bytes(self) -> int:
        """Bytes of the filters and exceptions, which a map would broadcast."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        return size + _DIGEST * self.exceptions.count()

    def _mapped(self, docs: DataFrame, text: str, names: tuple[str, str, str]) -> DataFrame:
        spark = docs.sparkSession
        filters = {r["shard"]: bytes(r["data"]) for r in self.filters.select("shard", "data").collect()}
        exceptions = {_joined(r["low"], r["high"]) for r in self.exceptions.select("low", "high").collect()}
        shared, shards = spark.sparkContext.broadcast((filters, exceptions)), self.shards

        def task():
            data, but = shared.value
            member = _tester({s: CuckooFilter.from_bytes(d) for s, d in data.items()}, shards, but)

            def run(texts):
                split = [line_keys(t) for t in texts]
                dropped = member({k for _, keys in split for k in keys})
                return _rewritten(split, repeat(dropped))

            return run

        return add_columns(docs, text, _fields(names), task)

    def _dealt(self, docs: DataFrame, text: str, names: tuple[str, str, str]) -> DataFrame:
        """The same rows by shuffles: keys of distinct texts meet their shard's filter, dropped ones come back to the texts.

        A shard is dealt to as many parts as its keys and texts need, so a line of a third of all documents is many tasks' work.
        """
        own, salt, packed = (_unused(c, docs.columns) for c in ("__own", "__salt", "__packed"))
        key = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        texts = docs.select(key.alias("own"), F.col(text).alias("text"))
        asked = stage(texts.mapInArrow(_asked(self.shards), _ASKED).distinct(), "line-keys")
        parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("parts"))
        parts = stage(parts, "line-parts")
        asked = asked.join(parts, "shard").select(*asked.columns, F.pmod(F.xxhash64("own"), F.col("parts")).cast("int").alias("part"))
        many = parts.select("shard", F.col("parts").alias("many"))
        filters = self.filters.join(many, "shard").select("shard", "data", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("part"))
        met = filters.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_passing, _ASKED)
        true = met.join(self.exceptions, ["shard", "low", "high"], "left_anti")
        back = true.groupBy(F.col("own").alias(own)).agg(F.collect_set(F.struct("low", "high")).alias(packed))
        back = back.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        told = docs.withColumns({own: key, salt: place}).join(back, [own, salt], "left")
        keys = F.col(packed)
        told = told.withColumn(packed, F.struct(F.col(text).alias("text"), keys["low"].alias("low"), keys["high"].alias("high")))

        def task():
            def run(values):
                split = [line_keys(v["text"]) for v in values]
                dropped = []
                for (_, keys), v in zip(split, values):
                    own = set(map(_joined, v["low"] or (), v["high"] or ()))
                    dropped.append({k for k in set(keys) if digest(k) in own} if own else own)
                return _rewritten(split, dropped)

            return run

        marked = add_columns(told, packed, _fields(names), task)
        return marked.select(*[c for c in docs.columns if c not in names], *names)


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _fields(names: tuple[str, str, str]) -> list[tuple[str, str]]:
    return list(zip(names, ("bigint", "bigint", "string")))


def _joined(low: int, high: int) -> bytes:
    return low.to_bytes(8, "little", signed=True) + high.to_bytes(8, "little", signed=True)


def _tester(filters: dict[int, CuckooFilter], shards: int, exceptions: set[bytes]) -> Callable[[set[bytes]], set[bytes]]:
    """The members among some keys; the empty key is none."""

    def member(keys: set[bytes]) -> set[bytes]:
        distinct = [k for k in keys if k]
        if not distinct:
            return set()
        digests = [digest(k) for k in distinct]
        low, high = _halves(digests)
        shard = low % shards
        hit = np.zeros(len(distinct), bool)
        for s in np.unique(shard).tolist():
            if s in filters:
                at = np.flatnonzero(shard == s)
                hit[at] = filters[s].contains(low[at], high[at])
        return {distinct[i] for i in np.flatnonzero(hit).tolist() if digests[i] not in exceptions}

    return member


def _rewritten(split: list, dropped: Iterable[set[bytes]]) -> tuple[list, list, list]:
    """Lines, dropped lines and kept text of each text, given the keys it loses."""
    counts, gone, kept = [], [], []
    for (lines, keys), own in zip(split, dropped):
        left = [line for line, key in zip(lines, keys) if key not in own]
        counts.append(len(lines))
        gone.append(len(lines) - len(left))
        kept.append("\n".join(left))
    return counts, gone, kept


_FILTERS = "shard int, data binary, crowded boolean"


def _filter_row(shard: int, own: CuckooFilter) -> pa.Table:
    return pa.table([pa.array([shard], pa.int32()), pa.array([own.to_bytes()], pa.binary()), pa.array([own.crowded])], names=["shard", "data", "crowded"])


def _built(members: pa.Table) -> pa.Table:
    """The filter of one shard's members; doubled until all are in their buckets."""
    low, high = members.column("low").to_numpy(), members.column("high").to_numpy()
    size = len(low)
    while True:
        own = CuckooFilter(size)
        own.insert(low, high)
        if not own.crowded or size > 64 * len(low):
            return _filter_row(members.column("shard")[0].as_py(), own)
        size *= 2


def _updated(old: pa.Table, moves: pa.Table) -> pa.Table:
    shard = (old if old.num_rows else moves).column("shard")[0].as_py()
    enters = moves.column("enters").to_numpy(zero_copy_only=False).astype(bool)
    low, high = moves.column("low").to_numpy(), moves.column("high").to_numpy()
    own = CuckooFilter.from_bytes(old.column("data")[0].as_py()) if old.num_rows else CuckooFilter(int(enters.sum()))
    own.delete(low[~enters], high[~enters])
    own.insert(low[enters], high[enters])
    return _filter_row(shard, own)


_ASKED = "own binary, shard int, low bigint, high bigint"


def _passing(filters: pa.Table, asked: pa.Table) -> pa.Table:
    """Rows whose key passes their shard's filter."""
    asked = asked.select(["own", "shard", "low", "high"])
    if not filters.num_rows or not asked.num_rows:
        return asked.slice(0, 0)
    own = CuckooFilter.from_bytes(filters.column("data")[0].as_py())
    return asked.filter(pa.array(own.contains(asked.column("low").to_numpy(), asked.column("high").to_numpy())))


def _asked(shards: int):
    """Distinct keys of each text, the empty one left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = digest(b"")
        for batch in batches:
            seen: set[bytes] = set()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name in seen:
                    continue
                seen.add(name)
                own = list({digest(k) for k in line_keys(text)[1]} - {empty})
                low, high = _halves(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(repeat(name, len(own))), pa.binary()), pa.array((low % shards).astype(np.int32)), pa.array(low), pa.array(high)],
                    names=["own", "shard", "low", "high"],
                )

    return run


def count_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(low, high, n): the documents that hold each key; every row is a document of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            low, high = _halves([digest(k) for k in held])
            counts = pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), counts], names=["low", "high", "n"])

        for batch in batches:
            for one in batch.column(0).to_pylist():
                held.update(set(line_keys(one)[1]))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(text).mapInArrow(run, "low bigint, high bigint, n bigint")
    return parts.groupBy("low", "high").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD) -> LineIndex:
    """An index of these documents; an empty table gives an index without members."""
    return _indexed(count_lines(docs, text), threshold)


def _indexed(counted: DataFrame, threshold: int) -> LineIndex:
    counted = stage(counted, "line-counts")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    counts = counted.select(F.pmod("low", F.lit(shards)).cast("int").alias("shard"), "low", "high", "n")
    members = counts.where(F.col("n") >= threshold)
    filters = stage(members.groupBy("shard").applyInArrow(_built, _FILTERS), "line-filters")
    index = LineIndex(counts, filters, members.select("shard", "low", "high").limit(0), shards, threshold)
    return replace(index, exceptions=_exceptions(index))


def _exceptions(index: LineIndex) -> DataFrame:
    """Keys of the exact table below the threshold that their filter takes for members."""
    below = index.counts.where(F.col("n") < index.threshold).select("shard", "low", "high")
    spark: SparkSession = below.sparkSession
    schema = "shard int, low bigint, high bigint"
    if index.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0] <= FILTER_BYTES:
        filters = {r["shard"]: bytes(r["data"]) for r in index.filters.select("shard", "data").collect()}
        shared = spark.sparkContext.broadcast(filters)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {s: CuckooFilter.from_bytes(d) for s, d in shared.value.items()}
            for batch in batches:
                shard, low, high = (c.to_numpy() for c in batch.columns)
                hit = np.zeros(len(shard), bool)
                for s in np.unique(shard).tolist():
                    if s in own:
                        at = np.flatnonzero(shard == s)
                        hit[at] = own[s].contains(low[at], high[at])
                yield batch.filter(pa.array(hit))

        found = below.mapInArrow(run, schema)
    else:
        named = below.withColumn("own", F.lit(None).cast("binary"))
        found = index.filters.select("shard", "data").groupBy("shard").cogroup(named.select("own", "shard", "low", "high").groupBy("shard")).applyInArrow(
            _passing, _ASKED
        ).drop("own")
    return stage(found, "line-exceptions")


def oracle_sql(threshold: int = THRESHOLD) -> str:
    """The digests of the registered query in DuckDB."""
    return f"""WITH cut AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) AS s) AS t),
common AS (SELECT key FROM cut WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {threshold})
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM cut LEFT JOIN common ON cut.key = common.key GROUP BY doc_id"""
