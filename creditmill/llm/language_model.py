"""Documents scored by the cross-entropy difference of two n-gram models.

The target model counts the words of documents labelled good, the background model those of all
counted documents. Both share one vocabulary, one set of bigrams and the same smoothing, so that a
difference of losses per token comes from the counts alone. All words and bigrams of all texts count.

Words and bigrams are 64-bit codes. Documents lie in blocks, runs of rows of one task, in a table bucketed by block. A block
sends its distinct codes with its own counts, dealt to parts by ranges of the code; a part adds the counts of all blocks
and sends the totals back to every block that sent the code, in the order of its codes and without them; the block finds its codes
again and scores its documents. A code is sent once per block, packed with others of its block and part,
so a frequent word weighs as much as any other. Texts are not shuffled. The driver receives totals only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.llm.common import broadcast_if_small, prepare, stage
from creditmill.session import delete_folder, scratch_path

#: Weight of the back-off distribution in words (Dirichlet smoothing).
BACK_OFF = 50.0
#: Characters of a block of documents that is counted and scored together; one longer text is a block.
BLOCK_CHARS = 12_000_000
#: Characters of all texts per part of the codes.
PART_CHARS = 12_000_000
#: Word hashes that a task keeps; the table is then begun anew.
HASHES = 500_000
#: Bytes of an id in a broadcast of ids.
ID_BYTES = 64
START = 0
HASH_SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The block of totals over all codes of a part.
_TOTALS = -1
_SENT = "kind int, part bigint, block bigint, n int, codes binary, counts binary"
_BACK = "kind int, part bigint, block bigint, n int, counts binary"
#: Kinds of codes and how many counts each has.
_WORDS, _PAIRS = 0, 1
_COUNTS = (4, 2)


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Hashes(dict):
    """Spark's xxhash64 of words, kept for words seen."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), HASH_SEED)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value

    def of(self, text: str | None) -> np.ndarray:
        found = words(text)
        if len(self) > HASHES:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _before(ids: np.ndarray) -> np.ndarray:
    """The word before each word; the first follows the start mark."""
    before = np.empty_like(ids)
    before[:1] = START
    before[1:] = ids[:-1]
    return before


def pair_codes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.view(np.uint64) * _MIX) ^ v.view(np.uint64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Sorted distinct codes: the first in eight bytes, then gaps of six bytes if all fit, else of eight."""
    gaps = np.diff(codes)
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    if gaps.max(initial=0) < 1 << 48:
        raw = raw[:, :6]
    return codes[:1].astype("<u8").tobytes() + raw.tobytes()


def unpack_codes(data: bytes, n: int) -> np.ndarray:
    width = 6 if n > 1 and len(data) == 8 + 6 * (n - 1) else 8
    raw = np.zeros((n, 8), np.uint8)
    raw[:1] = np.frombuffer(data, np.uint8, 8)
    raw[1:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(n - 1, width)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """(kinds, n) counts, each row in the narrowest type that holds it and led by that type's width."""
    rows = []
    for row in counts:
        kind = np.min_scalar_type(int(row.max(initial=0)))
        rows.append(bytes([kind.itemsize]) + row.astype(kind.newbyteorder("<")).tobytes())
    return b"".join(rows)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    rows, at = [], 0
    while at < len(data):
        width = data[at]
        rows.append(np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64))
        at += 1 + width * n
    return np.array(rows).reshape(len(rows), n)


_ARROW = {"kind": pa.int32(), "part": pa.int64(), "block": pa.int64(), "n": pa.int32(), "codes": pa.binary(), "counts": pa.binary()}


def _packed(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, _ARROW[n]) for n, c in zip(names, columns)], names=names)


def _in_blocks(docs: DataFrame, text: str, block: str) -> DataFrame:
    """``docs`` with the block of each row: consecutive rows up to BLOCK_CHARS characters."""
    schema = T.StructType([*docs.schema, T.StructField(block, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            made = []
            for length in pc.utf8_length(batch.column(batch.schema.get_field_index(text))).to_pylist():
                if size and size + (length or 0) > BLOCK_CHARS:
                    now, size = now + 1, 0
                size += length or 0
                made.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, block])

    return docs.mapInArrow(run, schema)


class Entries:
    """Distinct words and bigrams of the texts of a block, sorted, and where each token's are."""

    def __init__(self, texts: list[str | None]):
        hashes = Hashes()
        own = [hashes.of(t) for t in texts]
        del hashes
        self.lengths = [len(t) for t in own]
        words_ = np.concatenate([*own, np.zeros(1, np.int64)]).view(np.uint64)  # START last
        before = np.concatenate([*map(_before, own), np.zeros(0, np.int64)])
        self.words, at = np.unique(words_, return_inverse=True)
        self.word, start = at[:-1], at[-1]
        self.head = np.empty_like(self.word)
        self.head[1:] = self.word[:-1]
        firsts = np.cumsum([0, *self.lengths])[:-1][np.array(self.lengths, np.int64) > 0]
        self.head[firsts] = start
        self.pairs, self.pair = np.unique(pair_codes(before, words_[:-1].view(np.int64)), return_inverse=True)

    def counted(self, roles: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes, counts) of words and of bigrams: in all and in target documents, for words also as the word before another.

        Role 0 is a document that only asks, 1 one that counts and 2 one that counts for the target too.
        """
        role = np.repeat(np.array(roles, np.int64), self.lengths)

        def counts(places, size: int) -> np.ndarray:
            return np.array([np.bincount(p[role >= least], minlength=size) for p in places for least in (1, 2)])

        return [
            (self.words, counts((self.word, self.head), len(self.words))),
            (self.pairs, counts((self.pair,), len(self.pairs))),
        ]


def _sent(rows: DataFrame, block: str, text: str, role: str, parts: int, returns: bool) -> DataFrame:
    """Packed codes and counts of every block; ``returns`` says whether totals go back to it."""
    bounds = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)

    def run(table: pa.Table) -> pa.Table:
        now = table.column(block)[0].as_py() if returns else _TOTALS
        out = []
        for kind, (codes, counts) in enumerate(Entries(table.column(text).to_pylist()).counted(table.column(role).to_pylist())):
            # Sorted codes fall into parts in order.
            cuts = [0, *np.searchsorted(codes, bounds).tolist(), len(codes)]
            for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    out.append((kind, part, now, hi - lo, pack_codes(codes[lo:hi]), pack_counts(counts[:, lo:hi])))
        return _packed(out, ["kind", "part", "block", "n", "codes", "counts"])

    return rows.select(block, text, role).groupBy(block).applyInArrow(run, _SENT)


def _totals(table: pa.Table) -> pa.Table:
    """Counts of a part added up by code and sent back; one row more has the part's sums and its number of counted codes."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    blocks, sizes = table.column("block").to_pylist(), table.column("n").to_pylist()
    codes = [unpack_codes(c, n) for c, n in zip(table.column("codes").to_pylist(), sizes)]
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    del codes
    sums = np.zeros((_COUNTS[kind], len(distinct)), np.int64)
    lo = 0
    for n, data in zip(sizes, table.column("counts").to_pylist()):
        sums[:, at[lo : lo + n]] += unpack_counts(data, n)  # codes of a block are distinct
        lo += n
    out, lo = [], 0
    for block, n in zip(blocks, sizes):
        if block != _TOTALS:
            out.append((kind, part, block, n, pack_counts(sums[:, at[lo : lo + n]])))
        lo += n
    whole = np.append(sums.sum(axis=1), (sums[0] > 0).sum()).reshape(-1, 1)
    out.append((kind, part, _TOTALS, 1, pack_counts(whole)))
    return _packed(out, ["kind", "part", "block", "n", "counts"])


class BlockModel:
    """Both models over the words and bigrams of one block."""

    def __init__(self, entries: Entries, told: pa.Table, totals: tuple[int, int], vocabulary: int):
        self.entries, self.totals, self.vocabulary = entries, totals, vocabulary
        rows = sorted(zip(*(told.column(c).to_pylist() for c in ("kind", "part", "n", "counts"))))
        none = [np.zeros((_COUNTS[kind], 0), np.int64) for kind in (_WORDS, _PAIRS)]
        self.words, self.pairs = (
            np.concatenate([none[kind], *(unpack_counts(c, n) for k, _, n, c in rows if k == kind)], axis=1) for kind in (_WORDS, _PAIRS)
        )

    def losses(self) -> tuple[list, list]:
        """Mean negative log probability of every text under the target and the background model; None without words."""
        own, made = self.entries, []
        ends = np.cumsum(own.lengths)
        for k in (1, 0):
            # Add-one smoothing over the vocabulary and one unknown word.
            single = (self.words[k, own.word] + 1.0) / (self.totals[k] + self.vocabulary + 1)
            logs = np.log((self.pairs[k, own.pair] + BACK_OFF * single) / (self.words[2 + k, own.head] + BACK_OFF))
            made.append([-float(logs[end - n : end].mean()) if n else None for end, n in zip(ends.tolist(), own.lengths)])
        return made[0], made[1]


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _with_role(docs: DataFrame, target: DataFrame, doc_id: str, role: str) -> DataFrame:
    """2 for documents whose id is a target's, else 1; a null id is none."""
    name = _unused("__id", docs.columns)
    ids = target.select(F.col(doc_id).alias(name)).where(F.col(name).isNotNull()).distinct().withColumn(role, F.lit(2))
    met = docs.join(broadcast_if_small(ids, ID_BYTES), docs[doc_id] == ids[name], "left").drop(name)
    return met.withColumn(role, F.coalesce(role, F.lit(1)))


def _bucketed(rows: DataFrame, block: str, count: int) -> tuple[str, str]:
    """Name and folder of a table bucketed by block. A block lies in one task, so this shuffles nothing and writes a file per block."""
    name, path = f"lm_{uuid.uuid4().hex}", scratch_path(rows.sparkSession, "lm-blocks")
    rows.write.bucketBy(count, block).option("path", path).option("compression", "zstd").saveAsTable(name)
    return name, path


def add_scores(
    docs: DataFrame, target: DataFrame, counted: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True
) -> DataFrame:
    """Append n_tokens, target_loss, background_loss and difference (target less background, per token).

    ``target`` has the ids of the target documents. The models count the documents of ``counted``, or without it those of ``docs``
    themselves, each scored document included. A low difference is closer to the target. Null and empty texts have no tokens and null
    losses; repeated rows repeat and count each; without target documents the target model is uniform; an empty table
    stays empty; columns of ``docs`` with one of the four names are replaced. The result is written once, without its
    texts unless ``keep_text``, and all other scratch is deleted.
    """
    spark = prepare(docs.sparkSession)
    fields = [("n_tokens", "bigint"), ("target_loss", "double"), ("background_loss", "double"), ("difference", "double")]
    names = [name for name, _ in fields]
    given = [c for c in docs.columns if c not in names]
    kept = [c for c in given if keep_text or c != text]
    role = _unused("__role", docs.columns)
    block = _unused("__block", [*docs.columns, role])
    made: list[tuple[str, str]] = []
    try:
        marked = _with_role(docs.select(*given), target, doc_id, role) if counted is None else docs.select(*given).withColumn(role, F.lit(0))
        frames = [(_in_blocks(marked, text, block), block, role)]
        if counted is not None:
            frames.append((_in_blocks(_with_role(counted.select(doc_id, text), target, doc_id, "__role"), text, "__block"), "__block", "__role"))
        chars = sum(f.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0] for f in (docs, counted) if f is not None)
        parts = max(1, -(-chars // PART_CHARS))
        buckets = max(spark.sparkContext.defaultParallelism, -(-chars // BLOCK_CHARS))
        sent = None
        for frame, place, flag in frames:
            made.append(_bucketed(frame, place, buckets))
            own = _sent(spark.table(made[-1][0]), place, text, flag, parts, sent is None)
            sent = own if sent is None else sent.unionByName(own)
        rows = spark.table(made[0][0])
        path = scratch_path(spark, "lm-totals")
        made.append(("", path))
        sent.groupBy("kind", "part").applyInArrow(_totals, _BACK).write.option("compression", "zstd").parquet(path)
        back = spark.read.schema(_BACK).parquet(path)
        whole = np.zeros(5, np.int64)
        for r in back.where((F.col("block") == _TOTALS) & (F.col("kind") == _WORDS)).select("counts").toLocalIterator():
            whole += unpack_counts(bytes(r["counts"]), 1).ravel()
        totals, vocabulary = (int(whole[0]), int(whole[1])), int(whole[4])

        def score(own: pa.Table, told: pa.Table) -> pa.Table:
            entries = Entries(own.column(text).to_pylist())
            a, b = BlockModel(entries, told, totals, vocabulary).losses()
            difference = [None if x is None else x - y for x, y in zip(a, b)]
            numbers = [pa.array(entries.lengths, pa.int64()), *(pa.array(c, pa.float64()) for c in (a, b, difference))]
            return pa.table([*(own.column(c) for c in kept), *numbers], names=kept + names)

        schema = T.StructType([*rows.select(*kept).schema, *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in fields))])
        scored = rows.groupBy(block).cogroup(back.where(F.col("block") != _TOTALS).groupBy("block")).applyInArrow(score, schema)
        return stage(scored, "lm-scores")
    finally:
        for name, path in made:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_folder(spark, path)
