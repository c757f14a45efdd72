"""Byte-level BPE with a segment tree over adjacent pair ranks.

The leaves of the tree are the pairs of a piece, each with its merge rank and
place; the root is the leftmost pair of the lowest rank. A merge changes three leaves and
their paths, so a piece of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from copy import copy
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from creditmill.llm.common import add_columns

VOCABULARY = "byte_bpe_50k.json"
#: Entries of each of a worker's two caches; a full cache is emptied. Results do not depend on it.
CACHE = 150_000
#: Leaves up to which pieces are merged in step with others; longer ones are merged alone.
LOCKSTEP = 64
_NONE = 1 << 62
_ABSENT = (1 << 20) - 1


# The letters and numbers that Unicode 16 added.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5FA),
)


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _splitter_for_unassigned():
    """The letters and numbers newer than Unicode 16, and a splitter that takes them as symbols.

    The regex module knows more recent characters than the tokenizer does,
    and Python's own character data may be older than either.
    """
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in UNICODE_16)]
    known = "".join(new) or "\0"
    letters, numbers = rf"[\p{{L}}--[{known}]]", rf"[\p{{N}}--[{known}]]"
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:(?!{letters}|{numbers})[^\\s])")
    pattern = pattern.replace(r"\p{L}+", letters + "+").replace(r"\p{N}+", numbers + "+")
    return frozenset(new), regex.compile(f"(?V1){pattern}")


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        characters = _byte_characters()
        self.byte_ids = [vocab[characters[b]] for b in range(256)]
        self.pairs = {(vocab[a] << 20) | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        back = {c: b for b, c in characters.items()}
        names = {i: t for t, i in {**vocab, **self.specials}.items()}
        self.token_bytes = [
            bytes(back[c] for c in names[i]) if i in names and all(c in back for c in names[i])
            else names.get(i, "").encode()
            for i in range(max(names) + 1)
        ]
        keys = np.array(list(self.pairs), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merged_ids = np.array(self.merged, np.int64)
        own = np.array(self.byte_ids, np.int64)
        self.byte_ranks = self._ranks(np.repeat(own, 256), np.tile(own, 256)).reshape(256, 256)
        self.splitter = regex.compile(public_tokenizers.PATTERN)
        self.odd, self.odd_splitter = _splitter_for_unassigned()
        self.special_splitter = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece of the pre-tokenizer."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        pairs, merged = self.pairs, self.merged
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        bits = size.bit_length()
        mask = (1 << bits) - 1
        tree = [_NONE] * (2 * size)
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            rank = pairs.get((left << 20) | right)
            if rank is not None:
                tree[size + i] = (rank << bits) | i
            left = right
        for at in range(size - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        while (best := tree[1]) != _NONE:
            i = best & mask
            gone = after[i]
            token = ids[i] = merged[best >> bits]
            ids[gone] = -1
            k = after[i] = after[gone]
            before[k] = i
            changes = [(gone, _NONE)] if gone < n - 1 else []
            if k < n:
                rank = pairs.get((token << 20) | ids[k])
                changes.append((i, _NONE if rank is None else (rank << bits) | i))
            else:
                changes.append((i, _NONE))
            p = before[i]
            if p >= 0:
                rank = pairs.get((ids[p] << 20) | token)
                changes.append((p, _NONE if rank is None else (rank << bits) | p))
            for leaf, value in changes:
                at = size + leaf
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    if other < value:
                        value = other
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [t for t in ids if t >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, as little-endian bytes; trees of one size are worked in step."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            n = len(piece)
            if n < 2 or n > LOCKSTEP + 1:
                out[at] = np.array(self.merge(piece), "<u4").tobytes()
            else:
                classes.setdefault(1 << (n - 2).bit_length() if n > 2 else 1, []).append(at)
        for size, members in classes.items():
            for lo in range(0, len(members), 8192):
                some = members[lo : lo + 8192]
                for at, found in zip(some, self._lockstep([pieces[m] for m in some], size)):
                    out[at] = found
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 20) | right
        at = np.searchsorted(self.pair_keys, wanted)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], -1)

    def _lockstep(self, pieces: list[bytes], size: int) -> list[bytes]:
        """One merge of every tree per round, until no root holds a pair."""
        count, width, none = len(pieces), size + 1, np.int64(_NONE)
        bits = size.bit_length()
        mask = (1 << bits) - 1
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        ids = np.full((count, width + 1), _ABSENT, np.int64)
        ids[:, :width] = np.where(np.arange(width) < lengths[:, None], np.array(self.byte_ids)[raw], _ABSENT)
        tree = np.full((count, 2 * size), none)
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        real = (ranks >= 0) & (np.arange(size) < lengths[:, None] - 1)
        tree[:, size:] = np.where(real, (ranks << bits) | np.arange(size), none)
        level = size >> 1
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level >>= 1
        after = np.tile(np.arange(1, width + 2), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        rows = np.arange(count)
        while True:
            best = tree[rows, 1]
            rows, best = rows[best != none], best[best != none]
            if not len(rows):
                break
            i, token = best & mask, self.merged_ids[best >> bits]
            gone = after[rows, i]
            k = after[rows, gone]
            ids[rows, i], ids[rows, gone] = token, -1
            after[rows, i], before[rows, k] = k, i
            p = before[rows, i]
            to_right = self._ranks(token, ids[rows, k])
            to_left = np.where(p >= 0, self._ranks(ids[rows, p], token), -1)
            inner = gone < size
            tree[rows[inner], size + gone[inner]] = none
            tree[rows, size + i] = np.where(to_right >= 0, (to_right << bits) | i, none)
            first = p >= 0
            tree[rows[first], size + p[first]] = np.where(to_left >= 0, (to_left << bits) | p, none)[first]
            at = (size + np.stack([np.minimum(gone, size - 1), i, np.maximum(p, 0)])) >> 1
            while at[0, 0]:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at >>= 1
        kept = (ids >= 0) & (ids != _ABSENT)
        flat = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii() and not self.odd.isdisjoint(text):
            return self.odd_splitter.findall(text)
        return self.splitter.findall(text)

    def fresh(self) -> Codec:
        """A codec over the same vocabulary with caches of its own."""
        other = copy(self)
        other.pieces, other.chunks = {}, {}
        return other

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.pieces))
        if new:
            self.pieces.update(zip(new, self.merge_many([p.encode("utf-8", "replace") for p in new])))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; special tokens in them keep their ids. None counts as empty.

        A single space between two other characters always begins a piece, so a
        text is cut there and its parts are looked up whole; a text with
        other runs of white space at a space is split as one.
        """
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        rows: list[list] = []  # per text: its plain parts and special ids in order
        for text in texts:
            text = text or ""
            if self.specials and any(s in text for s in self.specials):
                rows.append([self.specials.get(part, part) for part in self.special_splitter.split(text) if part])
            else:
                rows.append([text] if text else [])
        plain = [part for row in rows for part in row if isinstance(part, str)]
        cut = [part.split(" ") for part in plain]
        unknown: set[str] = set()
        for parts in cut:
            unknown.update(parts[1:])
        unknown.difference_update(self.chunks)
        unsafe = {c for c in unknown if not c or c[0].isspace() or c[-1].isspace()}
        split: dict[str, list[str]] = {c: self._pieces(" " + c) for c in unknown - unsafe}
        needed: set[str] = set()
        for pieces in split.values():
            needed.update(pieces)
        whole: list[list[str] | None] = []
        for part, parts in zip(plain, cut):
            odd = len(parts) > 1 and (not parts[0] or parts[0][-1].isspace() or not unsafe.isdisjoint(parts[1:]))
            pieces = self._pieces(part if odd else parts[0])
            whole.append(pieces if odd else None)
            needed.update(pieces)
            if not odd:
                parts[0] = pieces
        self._learn(needed)
        known = self.pieces
        for chunk, pieces in split.items():
            self.chunks[chunk] = b"".join([known[p] for p in pieces])
        done = []
        for pieces, parts in zip(whole, cut):
            if pieces is not None:
                done.append(b"".join([known[p] for p in pieces]))
            else:
                head = b"".join([known[p] for p in parts[0]])
                done.append(head + b"".join(map(self.chunks.__getitem__, parts[1:])))
        ready = iter(done)
        return [
            np.frombuffer(
                b"".join(next(ready) if isinstance(part, str) else part.to_bytes(4, "little") for part in row), "<u4"
            )
            for row in rows
        ]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(path: str) -> Codec:
    return Codec(path)


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of a public vocabulary's name or of a file's path.

    The vocabulary is read once per worker; the caches are new and end with the caller's codec.
    """
    return _codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)).fresh()


def encode_texts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Append ``token_ids`` array<int>, ``n_tokens`` bigint and ``round_trip`` boolean (the ids decode to the text).

    Null texts count as empty.
    """

    def task():
        own = codec(vocabulary)

        def run(texts):
            ids = [i.astype(np.int32) for i in own.encode_batch(texts)]
            return ids, [len(i) for i in ids], [own.decode(i) == (t or "") for i, t in zip(ids, texts)]

        return run

    return add_columns(docs, text, [("token_ids", "array<int>"), ("n_tokens", "bigint"), ("round_trip", "boolean")], task)


def decode_ids(docs: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Append ``decoded`` string; null ids count as empty."""

    def task():
        own = codec(vocabulary)
        return lambda lists: [[own.decode(i or []) for i in lists]]

    return add_columns(docs, ids, [("decoded", "string")], task)


def digests(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256 of a round trip of whole texts.

    Repeated rows repeat, an empty table stays empty; null and empty texts have no tokens.
    """

    def task():
        own = codec(vocabulary)

        def run(texts):
            out = []
            for ids in own.encode_batch(texts):
                decoded = own.decode(ids).encode("utf-8")
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            return zip(*out) if out else ([], [], [])

        return run

    return add_columns(docs, text, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], task)
