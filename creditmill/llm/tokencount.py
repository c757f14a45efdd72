"""Exact unigram token counts without token lists.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic
programming carries the best score and its piece count to every position. Ties
are settled as the tokenizer does: of equal paths into a position the one whose last piece
begins first stays; a character without a piece of its own costs ten more than the
worst piece and falls back to its bytes.
"""

from __future__ import annotations

import math
from copy import copy
from functools import lru_cache

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from creditmill.llm.common import add_columns

VOCABULARY = "piece_bpe_32k.model"
#: What an unknown character costs below the lowest score of the vocabulary.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words that a worker remembers; a full table is emptied. Results do not depend on it.
CACHE = 500_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a public vocabulary file with log probabilities by Zipf's law of their ranks.

    The file holds pieces in order of their merges and no probabilities; nothing is trained here.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    total = math.log(sum(1 / (i + 1) for i in range(model.get_piece_size())))
    return [(model.id_to_piece(i), -math.log(i + 1) - total) for i in range(model.get_piece_size())]


class Counter:
    """Counts of the pieces of whole texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word with its leading space mark."""
        n = len(word)
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at, single = 0, False  # matches come by their end, the longest first

        def close(end: int) -> None:
            """Settle a position once its matches are in: the lone character is tried last."""
            value = best[end - 1] + self.unknown
            if best[end] == -math.inf or value > best[end]:
                best[end] = value
                count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))

        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while at < end - 1:
                at += 1
                if not single:
                    close(at)
                single = False
            value = best[end - size] + score
            if best[end] == -math.inf or value > best[end]:
                best[end], count[end] = value, count[end - size] + 1
            single = single or size == 1
        while at < n:
            at += 1
            if not single:
                close(at)
            single = False
        return count[n], best[n]

    def counts(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """(pieces, score) of whole texts; null and empty texts have none."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = []
        for text in texts:
            marked = (text or "").replace(SPACE, " ")
            if marked:
                parts = marked.split(" ")
                split.append(parts[1:] if not parts[0] else parts)
            else:
                split.append([])
        unknown: set[str] = set()
        for parts in split:
            unknown.update(parts)
        unknown.difference_update(self.known)
        for part in unknown:
            self.known[part] = self.word(SPACE + part)
        out = []
        for parts in split:
            found = list(map(self.known.__getitem__, parts))
            out.append((sum(c for c, _ in found), math.fsum(s for _, s in found)))
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(unigram_vocabulary(path))


def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The counter of a public vocabulary's name or of a file's path; remembered words end with the caller's counter."""
    own = copy(_counter(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)))
    own.known = {}
    return own


def add_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Append n_tokens and log_prob of whole texts.

    Null and empty texts count 0 with log_prob 0; repeated rows repeat; an empty
    table stays empty; columns with the two names are replaced.
    """

    def task():
        own = counter(vocabulary)

        def run(texts):
            return zip(*own.counts(texts)) if texts else ([], [])

        return run

    return add_columns(docs, text, [("n_tokens", "bigint"), ("log_prob", "double")], task)
