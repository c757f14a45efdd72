"""Personal data by weak supervision.

Four base kinds have fixed rules and always stay. Every base match and every
token with a digit is also a candidate on which three labelers vote: a regex labeler on its shape, a
gazetteer labeler on cue words before it, a context labeler on the characters around it.
Expectation-maximisation over the counts of all vote patterns estimates the
labelers' reliabilities, and its posteriors train a logistic span classifier on
the candidate's features; tokens that it accepts become spans of kind ``secret``.

Votes and features of a candidate are packed into 14 bits, so the counts over all candidates have at most 16,384 rows, whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that announce a credential or an address.
GAZETTEER = (
    "account", "api", "apikey", "auth", "bearer", "call", "card", "contact", "credential", "iban", "key", "login",
    "mail", "passphrase", "passwd", "password", "phone", "pin", "pwd", "secret", "ssn", "tel", "token",
)
#: Characters before a candidate in which a cue word counts.
CUE_REACH = 32
#: Shortest token with a digit that becomes a candidate.
SHORTEST = 8
ROUNDS = 50
#: Weight of the belief that a labeler errs less than it hits, as a share of all candidates.
BELIEF_SHARE = 0.05
ABSTAIN, NO, YES = 0, 1, 2

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does: within a run the rest is the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_TOKEN_REST = re.compile(r"[A-Za-z0-9_-]*")
_CUE = re.compile(r"\b(?:" + "|".join(GAZETTEER) + r")\b", re.IGNORECASE)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start and then kind; leftmost matches that fail are dropped."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end(), 0))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def tokens_with_digits(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximal tokens of letters, digits, _ and - that hold a digit, clear of base spans."""
    found, last, b = [], 0, 0
    reach = 0  # end of the base spans that begin before the token
    for m in _DIGITS.finditer(text):
        start = m.start()
        if start < last:
            continue
        while start > last and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        last = _TOKEN_REST.match(text, m.end()).end()
        while b < len(base) and base[b][0] < last:
            reach = max(reach, base[b][1])
            b += 1
        if last - start >= SHORTEST and start >= reach:
            found.append((start, last))
    return found


def feature(text: str, start: int, end: int, kind: int) -> int:
    """Votes and features of a candidate in 14 bits."""
    token = text[start:end]
    upper = any("A" <= c <= "Z" for c in token)
    lower = any("a" <= c <= "z" for c in token)
    hexa = _HEX.fullmatch(token) is not None
    if kind < 4:
        shape = YES
    elif len(token) >= 14 and (upper or lower) and (hexa or not (upper and lower) or len(token) >= 20):
        shape = YES
    else:
        shape = ABSTAIN if len(token) >= 12 and (upper or lower) else NO
    before = text[max(0, start - CUE_REACH) : start]
    cue = YES if _CUE.search(before) else ABSTAIN
    near = before.rstrip()[-1:] if before.rstrip()[-1:] in "\"'=:" and before.rstrip() else ""
    if near:
        around = YES
    elif before[-1:].isalnum() or text[end : end + 1].isalnum():
        around = NO
    else:
        around = ABSTAIN
    length = (len(token) >= 12) + (len(token) >= 18) + (len(token) >= 30)
    return kind | shape << 3 | cue << 5 | around << 7 | length << 9 | upper << 11 | lower << 12 | hexa << 13


def _votes(features: np.ndarray) -> np.ndarray:
    return np.stack([features >> 3 & 3, features >> 5 & 3, features >> 7 & 3], axis=1)


def reliabilities(features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: (labeler x class x vote probabilities, posterior of each row, share of positives among tokens).

    Base spans meet an exact rule, so they anchor the positive class.
    """
    votes, weight = _votes(features), counts.astype(float)
    anchored = (features & 7) < 4
    # Start from the reading of a vote that its name has; the two classes are named by it.
    posterior = np.clip(0.5 + 0.25 * ((votes == YES).sum(1) - (votes == NO).sum(1)), 0.05, 0.95)
    posterior[anchored] = 1.0
    table, share = np.full((3, 2, 3), 1 / 3), 0.5
    # Columns: abstain, no, yes. Labelers are believed to do better than chance.
    belief = np.array([[0.4, 0.5, 0.1], [0.4, 0.1, 0.5]])
    for _ in range(ROUNDS):
        mass = np.stack([(1 - posterior) * weight, posterior * weight])
        doubt = 1 + BELIEF_SHARE * weight[~anchored].sum()
        share = float((mass[1, ~anchored].sum() + doubt) / (weight[~anchored].sum() + 2 * doubt))
        for j in range(3):
            seen = np.stack([mass[:, votes[:, j] == v].sum(1) for v in range(3)], axis=1)
            seen = seen + belief * max(1.0, BELIEF_SHARE * weight.sum())
            table[j] = seen / seen.sum(axis=1, keepdims=True)
        odds = np.log(share / (1 - share)) + sum(
            np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]) for j in range(3)
        )
        posterior = np.where(anchored, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return table, posterior, share


def _design(features: np.ndarray) -> np.ndarray:
    f = features
    columns = [np.ones(len(f))]
    columns += [(f & 7) == k for k in range(len(KINDS))]
    columns += [votes == v for votes in _votes(f).T for v in (NO, YES)]
    columns += [(f >> 9 & 3) == v for v in range(1, 4)]
    columns += [f >> b & 1 for b in (11, 12, 13)]
    return np.stack(columns, axis=1).astype(float)


def train(features: np.ndarray, counts: np.ndarray) -> frozenset[int]:
    """Features that the final classifier accepts; it is trained on EM's posteriors, weighted by counts."""
    if not len(features):
        return frozenset()
    _, posterior, _ = reliabilities(features, counts)
    x, w = _design(features), counts / counts.sum()
    theta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - posterior)) + 1e-4 * theta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(theta))
        theta -= np.linalg.solve(hess, grad)
    every = np.arange(1 << 14)
    return frozenset(every[_design(every) @ theta > 0].tolist())


def candidate_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(feature, n) over the candidates of all texts; at most 16,384 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                base = base_spans(t)
                for s, e, k in base:
                    counts[feature(t, s, e, k)] += 1
                for s, e in tokens_with_digits(t, base):
                    counts[feature(t, s, e, 4)] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["feature", "n"])

    parts = docs.select(text).mapInArrow(run, "feature bigint, n bigint")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> frozenset[int]:
    """The span classifier, from the votes on all candidates of all texts."""
    rows = sorted(candidate_counts(docs, text).collect())
    return train(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64))


def spans(text: str, accepted: frozenset[int]) -> tuple[list, list]:
    """(base spans, all spans) of a text, each by start and then kind."""
    base = base_spans(text)
    more = [(s, e, 4) for s, e in tokens_with_digits(text, base) if feature(text, s, e, 4) in accepted]
    return base, sorted(base + more, key=lambda s: (s[0], s[2])) if more else base


def _named(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


def add_spans(docs: DataFrame, text: str = "text", accepted: frozenset[int] | None = None) -> DataFrame:
    """Append n_email, n_ip, n_card, n_phone, base_sha256, spans and n_secret to every row.

    Null and empty texts hold nothing; repeated rows repeat; an empty table stays empty.
    """
    accepted = fit(docs, text) if accepted is None else accepted

    def task():
        def run(texts):
            out = []
            for t in texts:
                base, found = spans(t or "", accepted)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(_named(base).encode()).hexdigest()
                out.append((*(kinds.count(k) for k in range(4)), digest, _named(found), len(found) - len(base)))
            return zip(*out) if out else [[]] * 7

        return run

    fields = [(f"n_{k}", "bigint") for k in KINDS[:4]] + [("base_sha256", "string"), ("spans", "string"), ("n_secret", "bigint")]
    return add_columns(docs, text, fields, task)


def redact_text(text: str, found: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for s, e, k in found:
        if s >= last:
            out.append(text[last:s])
            out.append(f"[{KINDS[k].upper()}]")
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text: str = "text", accepted: frozenset[int] | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in their texts; null texts stay null."""
    accepted = fit(docs, text) if accepted is None else accepted

    def task():
        return lambda texts: [[t if not t else redact_text(t, spans(t, accepted)[1]) for t in texts]]

    return add_columns(docs, text, [(text, "string")], task).select(*docs.columns)
