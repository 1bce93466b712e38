"""Personal data in texts: exact patterns, and a skip-chain random field for what they miss.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Other tokens that might
be mentions of the same things are suspects: numbers of seven digits and more, words with an at sign,
and the names of addresses already found. All of them are variables of a random field with the labels
other, email, ip, card and phone: neighbours in the text are linked as a chain, and tokens of equal or
similar value, however far apart, are linked through a shared node of that value (skip links), so a
value that comes a thousand times needs a thousand links. Loopy message passing makes labels agree
within each document. Label frequencies by token shape and along the chain are counted over the whole
corpus, with the patterns as teacher. Without a similar pattern match a suspect keeps the label other.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.jobs import prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Strength of a skip link, of one to a similar but shorter value, and rounds of message passing.
SAME, SIMILAR, ROUNDS = 8.0, 7.0, 6
#: Prior weight of the label other in the counts of a shape, and the most that the counts weigh: the
#: patterns are a teacher that never calls a suspect personal data.
PRIOR = 20.0
#: Digits that a shorter number must share with the end of a longer one; characters of a name.
TAIL_DIGITS, NAME_CHARS = 7, 5

# The base patterns. A match starts where its run of characters starts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_AT_WORD = re.compile(r"(?<![^\s<>(),;:\"])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++")
_NAME = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++(?!@)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Token:
    start: int
    end: int
    label: int  # of the pattern that matched, 0 for a suspect
    shape: str
    values: list[str] = field(default_factory=list)


def _shape(kind: str, s: str, matched: bool) -> str:
    n = len(_digits(s))
    marks = "".join(c for c in "+@().- " if c in s)
    return f"{kind}:{'valid' if matched else 'loose'}:{min(n, 20)}:{marks}"


def tokens(text: str, base: list[tuple[str, int, int]]) -> list[Token]:
    """Pattern matches and suspects in text order, with the values that link them."""
    out, taken, names = [], [], set()
    for kind, s, e in base:
        word = text[s:e]
        t = Token(s, e, LABELS.index(kind), _shape(kind, word, True))
        if kind == "email":
            t.values = ["@" + word.lower()]
            name = word.split("@")[0].lower()
            if len(name) >= NAME_CHARS and not name.isalpha():
                names.add(name)
                t.values.append("@name " + name)
        else:
            digits = _digits(word) if kind != "ip" else word
            t.values = [digits, "end " + digits[-TAIL_DIGITS:]] if kind != "ip" else [digits]
        out.append(t)
        taken.append((s, e))
    starts, ends = [], []
    for s, e in sorted(taken):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)
        return not i or ends[i - 1] <= s

    for m in _NUMBER.finditer(text):
        digits = _digits(m[0])
        if len(digits) >= TAIL_DIGITS and free(*m.span()):
            t = Token(*m.span(), 0, _shape("number", m[0], False), [digits, "end " + digits[-TAIL_DIGITS:]])
            out.append(t)
    if "@" in text:
        for m in _AT_WORD.finditer(text):
            if free(*m.span()):
                name = m[0].split("@")[0].lower()
                out.append(Token(*m.span(), 0, _shape("at", m[0], False), ["@" + m[0].lower(), "@name " + name]))
    if names:
        for m in _NAME.finditer(text):
            if m[0].lower() in names and free(*m.span()):
                out.append(Token(*m.span(), 0, _shape("name", m[0], False), ["@name " + m[0].lower()]))
    out.sort(key=lambda t: (t.start, t.end, t.label))
    return out


@dataclass
class Potentials:
    """Log potentials: of labels by shape, and of neighbouring labels."""

    shapes: dict[str, np.ndarray]
    chain: np.ndarray

    def unary(self, t: Token) -> np.ndarray:
        if t.label:
            out = np.full(len(LABELS), -30.0)
            out[t.label] = 0.0
            return out
        return self.shapes.get(t.shape, _DEFAULT)


def _log_share(counts: np.ndarray) -> np.ndarray:
    counts = counts * min(1.0, PRIOR / max(1.0, counts.sum()))
    prior = np.full(len(LABELS), 0.25)
    prior[0] = PRIOR
    return np.log((counts + prior) / (counts + prior).sum())


_DEFAULT = _log_share(np.zeros(len(LABELS)))


def posterior(found: list[Token], potentials: Potentials) -> np.ndarray:
    """Label probabilities of each token after some rounds of sum-product messages."""
    n, k = len(found), len(LABELS)
    unary = np.array([potentials.unary(t) for t in found])
    index: dict[str, int] = {}
    pairs = [(i, index.setdefault(v, len(index)), SAME if j == 0 else SIMILAR)
             for i, t in enumerate(found) for j, v in enumerate(t.values)]
    tok = np.array([p[0] for p in pairs], np.int64)
    val = np.array([p[1] for p in pairs], np.int64)
    strength = np.array([p[2] for p in pairs])
    up, down = np.zeros((len(pairs), k)), np.zeros((len(pairs), k))
    left, right = np.zeros((n, k)), np.zeros((n, k))  # messages from the left and the right neighbour

    def norm(m: np.ndarray) -> np.ndarray:
        return m - np.logaddexp.reduce(m, axis=-1, keepdims=True)

    def agree(m: np.ndarray) -> np.ndarray:
        """Through a link that rewards equal labels by its strength."""
        total = np.logaddexp.reduce(m, axis=1, keepdims=True)
        return norm(np.logaddexp(total, m + np.log(np.expm1(strength))[:, None]))

    belief = unary
    for _ in range(ROUNDS):
        skip = np.zeros((n, k))
        np.add.at(skip, tok, down)
        belief = unary + skip + left + right
        up = agree(norm(belief[tok] - down))
        at_value = np.zeros((len(index), k))
        np.add.at(at_value, val, up)
        down = agree(norm(at_value[val] - up))
        if n > 1:
            forth, back = belief - right, belief - left
            left = left.copy()
            right = right.copy()
            left[1:] = norm(np.logaddexp.reduce(forth[:-1, :, None] + potentials.chain[None], axis=1))
            right[:-1] = norm(np.logaddexp.reduce(back[1:, None, :] + potentials.chain[None], axis=2))
    skip = np.zeros((n, k))
    np.add.at(skip, tok, down)
    return np.exp(norm(unary + skip + left + right))


def all_spans(text: str, potentials: Potentials) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind, then start."""
    base = base_spans(text)
    if not base:
        return base, base  # nothing that a suspect could resemble
    found = tokens(text, base)
    if all(t.label for t in found):
        return base, base
    p = posterior(found, potentials)
    added, end = [], 0
    for t, share in zip(found, p):
        label = int(share.argmax())
        if not t.label and label and share[label] > 0.5 and t.start >= end:
            added.append((LABELS[label], t.start, t.end))
            end = t.end
    spans = sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, spans


def learn(docs: DataFrame) -> Potentials:
    """Count labels by shape and along the chain over all texts of ``docs`` (column text).

    Shapes are few: kind, up to 20 digits and a set of seven marks. Only their counts leave the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens(text, base_spans(text)) if text else []
                counts.update(("shape", t.shape, t.label) for t in found)
                counts.update(("chain", str(a.label), b.label) for a, b in zip(found, found[1:]))
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["what", "key", "label", "n"],
        )

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "what STRING, key STRING, label INT, n BIGINT")
    shapes: dict[str, np.ndarray] = {}
    chain = np.ones((len(LABELS), len(LABELS)))
    for r in rows.groupBy("what", "key", "label").agg(F.sum("n").alias("n")).collect():
        if r["what"] == "chain":
            chain[int(r["key"]), r["label"]] += r["n"]
        else:
            shapes.setdefault(r["key"], np.zeros(len(LABELS)))[r["label"]] += r["n"]
    # How much more often than by chance labels follow each other, damped: neighbours only hint.
    total = chain.sum()
    ratio = np.log(chain * total / (chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True)))
    return Potentials({k: _log_share(v) for k, v in shapes.items()}, np.clip(0.25 * ratio, -0.5, 0.5))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, pattern matches by kind, their digest, and all spans of every whole text.

    Spans are code points, end exclusive. A null text is empty; other columns are ignored; rows that
    repeat are searched alike. Matches of different kinds may overlap; added spans overlap none.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", shared.value) for t in batch.column(1).to_pylist()]
            kinds = [Counter(k for k, _, _ in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[k] for c in kinds], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                 pa.array([_joined(s) for _, s in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} BIGINT" for k in KINDS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id BIGINT, {counts}, base_sha256 STRING, spans STRING")


def redacted_text(text: str | None, potentials: Potentials) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in sorted(all_spans(text, potentials)[1], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame, text: str = "text") -> Column:
    """Column expression: the text with every span replaced by its kind; null stays null."""
    shared = spark.sparkContext.broadcast(learn(docs.select(F.col(text).alias("text"))))

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: redacted_text(t, shared.value), na_action="ignore")

    return run(F.col(text))
