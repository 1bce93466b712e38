"""Order MinHash fingerprints: sketches of texts that follow edit distance.

For each of M hash functions the L least occurrence-numbered k-mers of a text are selected, put back
into text order and hashed together. Two texts agree in a part only if they select the same k-mers in
the same order, so moving passages lowers the likeness, which plain MinHash would not see.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.jobs import prepare
from tagweave.llm.words import constants, mix
from tagweave.scale import staged

K, L, M = 8, 2, 64
#: k-mers looked at in one go, so that memory does not grow with the text.
COLUMNS = 1 << 12
_U = np.uint64
_FACTORS = constants(K + 1, 3)
_MULTIPLY = (constants(M, 7) >> _U(32) | _U(1)).astype(np.uint32)[:, None]
_ORDER = constants(L, 13)


def kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-mer, and of every k-mer with its occurrence number; a short text is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    if not len(codes):
        return codes, codes
    k = min(K, len(codes))
    total = np.full(len(codes) - k + 1, np.array([k], _U) * _FACTORS[K])
    for j in range(k):
        total += codes[j : len(codes) - k + 1 + j] * _FACTORS[j]
    plain = mix(total)
    ordered = np.sort(plain)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return plain, plain
    numbered = plain.copy()
    twice = np.unique(twice)
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, plain), len(twice) - 1)] == plain)
    order = at[np.argsort(plain[at], kind="stable")]
    values = plain[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    numbered[order] = mix(values + (np.arange(len(values)) - first).astype(_U) * _FACTORS[K])
    # the first occurrence keeps the plain hash
    numbered[order[new]] = values[new]
    return plain, numbered


def _least(numbered: np.ndarray) -> np.ndarray:
    """Positions of the L least values under each hash function: (M, L), fewer if the text is short.

    The functions are products of the upper 32 bits, which are mixed well, with odd numbers.
    """
    n, want = len(numbered), min(L, len(numbered))
    short = (numbered >> _U(32)).astype(np.uint32)
    expect = 12
    while True:
        limit = np.uint32(expect * (1 << 32) // n) if n > expect else None
        rows, cols, values = [], [], []
        for start in range(0, n, COLUMNS):
            v = short[start : start + COLUMNS][None, :] * _MULTIPLY
            r, c = np.divmod(np.flatnonzero(v < limit), v.shape[1]) if limit is not None else (
                np.repeat(np.arange(M), v.shape[1]), np.tile(np.arange(v.shape[1]), M))
            rows.append(r)
            cols.append(c + start)
            values.append(v[r, c])
        if len(rows) > 1:
            row, col, value = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
            order = np.argsort(row, kind="stable")
            row, col, value = row[order], col[order], value[order]
        else:
            row, col, value = rows[0], cols[0], values[0]
        counts = np.bincount(row, minlength=M)
        if counts.min() >= want:
            break
        expect *= 4
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((M, want), np.int64)
    used = np.zeros(len(value), bool)
    top = np.uint32((1 << 32) - 1)
    for j in range(want):
        left = np.where(used, top, value)
        least = np.minimum.reduceat(left, starts)
        hit = np.flatnonzero((left == np.repeat(least, counts)) & ~used)
        _, firsts = np.unique(row[hit], return_index=True)
        out[:, j] = col[hit[firsts]]
        used[hit[firsts]] = True
    return out


def fingerprint(text: str) -> np.ndarray:
    """M parts of 16 bits; none for an empty text."""
    plain, numbered = kmers(text)
    if not len(plain):
        return np.zeros(0, np.uint16)
    at = np.sort(_least(numbered), axis=1)
    total = (plain[at] * _ORDER[: at.shape[1]]).sum(axis=1, dtype=_U)
    return (mix(total) & _U(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal parts; 1 for two empty texts, 0 for an empty and another one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def _hex(parts: np.ndarray) -> str:
    return parts.astype(">u2").tobytes().hex()


def _row(doc_id, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    other = mine if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, _hex(mine), _hex(other), likeness(mine, other), likeness(mine, theirs))


RESULT = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
    "near_edited DOUBLE, near_next DOUBLE"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_EDGE = [pa.int64(), pa.string(), pa.string()]


def _batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Finished rows, and edge rows (partition, first text, last text; the last one's id as doc_id)."""
    full = [r + (None, None, None) for r in rows] + [(e[0],) + (None,) * 6 + e[1:] for e in edges]
    columns = list(zip(*full)) if full else [()] * 10
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES + _EDGE)], [*_NAMES, "part", "head", "tail"]
    )


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the next of its partition; the partition's first and last text are handed on."""
    last, head = None, None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = fingerprint(text)
            if last is None:
                head = text
            else:
                rows.append(_row(*last, text, own))
            last = (doc_id, text, own)
        yield _batch(rows, [])
    if last is not None:
        yield _batch([], [(last[0], TaskContext.get().partitionId(), head, last[1])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _row(doc_id, text, fingerprint(text), following, fingerprint(following))
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns))
        ]
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text, of its edited text, and their likeness to it and to the next.

    The next document is the next by (doc_id, text), null ids first; after the last comes the first,
    and a single document is its own next. A null text is empty: fingerprint '', like only to other
    empty texts. Rows that repeat are documents of their own; other columns are ignored. Texts are
    dealt once by id range; only the first and last text of each range meet their neighbours later.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    done = staged(rows.mapInArrow(_along, RESULT + ", part BIGINT, head STRING, tail STRING"), "fingerprints")
    # One row for each range: as many as there are partitions, whatever the table's size.
    edges = done.where("part IS NOT NULL").select("doc_id", "part", "head", "tail")
    order = Window.orderBy("part")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("head").over(order), F.first("head").over(around))
    ends = edges.select("doc_id", "tail", following.alias("following")).mapInArrow(_ends, RESULT)
    return done.where("part IS NULL").select(*_NAMES).union(ends)
