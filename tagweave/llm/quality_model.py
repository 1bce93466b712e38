"""Quality classifier on supervised subword embeddings.

Words, word pairs and byte n-grams are hashed to rows of an embedding table (a word followed by itself
has one row, whatever the word); a document is the average of its rows, a softmax over it gives the class. Table and output weights are learned by stochastic gradient
descent on a bounded sample of labelled documents. Averaging and the output are linear, so scoring
needs only one number per table row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.jobs import prepare
from tagweave.llm.words import IS_SPACE, constants, mix, text_bytes, slices, word_slices

#: Documents learned from at most: those with the least hash of their id.
SAMPLE_ROWS = 4000
WORD_ROWS, PAIR_ROWS, GRAM_ROWS = 1 << 14, 1 << 14, 1 << 15
ROWS = WORD_ROWS + PAIR_ROWS + GRAM_ROWS
GRAMS = (2, 3, 4)
DIM, EPOCHS, RATE, SEED = 16, 6, 1.0, 17
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
_U = np.uint64
_PAIR = constants(1, 47)[0]


def _gram_rows(data: np.ndarray, n: int) -> np.ndarray:
    """Table row of the n-gram that begins at each byte, white space of any kind being alike."""
    codes = np.where(IS_SPACE[data], 32, data)
    factors = constants(8, 5)
    table = constants(256, 41)[codes]
    total = table[: len(data) - n + 1] * factors[0]
    for j in range(1, n):
        total = total + table[j : len(data) - n + 1 + j] * factors[j]
    return (mix(total + _U(n)) % _U(GRAM_ROWS)).astype(np.int64) + WORD_ROWS + PAIR_ROWS


def _pair_rows(words: np.ndarray) -> np.ndarray:
    """Table row of each word with the next; the first of these rows is for a word with itself."""
    pairs = mix(words[:-1] + words[1:] * _PAIR) % _U(PAIR_ROWS - 1) + _U(1)
    return np.where(words[:-1] == words[1:], 0, pairs.astype(np.int64)) + WORD_ROWS


def feature_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, table rows, bounds by document) of each slice: words, pairs, n-grams."""
    raw, at = text_bytes(column)
    words = word_slices(column)
    for (first, last), w in zip(slices(at), words):
        data = raw[at[first] : at[last]]
        ends = at[first : last + 1] - at[first]
        yield first, (w.hashes % _U(WORD_ROWS)).astype(np.int64), w.bounds
        if len(w.hashes) > 1:
            inside = np.ones(len(w.hashes) - 1, bool)
            cut = w.bounds[1:-1] - 1
            inside[cut[(cut >= 0) & (cut < len(inside))]] = False
            starts = np.flatnonzero(inside)
            yield first, _pair_rows(w.hashes)[starts], np.searchsorted(starts, w.bounds)
        for n in GRAMS:
            if len(data) < n:
                continue
            rows = _gram_rows(data, n)
            # n-grams that reach into the next document do not count
            inside = np.ones(len(rows), bool)
            for j in range(1, n):
                cut = ends[1:-1] - j
                inside[cut[(cut >= 0) & (cut < len(rows))]] = False
            starts = np.flatnonzero(inside)
            yield first, rows[starts], np.searchsorted(starts, ends)


def _sums(column: pa.Array, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the features' values, and their number, for each document."""
    total, count = np.zeros(len(column)), np.zeros(len(column))
    for first, rows, bounds in feature_rows(column):
        ends = np.concatenate([[0.0], np.cumsum(value[rows], dtype=np.float64)])
        k = len(bounds) - 1
        total[first : first + k] += ends[bounds[1:]] - ends[bounds[:-1]]
        count[first : first + k] += np.diff(bounds)
    return total, count


def sparse_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct table rows of each document and their share of its features."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for first, rows, bounds in feature_rows(column):
        for i in range(len(bounds) - 1):
            parts[first + i].append(rows[bounds[i] : bounds[i + 1]])
    out = []
    for p in parts:
        rows, counts = np.unique(np.concatenate(p) if p else np.zeros(0, np.int64), return_counts=True)
        out.append((rows.astype(np.int64), counts / max(1, counts.sum())))
    return out


def train(
    examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = SEED
) -> tuple[np.ndarray, float]:
    """Value of each table row and the bias: their mean over a document is the logit of label 1."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    done, total = 0, max(1, EPOCHS * len(examples))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rows, share = examples[i]
            rate = RATE * (1 - done / total)
            done += 1
            hidden = share.astype(np.float32) @ table[rows] if len(rows) else np.zeros(DIM, np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            # fastText moves every feature by the whole step, not by its share
            table[rows] -= rate * np.outer(np.minimum(1.0, share * len(rows)), back).astype(np.float32)
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample_rows`` labelled documents that are not held out, whole texts.

    The features of the sample, not its texts, come to the driver. A document with several labels
    counts by the lowest, and one that comes in several rows by the text with the least hash. Without labelled rows every score is 0.5.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("mark"))
    marks = marks.withColumn("_order", F.md5(F.col("_id").cast("string")))
    sample = F.broadcast(marks.orderBy("_order", "_id").limit(sample_rows))
    rows = docs.join(sample, docs["doc_id"] == sample["_id"]).select("_order", "_id", "mark", "text")
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_nr", first).where("_nr = 1").drop("_nr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sparse_features(batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array([r.astype(np.uint16).tobytes() for r, _ in found], pa.binary()),
                 pa.array([s.astype(np.float32).tobytes() for _, s in found], pa.binary())],
                ["_order", "_id", "mark", "rows", "shares"],
            )

    schema = "_order STRING, _id BIGINT, mark INT, rows BINARY, shares BINARY"
    found = rows.mapInArrow(run, schema).toLocalIterator()
    read = sorted(found, key=lambda r: (r["_order"], r["_id"], bytes(r["rows"]), bytes(r["shares"])))
    examples = [
        (np.frombuffer(r["rows"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float32))
        for r in read
    ]
    return train(examples, [r["mark"] for r in read])


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only the text is scored. Null and empty texts get the score of the bias; other columns are
    ignored, rows that repeat are scored alike.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = model.value
        for batch in batches:
            total, count = _sums(batch.column(1), value)
            logit = np.clip(total / np.maximum(count, 1) + bias, -50, 50)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"]
            )

    rows = docs.mapInArrow(run, "doc_id BIGINT, score DOUBLE")
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
