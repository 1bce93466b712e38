"""Resampling of a corpus towards a target: hashed n-gram importance weights and a seeded Gumbel top-k draw.

Word runs are made by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode``. An n-gram is a pair of an (n-1)-gram's number and the dictionary index shifted by
n-1; only distinct pairs are hashed, going on from the shorter run's CRC. Buckets are looked up by take
and the gains are summed by segments. A batch is a few megabytes or one text, whatever the corpus.

The corpus's and the target's bucket counts are summed in every task before they are shuffled; the
driver sees one number a bucket. Ranks need no single task either: scores are whole numbers in a range
that grows with the logarithm of the corpus, so their counts fit one small window, and rows are ranked
inside their score.

Odd rows: null and empty texts have no features, weight 0 and stay undrawn below ``least_words``. A null
id is scored as an empty one and comes last among equal scores; rows alike in id and score are ranked
one after another in any order. Extra columns are ignored by ``ranked`` and kept by ``resampled``. An
empty target or corpus counts nothing in any bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tagweave.llm.jobs import prepare, unused
from tagweave.scale import staged

BUCKETS = 10_000
#: What separates words: all of ASCII but digits and letters, which are lower case by then.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Each word's row and dictionary index, in text order, and the dictionary."""
    if texts.null_count:
        texts = texts.fill_null("")
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.large_string())), BETWEEN_WORDS)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    return rows.filter(real).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), words


def feature_buckets(texts: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``grams`` words, ordered by length, then row; words of each row."""
    rows, index, words = word_runs(texts)
    n_words = np.bincount(rows, minlength=len(texts))
    crc = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words))
    at, code = rows, index
    out_rows, out_buckets = [at], [crc[code] % buckets]
    for k in range(1, grams):
        inside = at[:-1] == rows[k:] if len(at) > 1 else np.zeros(0, bool)
        pair = (code[:-1] * len(words) + index[k:])[inside] if len(inside) else np.zeros(0, np.int64)
        distinct, number = np.unique(pair, return_inverse=True)
        left, right = np.divmod(distinct, max(len(words), 1))
        crc = np.fromiter(
            (zlib.crc32(b" " + words[w], int(crc[p])) for p, w in zip(left.tolist(), right.tolist())),
            np.int64, len(distinct),
        )
        # Runs keep the place of their first word, so that the next word is found by the same shift.
        code = np.full(max(len(code) - 1, 0), -1, np.int64)
        code[inside] = number
        at = np.where(inside, at[:-1], -1) if len(inside) else at[:0]
        out_rows.append(at[inside])
        out_buckets.append(crc[number] % buckets)
    return np.concatenate(out_rows), np.concatenate(out_buckets), n_words


def bucket_counts(docs: DataFrame, grams: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(feature_buckets(batch.column(0), grams, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "seen"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    seen = texts.mapInArrow(count, "bucket BIGINT, seen BIGINT").groupBy("bucket").agg(F.sum("seen").alias("seen"))
    out = np.zeros(buckets, np.int64)
    for r in seen.collect():  # at most one row a bucket
        out[r["bucket"]] = r["seen"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of a bucket's share in the target over that in the corpus."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def weighted(docs: DataFrame, gains: np.ndarray, grams: int, names: list[str]) -> DataFrame:
    """``docs`` with three more BIGINT columns: words, features, floored mean of the features' gains."""
    at = docs.columns.index("text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, buckets, n_words = feature_buckets(batch.column(at), grams, len(gains))
            order = np.argsort(rows, kind="stable") if grams > 1 else slice(None)
            ends = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
            sums = np.concatenate([[0], np.cumsum(gains[buckets[order]])])
            n = np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            more = [pa.array(x.astype(np.int64)) for x in (n_words, n, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = docs.schema
    for name in names:
        schema = StructType([*schema, StructField(name, LongType())])
    return docs.mapInArrow(weigh, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that the id and the seed fix."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def _scored(
    docs: DataFrame, target: DataFrame, grams: int, buckets: int, seed: int, names: list[str]
) -> DataFrame:
    gains = bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    words, features, weight, score, _ = names
    rows = weighted(docs.withColumn("text", F.col("text").cast("string")), gains, grams, [words, features, weight])
    return rows.withColumn(score, F.col(weight) + noise(F.col("doc_id"), seed))


def _drawn(rows: DataFrame, score: str, eligible: Column, percent: int, part: str, rank: str) -> DataFrame:
    """``rows`` with the rank of those drawn; ``part`` is a column that cuts them into pieces of bounded size."""
    names = unused([*rows.columns, rank], "_times", "_above", "_first", "_piece", "_nth", "_before")
    times, above, first, piece, nth, before = names
    fit = rows.where(eligible)
    alike = staged(fit.groupBy(score, "doc_id").agg(F.count(F.lit(1)).alias(times)), "alike")
    n = alike.agg(F.coalesce(F.sum(times), F.lit(0)).alias("n")).first()["n"]
    limit = percent * n // 100
    down = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    levels = alike.groupBy(score).agg(F.sum(times).alias(piece))
    levels = levels.select(score, F.coalesce(F.sum(piece).over(down), F.lit(0)).alias(above)).where(F.col(above) < limit)
    inside = Window.partitionBy(score).orderBy(F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.join(levels, score).withColumn(first, F.col(above) + F.coalesce(F.sum(times).over(inside), F.lit(0)))
    placed = staged(placed.where(F.col(first) < limit).select(score, F.col("doc_id").alias(piece), first, times), "placed")
    same = (rows[score] == placed[score]) & rows["doc_id"].eqNullSafe(placed[piece]) & eligible
    once = placed.where(F.col(times) == 1)
    single = rows.join(once, same, "left").select(*[rows[c] for c in rows.columns], (F.col(first) + 1).alias(rank))
    again = placed.where(F.col(times) > 1)
    if again.isEmpty():
        return single
    # Rows alike in id and score: numbered piece by piece, so that a group of any size is split.
    copies = rows.join(again, same).select(*[rows[c] for c in rows.columns], first)
    keys = [score, "doc_id", part]
    sizes = copies.groupBy(*keys).agg(F.count(F.lit(1)).alias(times))
    earlier = Window.partitionBy(score, "doc_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(times).over(earlier), F.lit(0)))
    sizes = sizes.select(score, F.col("doc_id").alias(piece), part, before)
    numbered = copies.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    on = (numbered[score] == sizes[score]) & numbered["doc_id"].eqNullSafe(sizes[piece]) & (numbered[part] == sizes[part])
    place = F.col(first) + F.col(before) + F.col(nth)
    ranked = numbered.join(sizes, on).select(
        *[numbered[c] for c in rows.columns], F.when(place <= limit, place).alias(rank)
    )
    others = single.join(
        again.select(score, piece),
        (single[score] == again[score]) & single["doc_id"].eqNullSafe(again[piece]) & eligible, "left_anti",
    )
    return others.unionByName(ranked)


def _judged(docs: DataFrame, target: DataFrame, grams, buckets, seed, percent, least_words, name: str) -> tuple[DataFrame, list[str]]:
    prepare(docs.sparkSession)
    names = unused(docs.columns, "n_words", "n_features", "weight", "score", "rank")
    part = unused([*docs.columns, *names], "part")[0]
    rows = _scored(docs, target, grams, buckets, seed, names)
    if name == "narrow":
        rows = rows.drop("text")
    rows = staged(rows.withColumn(part, F.spark_partition_id()), "scored")
    drawn = _drawn(rows, names[3], F.col(names[0]) >= least_words, percent, part, names[4])
    return drawn.drop(part), names


def ranked(
    docs: DataFrame, target: DataFrame, grams: int = 1, percent: int = 10, buckets: int = BUCKETS,
    seed: int = 2024, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn documents have no rank."""
    rows, _ = _judged(docs.select("doc_id", "text"), target, grams, buckets, seed, percent, least_words, "narrow")
    return rows.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, grams: int = 1, percent: int = 10, buckets: int = BUCKETS,
    seed: int = 2024, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """The drawn rows of ``docs``, whole."""
    rows, names = _judged(docs, target, grams, buckets, seed, percent, least_words, "whole")
    return rows.where(F.col(names[4]).isNotNull()).select(*docs.columns)


def oracle(grams: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10) -> str:
    """Comparison SQL for ``ranked`` over documents and benchmark, runs of one word."""
    if grams != 1:
        raise ValueError("the comparison covers runs of one word")
    return rf"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
{CRC_SQL},
v AS (SELECT f, crc % {buckets} AS b FROM crcs),
n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM w JOIN v USING (f) GROUP BY b),
z AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {buckets})::DOUBLE / ((s + 1)::DOUBLE * (t_all + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM n, z),
d AS (SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM w JOIN v USING (f) JOIN g USING (b) WHERE side = 'd' GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)
"""


#: CRC-32 of the distinct strings f of a table w, as crcs(f, crc): byte by byte, eight shifts each.
CRC_SQL = r"""fs AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM w),
crcs AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2),
      lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, byte: list_reduce(list_concat([xor(c, byte)], range(8)),
      lambda e, k: xor(e >> 1, (e & 1) * 3988292384))), 4294967295) AS crc FROM fs)"""
