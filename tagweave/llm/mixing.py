"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects target / source size copies. The expected copies are summed up
along the source's documents, ordered by size; one offset per source is added, and a document is
emitted once for each integer its interval crosses. Neighbours in that order have like sizes, so the
words taken come near the target, and nobody gets more than the ratio, rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.jobs import prepare
from tagweave.scale import staged

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: A source table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """Target words of each source: (mix_key, mix_total) to the same with mix_target.

    Weights repeat along the sources by code point, the null source last. Shares stop at ``repeats``
    times the source; filling the sources in order of cap / weight gives the level for all others.
    """
    number = F.row_number().over(Window.orderBy("mix_key"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nr") - 1) % len(weights))
    rows = totals.withColumn("_nr", number).withColumn("_weight", weight)
    rows = rows.withColumn("_cap", F.col("mix_total").cast("double") * repeats)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_nr")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("mix_total").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / F.sum("_weight").over(after))
    rows = rows.withColumn("_at", F.row_number().over(order))
    free = F.col("_level") * F.col("_weight") <= F.col("_cap")
    first = F.min(F.when(free, F.struct("_at", "_level"))).over(everything)
    rows = rows.withColumn("_first", first)
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_weight"))
    return rows.select("mix_key", "mix_total", target.alias("mix_target"))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    repeats: int = MAX_REPEATS,
    seed: str = "mix",
    digits: int = 1,
) -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, mix_total, mix_target and mix_copies.

    Uses doc_id, source and text; other columns pass through (their names must not start with
    ``mix_``). A null text has no words and a null id sorts as empty text. Equal rows are separate
    documents. A source without words has target 0 and gives no copies. The order within a source is
    by size class (a fifth wide), then by hashes of the id and the text, so results depend on neither
    partitions nor run. Rows are numbered in groups by class and ``digits`` hex digits of the hash; the groups'
    sizes are summed afterwards, so no source is gathered in one task.
    """
    prepare(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({"mix_key": key, "mix_size": word_count(F.col("text").cast("string"))})

    totals = rows.groupBy("mix_key").agg(F.sum("mix_size").alias("mix_total"))
    targets = staged(source_targets(totals, weights, repeats), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = rows.join(targets, "mix_key", "left")

    group = ["mix_key", "mix_class", "mix_slice"]
    rows = rows.withColumns(
        {
            "mix_hash": hashed,
            "mix_text": F.xxhash64("text"),
            "mix_class": F.floor(F.log2(F.col("mix_size") + 1.0) * 4).cast("bigint"),
            "mix_slice": F.substring(hashed, 1, digits),
        }
    )
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("mix_n"))
    before = Window.partitionBy("mix_key").orderBy("mix_class", "mix_slice")
    offset = F.sum("mix_n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, F.coalesce(offset, F.lit(0)).alias("mix_before"))
    within = Window.partitionBy(*group).orderBy("mix_size", "mix_hash", "mix_text")
    ranked = rows.withColumn("mix_rank", F.row_number().over(within)).join(offsets, group)

    ratio = F.when(F.col("mix_total") > 0, F.col("mix_target") / F.col("mix_total")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("mix_key"))), 1, 8), 16, 10)
    start = start.cast("double") / F.lit(4294967296.0)
    position = (F.col("mix_before") + F.col("mix_rank")).cast("double")
    crossed = F.floor(position * ratio + start) - F.floor((position - 1.0) * ratio + start)
    copies = F.least(crossed, F.lit(repeats)).cast("bigint")
    return ranked.withColumn("mix_copies", copies).drop(
        "mix_key", "mix_hash", "mix_text", "mix_class", "mix_slice", "mix_rank", "mix_before"
    )


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    rows = mixed(docs, **options).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies")))
    return rows.withColumn("mix_copy", copies).select(*docs.columns)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    rows = mixed(docs.select("doc_id", "source", "text"), **options)
    return rows.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_total").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
t AS (SELECT k, sum(size)::BIGINT AS total FROM d GROUP BY k),
w AS (SELECT *, 3.0::DOUBLE * total AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
        row_number() OVER (ORDER BY k) AS nr FROM t),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nr) AS spot,
        ((SELECT sum(total) FROM t)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
f AS (SELECT min(spot) AS spot, min_by(level, spot) AS level FROM l WHERE level * weight <= cap),
s AS (SELECT l.k, l.total, CASE WHEN f.spot IS NULL OR l.spot < f.spot THEN cap ELSE f.level * weight END AS target
      FROM l, f),
g AS (SELECT *, floor(log2(size + 1.0::DOUBLE) * 4) AS class, substr(h, 1, 1) AS slice FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, slice, size, h)::DOUBLE AS pos FROM g),
c AS (SELECT r.*, s.total, s.target, CASE WHEN s.total > 0 THEN s.target / s.total ELSE 0.0 END AS ratio,
        ('0x' || substr(md5('mix' || r.k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM r JOIN s ON r.k = s.k)
SELECT doc_id, size, total AS source_size, target,
       (least(floor(pos * ratio + u) - floor((pos - 1.0) * ratio + u), 3)::BIGINT * size)::BIGINT AS taken
FROM c
"""
