"""Groups of near copies by MinHash: minima of universal hash functions, bands, signatures, star components.

A document's set is its distinct word shingles. Documents with equal sets are one class. Each of MINIMA
universal functions (a * x + b modulo 2^64) gives the least hash of a set; two sets agree in a minimum
with the probability of their Jaccard similarity. Minima are cut into BANDS bands of BAND; classes that
agree in a whole band meet in its bucket. At the least similarity of 0.8 a pair misses all buckets with a
probability below 1e-6, at 0.85 below 1e-9. Where few documents meet, nothing more is done: most classes
are alone in all their buckets.

Members of a bucket are not paired. They are linked through pivots (see ``linking``), first by their
signatures, 16 bits of each minimum: a pair whose agreeing minima lie seven standard deviations below the
threshold is left out, and so is one whose sets, counted in buckets, cannot share enough; all others are
compared by their full sets, and only that makes a link. Components come from alternating large-star and
small-star steps.

Odd rows: null texts and texts without words have an empty set and stay alone; with fewer words than a
shingle has, the whole sequence is one shingle. Repeated rows are copies. Null ids take part; a group of
null ids only has a null component, and all its rows count as kept in ``near_groups``. Rows with one id
and different texts are linked by their texts only. Any BIGINT is an id. Extra columns are ignored by
``near_groups`` and kept by ``deduplicated``. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import linking
from tagweave.llm.jobs import prepare
from tagweave.llm.words import constants, mix
from tagweave.scale import STAGED, staged, sweep, unstaged

BANDS, BAND = 36, 5
MINIMA = BANDS * BAND
_U = np.uint64
#: Odd factors and summands of the universal functions.
FACTORS, SUMMANDS = constants(MINIMA, 101), constants(MINIMA, 202)
PROFILE = "doc_id BIGINT, h1 BIGINT, h2 BIGINT, n BIGINT, k1 BIGINT, k2 BIGINT, mark BINARY, bands ARRAY<BIGINT>"


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least hash of each function (rows) over each set (columns); sets follow each other and none is empty."""
    out = np.empty((MINIMA, len(starts)), _U)
    for i in range(MINIMA):
        np.minimum.reduceat(flat * FACTORS[i] + SUMMANDS[i], starts, out=out[i])
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band (rows) of each set (columns), different from band to band."""
    out = []
    for band in range(BANDS):
        total = np.full(least.shape[1], _U(band + 1))
        for row in least[band * BAND : (band + 1) * BAND]:
            total = mix(total * _U(0x9E3779B97F4A7C15) + row)
        out.append(total.view(np.int64))
    return np.stack(out)


def least_agreement(num: int, den: int) -> int:
    """Agreeing minima that a pair at the threshold has but for seven standard deviations."""
    p = num / den
    return max(0, math.floor(MINIMA * p - 7 * math.sqrt(MINIMA * p * (1 - p))))


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in linking.set_slices(batch.column(1), n):
                rows = last - first
                sizes = np.array([len(s) for s in sets], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate(sets)
                k1, k2 = linking.set_keys(flat, bounds)
                some = np.flatnonzero(sizes)
                marks: list[bytes | None] = [None] * rows
                bands = np.zeros((0, 0), np.int64)
                if len(some):
                    least = minima(flat, bounds[:-1][some])
                    bands = band_keys(least).T
                    low = np.ascontiguousarray(least.T.astype(np.uint16))
                    for i, row in zip(some, low):
                        marks[i] = row.tobytes()
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
                named = [batch.column(i).slice(first, rows) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*named, pa.array(sizes), pa.array(k1), pa.array(k2), pa.array(marks, pa.binary()), listed],
                    ["doc_id", "h1", "h2", "n", "k1", "k2", "mark", "bands"],
                )

    return run


def signature_likeness(num: int, den: int) -> linking.Likeness:
    """Share of agreeing minima of sets of fitting sizes; then bucket counts must allow the similarity, too."""
    enough, counted = least_agreement(num, den), linking.sketch_likeness(num, den)

    def likeness(n: int, mark: np.ndarray, ns: np.ndarray, marks: np.ndarray) -> np.ndarray:
        out = np.full(len(ns), -1.0)
        fits = np.flatnonzero(num * np.maximum(ns, n) <= den * np.minimum(ns, n))
        own = mark[: 2 * MINIMA].view(np.uint16)
        for part in np.array_split(fits, 1 + len(fits) // 1024):
            theirs = np.ascontiguousarray(marks[part, : 2 * MINIMA]).view(np.uint16)
            agree = np.count_nonzero(theirs == own, axis=1)
            part, agree = part[agree >= enough], agree[agree >= enough]
            can = counted(n, mark[2 * MINIMA :], ns[part], marks[part, 2 * MINIMA :]) >= 0
            out[part[can]] = agree[can] / MINIMA
        return out

    return likeness


def grouped(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, h1, h2 (which name the text), n_shingles, grp and component_id of every row.

    grp numbers the group, also where no row of it has an id; without shingles it is null.
    """
    spark, before = prepare(docs.sparkSession), list(STAGED)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.select("doc_id", "text", *linking.text_hashes(F.col("text")))
    profile = staged(hashed.mapInArrow(_profile(n), PROFILE), "profile")
    rows = staged(profile.select("doc_id", "h1", "h2", "n", "k1", "k2"), "rows")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("n").alias("n"), F.min("doc_id").alias("head"))
    classes = staged(classes, "classes")
    node = linking.numbering(classes)
    classes = classes.withColumn("node", node)

    keyed = profile.where("n > 0").select(node.alias("node"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = staged(shared.select("key"), "shared-keys")
    hits = staged(keyed.join(linking.small(shared), "key", "left_semi").distinct(), "hits")
    nodes = staged(hits.select("node").distinct(), "hit-nodes")
    signed = profile.where("n > 0").select(node.alias("node"), "mark").join(linking.small(nodes), "node", "left_semi")
    signed = signed.groupBy("node").agg(F.first("mark").alias("signature"))
    heads = staged(classes.select("k1", "k2", "head", "node").join(linking.small(nodes), "node", "left_semi"), "heads")
    sets = linking.whole_sets(docs, heads, n)
    mark = F.concat("signature", "mark").alias("mark")
    bodies = staged(sets.join(signed, "node").select("node", "n", mark, "shingles"), "bodies")
    unstaged(profile, shared, sets)
    links = linking.connect(hits, bodies, signature_likeness(num, den), num, den)
    roots = staged(linking.stars(links), "roots")
    least = classes.join(roots, "node").groupBy("root").agg(F.min("head").alias("least"))
    named = classes.join(roots, "node", "left").join(staged(least, "least-ids"), "root", "left")
    named = staged(
        named.select("k1", "k2", F.coalesce("root", "node").alias("grp"),
                     F.when(F.col("root").isNull(), F.col("head")).otherwise(F.col("least")).alias("component_id")),
        "named",
    )
    sweep(spark, before, rows, named)
    known = rows.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select(
        "doc_id", "h1", "h2", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("grp")).alias("grp"), component.alias("component_id"),
    )


def near_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the group's least id) and kept, whether that is the row's own."""
    rows = grouped(docs, n, num, den).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, one of each group of near copies."""
    return linking.one_of_each(docs, grouped(docs, n, num, den))
