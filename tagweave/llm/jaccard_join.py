"""Groups of documents whose word n-gram sets are similar: a size-aware heavy-light set join.

Documents with equal sets form one class first; classes are joined by Jaccard similarity.

*Light* classes (few shingles) list every subset of the fixed sizes that a similar partner must
share. Two sets with a common subset of that size are similar without further checks, and all sets
of a subset's list that are similar to any other are similar to its smallest one, so a list gives a
star and never pairs. *Heavy* classes go to inverted lists of their least frequent shingles: similar
sets share at least one shingle of these prefixes, whatever the order as long as it is the same for
all. The boundary is the size with the lowest total cost, from the histogram of class sizes.

Prefixes are a quarter longer than needed to share one shingle, so similar sets share several; a class
with fewer shingles in lists of others cannot be similar to anything and is dropped before any pair
is looked at. The classes left are linked through pivots of their lists and compared by whole sets (see
``linking``); a pair is left out only if its sets, counted in 512 buckets, cannot share enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm import linking
from tagweave.llm.jobs import prepare
from tagweave.llm.words import mix
from tagweave.scale import STAGED, staged, sweep, unstaged

#: Frequent shingles ordered by their counts; the rest follows by hash, before them.
FREQUENT = 1 << 16
#: Largest set whose subsets may be listed.
LIGHT_LIMIT = 24
#: Rows that a shingle of a verified set is worth: it is read, shipped, sorted and counted.
CHECK_COST = 4
_U = np.uint64


def required(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes a and b with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def partner_sizes(a: int, num: int, den: int) -> range:
    return range(-(-num * a // den), den * a // num + 1)


def prefix_size(a: int, num: int, den: int) -> int:
    """So many first shingles of any fixed order that similar sets have one in common."""
    return a - -(-num * a // den) + 1


def more(a: int, num: int, den: int) -> int:
    """Shingles added to a prefix; similar sets then share one more than the smaller one's number."""
    return prefix_size(a, num, den) // 4


def needed(a: int, num: int, den: int) -> int:
    """Shared prefix shingles that a set of size a has if any other is similar."""
    return 1 + more(partner_sizes(a, num, den)[0], num, den)


def subset_sizes(a: int, light: int, num: int, den: int) -> list[int]:
    """Intersections that light partners of a set of size a must reach."""
    sizes = {required(a, b, num, den) for b in partner_sizes(a, num, den) if 0 < b <= light}
    return sorted(c for c in sizes if c <= a)


def boundary(counts: dict[int, int], num: int, den: int) -> int:
    """Largest light size: subsets listed by light sets against prefix rows and checks of heavy ones."""
    best, best_cost = 0, None
    for light in range(LIGHT_LIMIT + 1):
        cost = 0
        for size, n in counts.items():
            if size <= light:
                cost += n * sum(comb(size, c) for c in subset_sizes(size, light, num, den))
            if size >= -(-num * (light + 1) // den):
                cost += n * (prefix_size(size, num, den) + more(size, num, den) + CHECK_COST * size)
        if best_cost is None or cost < best_cost:
            best, best_cost = light, cost
    return best


PROFILE = "doc_id BIGINT, h1 BIGINT, h2 BIGINT, n BIGINT, k1 BIGINT, k2 BIGINT, token BIGINT, seen BIGINT"


def _profile(n: int):
    """A row for each document, then counts of the shingles that came often in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << 24, np.uint8)
        often: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for batch in batches:
            for first, last, sets in linking.set_slices(batch.column(1), n):
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                k1, k2 = linking.set_keys(flat, np.concatenate([[0], np.cumsum(sizes)]))
                named = [batch.column(i).slice(first, last - first) for i in (0, 2, 3)]
                yield _rows(named, sizes, k1, k2)
                u, c = np.unique(flat, return_counts=True)
                at = (u >> _U(40)).astype(np.int64)
                total = np.minimum(counters[at].astype(np.int64) + c, 255)
                counters[at] = total
                often.append(u[total >= 4])
                times.append(c[total >= 4])
                if len(often) > 64:
                    often, times = _summed(often, times)
        if often:
            often, times = _summed(often, times)
            k = len(often[0])
            nulls = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nulls] * 6 + [pa.array(often[0].view(np.int64)), pa.array(times[0])],
                ["doc_id", "h1", "h2", "n", "k1", "k2", "token", "seen"],
            )

    return run


def _summed(tokens: list[np.ndarray], times: list[np.ndarray]) -> tuple[list, list]:
    u, at = np.unique(np.concatenate(tokens), return_inverse=True)
    return [u], [np.bincount(at, np.concatenate(times), len(u)).astype(np.int64)]


def _rows(named: list[pa.Array], sizes: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    nulls = pa.nulls(len(sizes), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*named, pa.array(sizes), pa.array(k1), pa.array(k2), nulls, nulls],
        ["doc_id", "h1", "h2", "n", "k1", "k2", "token", "seen"],
    )


POSTINGS = (
    "doc_id BIGINT, n BIGINT, k1 BIGINT, k2 BIGINT, rare INT, prefix ARRAY<BIGINT>, "
    "subsets ARRAY<BIGINT>, shares ARRAY<INT>"
)


def _postings(n: int, num: int, den: int, light: int, frequent: np.ndarray, rank: np.ndarray):
    """Prefix shingles of each set, the ``rare`` ones not among the frequent first, and a light set's subsets."""
    listed = -(-num * (light + 1) // den)

    def prefix(s: np.ndarray, where: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
        if len(s) < listed:
            return s[:0], 0
        p = prefix_size(len(s), num, den) + more(len(s), num, den)
        rare = s[~hot]
        if len(rare) >= p:
            return rare[:p], p
        common = s[hot][np.argsort(rank[where[hot]], kind="stable")]
        return np.concatenate([rare, common[: p - len(rare)]]), len(rare)

    def subsets(s: np.ndarray) -> tuple[list[int], list[int]]:
        keys, shares = [], []
        for c in subset_sizes(len(s), light, num, den) if 0 < len(s) <= light else ():
            chosen = np.array(list(combinations(range(len(s)), c)), np.int64)
            keys += mix(mix(s)[chosen].sum(axis=1) + _U(c)).view(np.int64).tolist()
            shares += [c] * len(chosen)
        return keys, shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, sets in linking.set_slices(batch.column(1), n):
                sizes = np.array([len(s) for s in sets], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate(sets)
                k1, k2 = linking.set_keys(flat, bounds)
                if len(frequent):
                    where = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                    hot = frequent[where] == flat
                else:
                    where, hot = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
                pre, rares, sub, share = [], [], [], []
                for i, s in enumerate(sets):
                    at = slice(bounds[i], bounds[i + 1])
                    first_ones, rare = prefix(s, where[at], hot[at])
                    pre.append(first_ones)
                    rares.append(rare)
                    keys, sizes_shared = subsets(s)
                    sub.append(keys)
                    share.append(sizes_shared)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in pre])]).astype(np.int32)
                pre_list = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(pre).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(sizes), pa.array(k1), pa.array(k2),
                     pa.array(rares, pa.int32()), pre_list, pa.array(sub, pa.list_(pa.int64())),
                     pa.array(share, pa.list_(pa.int32()))],
                    ["doc_id", "n", "k1", "k2", "rare", "prefix", "subsets", "shares"],
                )

    return run


def near_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Connected groups of documents with Jaccard similarity of at least num / den.

    ``docs`` has doc_id and text; other columns are ignored. A document's set is its distinct
    shingles of ``n`` words, A-Z lower-cased; with fewer words the whole text is one shingle. Null and
    empty texts have no shingles and stay alone. Returns one row per input row: doc_id, n_shingles,
    component_id, the least doc_id of the group. Rows that repeat count as copies; rows with one id and
    different texts are linked by their texts only. Null ids take part; a group of null ids only has a
    null component. Any BIGINT is an id.
    """
    return grouped(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of ``near_groups`` with h1 and h2, which name the text, and grp, a number of the group.

    A group has a number also where none of its rows has an id; without shingles grp is null.
    """
    spark, before = prepare(docs.sparkSession), list(STAGED)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    hashed = docs.select("doc_id", "text", *linking.text_hashes(F.col("text")))
    profile = staged(hashed.mapInArrow(_profile(n), PROFILE), "profile")
    rows = profile.where("token IS NULL").select("doc_id", "h1", "h2", "n", "k1", "k2")
    top = (
        profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
        .where("seen >= 8").orderBy(F.desc("seen"), "token").limit(FREQUENT).collect()
    )
    frequent = np.array([r["token"] for r in top], np.int64).view(_U)
    by_hash = np.argsort(frequent)
    rank = (len(top) - np.arange(len(top)))[by_hash]  # the rarer first

    classes = staged(
        rows.where("n > 0").groupBy("k1", "k2").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id")),
        "classes",
    )
    node = linking.numbering(classes)
    classes = classes.withColumn("node", node)
    sizes = classes.groupBy(F.least("n", F.lit(2 * LIGHT_LIMIT)).alias("n")).count().collect()
    light = boundary({r["n"]: r["count"] for r in sizes}, num, den)

    heads = classes.select("k1", "k2", F.col("doc_id").alias("head"), "node")
    named_by = ["k1", "k2"]
    headed = rows.where("n > 0").join(heads, named_by)
    copies = staged(headed.where("NOT doc_id <=> head").select("doc_id", "k1", "k2"), "copies")
    # Rows of a class that have its head's id too, or none like it, are told apart by nothing.
    repeats = not headed.where("doc_id <=> head").groupBy("node").count().where("count > 1").isEmpty()
    listed = docs.mapInArrow(_postings(n, num, den, light, frequent[by_hash], rank), POSTINGS)
    listed = listed.where("size(prefix) > 0 OR size(subsets) > 0")
    keys = [listed["doc_id"].eqNullSafe(copies["doc_id"]), *(listed[k] == copies[k] for k in named_by)]
    listed = listed.join(linking.small(copies), keys, "left_anti")
    fields = ["n", "rare", "prefix", "subsets", "shares"]
    listed = listed.select(node.alias("node"), *fields)
    if repeats:
        listed = listed.groupBy("node").agg(*[F.first(c).alias(c) for c in fields])
    listed = staged(listed, "listed")

    links = _light_links(listed, num, den)
    meets = _meeting(listed, num, den)
    links = links.union(_heavy_links(docs, heads, meets, n, num, den))
    roots = staged(linking.stars(links), "roots")
    least = roots.join(heads, "node").groupBy("root").agg(F.min("head").alias("least"))
    roots = roots.join(staged(least, "least-ids"), "root")
    named = staged(
        classes.join(roots, "node", "left").select(
            "k1", "k2", F.coalesce("root", "node").alias("grp"), F.coalesce("least", "doc_id").alias("component_id")
        ),
        "named",
    )
    sweep(spark, before, profile, named)
    known = rows.join(named, named_by, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return known.select(
        "doc_id", "h1", "h2", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("grp")).alias("grp"), component.alias("component_id"),
    )


def _light_links(listed: DataFrame, num: int, den: int) -> DataFrame:
    """Each light class with the smallest class of each of its subsets, where the sizes allow it."""
    subsets = listed.select(
        "node", "n", F.explode(F.arrays_zip(F.col("subsets").alias("key"), F.col("shares").alias("c"))).alias("s")
    ).select("node", "n", F.col("s.key").alias("key"), F.col("s.c").alias("c"))
    subsets = staged(subsets, "subsets")
    least = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "node")).alias("least"))
    least = staged(least.select("key", "c", F.col("least.n").alias("m"), F.col("least.node").alias("b")), "least")
    fits = num * (F.col("n") + F.col("m")) <= (num + den) * F.col("c")
    return subsets.join(least, ["key", "c"]).where(fits & (F.col("node") != F.col("b"))).select(
        F.col("node").alias("a"), "b"
    )


def _repeated(lists: DataFrame) -> DataFrame:
    """Rows of the lists (token) of two sets or more, with their number df.

    Counts are summed within tasks first, and the rows of one long list meet its number in many tasks.
    """
    counts = staged(lists.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    out = staged(lists.join(linking.small(counts), "token"), "lists")
    unstaged(counts)
    return out


def _meeting(listed: DataFrame, num: int, den: int) -> DataFrame:
    """Inverted lists of the classes that may have similar ones, alike ones once: key, node, weight.

    Lists are split by size: size classes are as wide as similar sizes may differ, and a set is in its
    own list and the next larger one, so similar sets still meet. ``shingle`` is the list's shingle.
    The lists of frequent shingles, which one task could not hold, are not gathered for the first count.
    """
    lists = listed.select("node", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    df = F.count(F.lit(1)).over(Window.partitionBy("token"))
    rare = lists.where("at < rare").select("node", "n", "token").withColumn("df", df).where("df > 1").drop("df")
    width = math.log(den / num) * (1 + 1e-9)
    size_class = F.floor(F.log("n") / F.lit(width))
    lists = rare.union(lists.where("at >= rare").select("node", "n", "token"))
    lists = lists.select("node", "n", F.col("token").alias("shingle"), F.explode(F.array(size_class, size_class + 1)).alias("class"))
    lists = staged(lists.select("node", "n", "shingle", F.xxhash64("shingle", "class").alias("token")), "lists")
    smallest = F.expr(f"({num} * n + {den - 1}) DIV {den}")
    need = 1 + F.expr(f"(b - ({num} * b + {den - 1}) DIV {den} + 1) DIV 4")
    last, lists = lists, _repeated(lists)
    unstaged(last)
    # A class that meets others in fewer than ``need`` shingles is like none of them. Similar classes share
    # ``need`` at least, so each of the others may leave out half of that but one: the shingles of the
    # longest lists, which tie unlike families together. All of it goes over one layout by class.
    own = Window.partitionBy("node")
    most = F.max("df").over(Window.partitionBy("node", "shingle"))
    longest = F.dense_rank().over(own.orderBy(F.desc("most"), "shingle"))
    trimmed = lists.repartition("node").withColumn("most", most).withColumn("nr", longest)
    trimmed = trimmed.withColumn("met", F.max("nr").over(own)).withColumn("b", smallest).withColumn("need", need)
    trimmed = trimmed.where((F.col("met") >= F.col("need")) & (F.col("nr") > F.floor((F.col("need") - 1) / 2)))
    last, lists = lists, staged(trimmed.select("node", "token"), "lists")
    unstaged(last)
    out = linking.distinct_lists(lists.withColumnRenamed("token", "key"))
    unstaged(lists)
    return out


def _heavy_links(docs: DataFrame, heads: DataFrame, meets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Exact links among the classes that meet in lists."""
    nodes = staged(meets.select("node").distinct(), "meeting")
    few = staged(heads.join(linking.small(nodes), "node", "left_semi").select("k1", "k2", "head", "node"), "heads")
    sets = linking.whole_sets(docs, few, n)
    return linking.connect(meets, sets, linking.sketch_likeness(num, den), num, den)
