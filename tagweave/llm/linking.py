"""Exact links among sets that share a list key, without comparing all pairs of a list.

Sets that may be similar meet in lists (a band's bucket, a shingle's inverted list). Round by round every
list that still holds several components names one of its members as pivot; each set is compared with
the one pivot that it shares most lists with, so a family of copies becomes one component at one
comparison a set and round. What then stays apart inside a list, the sets outside of its largest
component, meets all of the list in cells of bounded size: marks of the sets, less than a kilobyte each,
say which pairs can be similar at all. First each such set is compared in full with the few likeliest,
then with all that are left in other components. Pairs of one component are never looked at again, and
only a count of the whole intersection makes a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.jobs import unused
from tagweave.llm.words import mix, shingles, word_slices
from tagweave.scale import staged, unstaged

_U = np.uint64
#: Rounds of pivots before the rest is compared in cells.
ROUNDS = 2
#: Likeliest partners in a cell that a set is compared with before all others.
TRIES = 8
#: Counters of a set by which pairs are ruled out.
BUCKETS = 512
#: Sets on each side of a cell.
SIDE = 2048
#: Rows of short lists that are dealt to one cell, on average.
CELL_ROWS = 40_000
#: So many keys or ids (8 to 40 bytes each) are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Numberings of the classes that are tried for one without two equal numbers.
SEEDS = 16

#: Likeness of a set (size, mark) to several others (sizes, marks); below zero: not similar, whatever the sets.
Likeness = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def small(df: DataFrame) -> DataFrame:
    """``df`` (a staged table of a few numbers a row), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def text_hashes(text: Column) -> list[Column]:
    """128 bits that name a text: h1 and h2."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def numbering(classes: DataFrame) -> Column:
    """A number of 64 bits for each class (k1, k2), no two alike."""
    for seed in range(SEEDS):
        node = F.xxhash64(F.lit(seed), "k1", "k2")
        if classes.groupBy(node.alias("node")).count().where("count > 1").isEmpty():
            return node
    raise RuntimeError("more classes than 64 bits can number")


def set_slices(column: pa.Array, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Rows first to last of a text column and their sorted sets of shingles, a megabyte of text at a time."""
    for w in word_slices(column, lower=True):
        b = w.bounds
        yield w.first, w.last, [
            np.unique(shingles(w.hashes[b[i] : b[i + 1]], n)) for i in range(w.last - w.first)
        ]


def set_keys(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    out = []
    for seed in (0x51ED270B, 0x2545F491):
        sums = np.zeros(len(flat) + 1, _U)
        np.cumsum(mix(flat ^ _U(seed)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _tokens(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in set_slices(batch.column(1), n):
                sizes = np.array([len(s) for s in sets], np.int64)
                k1, k2 = set_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(k1), pa.array(k2),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "k1", "k2", "shingles"],
                )

    return run


def whole_sets(docs: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """node, size n, mark (bucket counts) and shingles (sorted, 8 bytes each) of classes: k1, k2, head, node.

    Texts are read where their id is a head's. Rows of one class and one id are alike; one is taken, within
    each task first.
    """
    ids = staged(heads.select("head").distinct(), "head-ids")
    few = small(ids)
    texts = docs.join(few, docs["doc_id"].eqNullSafe(few["head"]), "left_semi")
    sets = texts.mapInArrow(_tokens(n), "doc_id BIGINT, k1 BIGINT, k2 BIGINT, shingles BINARY")
    named = sets.join(small(heads), ["k1", "k2"]).where("doc_id <=> head")
    one = named.groupBy("node").agg(F.first("shingles").alias("shingles"))
    out = staged(one.mapInArrow(_sketches, "node BIGINT, n BIGINT, mark BINARY, shingles BINARY"), "sets")
    unstaged(ids)
    return out


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least num / den."""
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (len(a) + len(b) - shared)


def _judge(likeness: Likeness, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            sizes = {k: at[f"n_{k}"].to_numpy() for k in "ab"}
            marks = {k: _marks(at[f"mark_{k}"]) for k in "ab"}
            ok = []
            for i in range(batch.num_rows):
                likely = likeness(int(sizes["a"][i]), marks["a"][i], sizes["b"][i : i + 1], marks["b"][i][None, :])[0]
                sets = [np.frombuffer(at[f"shingles_{k}"][i].as_buffer(), _U) for k in "ab"]
                ok.append(bool(likely >= 0 and similar(*sets, num, den)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([at[c].filter(keep) for c in ("a", "b", "x", "y")], ["a", "b", "x", "y"])

    return run


def compared(pairs: DataFrame, bodies: DataFrame, likeness: Likeness, num: int, den: int) -> DataFrame:
    """The pairs a, b (of components x, y) that are similar: by their marks first, then by their whole sets.

    Narrow pairs meet the set of b first, which may be a pivot of very many, then that of a.
    """
    for k in "ba":
        own = bodies.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "mark", "shingles")])
        pairs = pairs.join(own, k)
    return pairs.mapInArrow(_judge(likeness, num, den), "a BIGINT, b BIGINT, x BIGINT, y BIGINT")


def stars(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph, as (node, root).

    Alternating large-star and small-star steps: every node hands its least neighbour to its larger ones,
    then to its smaller ones, until nothing changes and all edges end at their component's least node.
    Minima are aggregated within tasks before they are shuffled. No links give no rows.
    """
    bigger = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, last = staged(links.where("a <> b").select(*bigger).distinct(), "edges"), None
    for _ in range(max_rounds):
        check = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if check == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        last = check
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(small_star.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        unstaged(edges, large)
        edges = after
    raise RuntimeError("the graph did not become stars in the rounds given")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of each set fall into each bucket; all 255 if one has more than that."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), _U) for x in batch.column(1)]
        marks = []
        for s in sets:
            counts = np.bincount((s >> _U(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
            marks.append((counts if counts.max() < 255 else np.full(BUCKETS, 255)).astype(np.uint8).tobytes())
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, pa.array(marks, pa.binary()), batch.column(1)], ["node", "n", "mark", "shingles"]
        )


def sketch_likeness(num: int, den: int) -> Likeness:
    """Bounds from bucket counts: in no bucket do two sets share more than the smaller number there."""

    def likeness(n: int, mark: np.ndarray, ns: np.ndarray, marks: np.ndarray) -> np.ndarray:
        most = np.minimum(marks, mark).sum(axis=1, dtype=np.int64)
        uncounted = (marks[:, 0] == 255) | (mark[0] == 255)
        most = np.where(uncounted, np.minimum(ns, n), most)
        fits = (num * np.maximum(ns, n) <= den * np.minimum(ns, n)) & ((num + den) * most >= num * (ns + n))
        return np.where(fits, most / np.maximum(ns + n - most, 1), -1.0)

    return likeness


def _marks(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


def _cell_pairs(likeness: Likeness, tries: int | None):
    """Pairs of a cell's lists that can be similar and are in different components x and y.

    ``tries``: so many of the likeliest for each set, and a row of nulls if there are more; None: all.
    """

    def run(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).to_numpy() for c in ("key", "row", "col", "node", "comp", "minor", "n")}
        marks = np.stack(_marks(group.column("mark").combine_chunks()))
        order = np.lexsort((at["minor"], at["col"], at["row"], at["key"]))
        at = {k: v[order] for k, v in at.items()}
        new = np.any([at[k][1:] != at[k][:-1] for k in ("key", "row", "col")], axis=0)
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]])
        none = np.zeros((4, 0), np.int64)
        pairs, more = [none], False
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            split = lo + int(np.count_nonzero(at["minor"][lo:hi] == 0))
            nodes, comps, sizes = (at[k][lo:split] for k in ("node", "comp", "n"))
            whole = marks[order[lo:split]]
            for i in range(split, hi):
                node, comp = at["node"][i], at["comp"][i]
                other = np.flatnonzero(comps != comp)
                if not len(other):
                    continue
                alike = likeness(int(at["n"][i]), marks[order[i]], sizes[other], whole[other])
                other, alike = other[alike >= 0], alike[alike >= 0]
                if tries is not None and len(other) > tries:
                    other, more = other[np.argpartition(-alike, tries)[:tries]], True
                theirs, of = nodes[other], comps[other]
                less = node < theirs
                pairs.append(np.stack([
                    np.where(less, node, theirs), np.where(less, theirs, node), np.where(less, comp, of), np.where(less, of, comp)
                ]))
        out = np.unique(np.concatenate(pairs, axis=1), axis=1) if len(pairs) > 1 else none
        nulls = [None] * more
        return pa.table({c: pa.array([*row.tolist(), *nulls], pa.int64()) for c, row in zip("abxy", out)})

    return run


def _apart(here: DataFrame, bodies: DataFrame, likeness: Likeness, tries: int | None) -> DataFrame:
    """Pairs of lists with several components: those outside a list's largest component against all."""
    sizes = staged(here.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("size"), *_fingerprints(),
    ), "sizes")
    lists = sizes.groupBy("key").agg(
        F.sum("size").alias("m"), F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"),
        F.bit_xor("f1").alias("f1"), F.bit_xor("f2").alias("f2"),
    ).where("comps > 1")
    # Lists of the same sets give the same pairs: one of them is looked at.
    lists = lists.groupBy("m", "f1", "f2").agg(F.min(F.struct("key", "top")).alias("l"))
    few = F.col("m") - F.col("l.top.size")
    lists = staged(lists.select("l.key", F.col("l.top.comp").alias("top"), "m", few.alias("few")), "lists-apart")
    spread = F.lit(1 + (lists.agg(F.sum("m")).first()[0] or 0) // CELL_ROWS)
    cuts = lists.select(
        "key", "top", F.ceil(F.col("m") / SIDE).alias("cols"), F.ceil(F.col("few") / SIDE).alias("rows")
    )
    rows = here.join(small(cuts), "key")
    # Salts of a list's columns and rows; short lists share cells.
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    named = ["key", "node", "comp", "cols", "rows"]
    whole = rows.select(*named, F.lit(0).alias("minor"), part(1, "cols").alias("col"), each("rows").alias("row"))
    outer = rows.where("comp <> top")
    outer = outer.select(*named, F.lit(1).alias("minor"), part(2, "rows").alias("row"), each("cols").alias("col"))
    alone = (F.col("cols") > 1) | (F.col("rows") > 1)
    cell = F.when(alone, F.xxhash64("key", "row", "col")).otherwise(F.pmod(F.xxhash64("key"), spread))
    both = whole.unionByName(outer).withColumn("cell", cell).join(bodies.select("node", "n", "mark"), "node")
    both = both.select("cell", "key", "row", "col", "node", "comp", "minor", "n", "mark")
    pairs = both.groupBy("cell").applyInArrow(_cell_pairs(likeness, tries), "a BIGINT, b BIGINT, x BIGINT, y BIGINT").distinct()
    out = staged(pairs, "apart")
    unstaged(sizes, lists)
    return out


def _merged(here: DataFrame, found: DataFrame) -> DataFrame:
    """``here`` after links between components, (x, y); sets of one component are linked, but two that are
    linked by a long chain may still stay apart."""
    bigger, less = F.greatest("x", "y").alias("comp"), F.least("x", "y").alias("y")
    hooks = staged(found.where("x <> y").select(bigger, less).groupBy("comp").agg(F.min("y").alias("into")), "hooks")
    for _ in range(2):
        further = hooks.select(F.col("comp").alias("into"), F.col("into").alias("to"))
        after = hooks.join(small(further), "into", "left").select("comp", F.coalesce("to", "into").alias("into"))
        last, hooks = hooks, staged(after, "hooks")
        unstaged(last)
    out = here.join(small(hooks), "comp", "left").select(
        "key", "node", "weight", F.coalesce("into", "comp").alias("comp")
    )
    out = staged(out, "here")
    unstaged(here, hooks)
    return out


def _fingerprints() -> list[Column]:
    """128 bits that name the sets of a list."""
    return [F.bit_xor(F.xxhash64("node")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("f2")]


def distinct_lists(lists: DataFrame) -> DataFrame:
    """Lists (a staged table: key, node, each pair once) of two sets or more; of those of the same sets only one.

    Copies share hundreds of shingles and so as many lists. ``weight`` is the number of lists that one stands for.
    """
    named = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *_fingerprints()).where("m > 1")
    one = named.groupBy("m", "f1", "f2").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    one = staged(one.select("key", "weight"), "distinct-lists")
    out = staged(lists.join(small(one), "key").select("key", "node", "weight"), "lists")
    unstaged(one)
    return out


def connect(hits: DataFrame, bodies: DataFrame, likeness: Likeness, num: int, den: int) -> DataFrame:
    """Links (a, b) that join all similar sets sharing a list: every link's component comes out whole.

    ``hits``: key and node, each pair once, and the list's weight, 1 where there is none. ``bodies``: node,
    size n, mark (bytes of one length for all) and shingles. ``likeness`` must never deny a similar pair. No
    hits give no links.
    """
    weight = F.col("weight") if "weight" in hits.columns else F.lit(1)
    here = staged(hits.select("key", "node", weight.alias("weight"), F.col("node").alias("comp")), "here")
    for number in range(ROUNDS):
        order = F.col("node") if number == 0 else F.xxhash64(F.lit(number), "node")
        mixed = here.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.struct(order.alias("o"), "node", "comp")).alias("p"),
        ).where("lo <> hi")
        mixed = staged(mixed.select("key", F.col("p.node").alias("pivot"), F.col("p.comp").alias("to")), "mixed")
        met = here.join(small(mixed), "key").where("comp <> to").groupBy("node", "pivot", "comp", "to")
        best = met.agg(F.sum("weight").alias("shared")).groupBy("node")
        best = best.agg(F.max(F.struct("shared", "pivot", "comp", "to")).alias("m"))
        pairs = best.select(
            F.col("node").alias("a"), F.col("m.pivot").alias("b"), F.col("m.comp").alias("x"), F.col("m.to").alias("y")
        )
        found = staged(compared(pairs, bodies, likeness, num, den), "found")
        unstaged(mixed)
        if found.isEmpty():
            break
        here = _merged(here, found)
        unstaged(found)
    likeliest = _apart(here, bodies, likeness, TRIES)
    found = staged(compared(likeliest.where("a IS NOT NULL"), bodies, likeness, num, den), "found")
    if not likeliest.where("a IS NULL").isEmpty():
        here = _merged(here, found)
        rest = _apart(here, bodies, likeness, None).join(likeliest.select("a", "b"), ["a", "b"], "left_anti")
        # A component hooks onto one other at a time, so the likeliest links stay links of their own.
        found = found.union(staged(compared(rest, bodies, likeness, num, den), "found"))
    # Components so far as stars, and what joins them.
    links = here.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).distinct()
    return links.union(found.select("a", "b"))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` from each group: the one with the least id, then with the least text hash.

    ``rows`` has a row for each row of ``docs``: doc_id, h1, h2, grp; without grp a row is alone and stays.
    Ids are not names: rows with one id and unlike texts are told apart by their texts. Rows without an id
    take part and come last in their group. Of rows alike in id and text the one with the least hash of all
    its columns stays. Columns and their names are those of ``docs``.
    """
    key = unused([*docs.columns, "grp"], "no_id", "id", "hash1", "hash2")
    times, best = unused([*docs.columns, *key, "grp"], "times", "best")

    def keys(h1: Column, h2: Column) -> dict[str, Column]:
        doc_id = F.col("doc_id").cast("bigint")
        return dict(zip(key, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), h1, h2)))

    named = rows.where("grp IS NOT NULL").withColumns(keys(F.col("h1"), F.col("h2")))
    texts = staged(named.groupBy("grp", *key).agg(F.count(F.lit(1)).alias(times)), "texts")
    first = texts.groupBy("grp").agg(F.min(F.struct(*key, times)).alias(best))
    first = staged(first.select(f"{best}.*"), "best")
    again = first.where(F.col(times) > 1).select(*key)
    lost = staged(texts.select(*key).join(first, key, "left_anti").union(again), "lost")
    unstaged(texts)
    own = docs.withColumns(keys(*text_hashes(F.col("text").cast("string"))))
    kept = own.join(small(lost), key, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    alike = own.join(again, key, "left_semi").groupBy(*key)
    one = alike.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(best))
    return kept.unionByName(one.select(f"{best}.*"))
