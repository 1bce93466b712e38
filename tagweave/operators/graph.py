"""Tag-balanced nearest-neighbour graph over tagged items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.functions import scores as S
from tagweave.functions import text as X
from tagweave.operators import blocks
from tagweave.scale import attach_to_key, metric_rows, staged, top_per


def item_tags(items: DataFrame, marker: str = X.MARKER_TAG) -> DataFrame:
    """One row per item and connector tag."""
    return items.select("item_id", F.explode(X.connector_tags(F.col("tags"), marker)).alias("tag"))


def tag_sizes(tags: DataFrame) -> DataFrame:
    """Number of items per tag."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def tag_index(tags: DataFrame) -> DataFrame:
    """Inverted index as postings (tag, item_id, n).

    Kept as rows, sorted within tags on write, because one tag may hold a large share of all items
    and must not become a single array.
    """
    return attach_to_key(tags, tag_sizes(tags), ["tag"], "item_id").select("tag", "item_id", "n")


def _connected(items: DataFrame, marker: str) -> DataFrame:
    """Items with at least one connector tag, their tags as a sorted distinct array."""
    tags = F.sort_array(X.connector_tags(F.col("tags"), marker))
    return items.select("item_id", tags.alias("tags"), "vec").filter(F.size("tags") > 0)


#: Rows of a block of items with vectors; kinds meet in blocks of ``blocks.BLOCK_ROWS``.
VECTOR_ROWS = 1 << 15
_CANDIDATE = "src long, tag string, core boolean, dst long, score double, n_tags int"
_KIND_CANDIDATE = "kind string, plain boolean, tag string, core boolean, dst long, score double"
#: Items of a kind that its lists hold: a branch pool, which also is the core pool and an item itself.
KIND_IDS = max(S.POOL_PER_TAG, S.CORE_PER_TAG + 1)


def _scored(n_shared: np.ndarray, mine: np.ndarray, theirs: np.ndarray, cos: np.ndarray | float) -> list[tuple]:
    """(core, rounded score, kept, candidates per tag) of core and of branch pairs."""
    core = n_shared == mine
    core_score = S.TAG_WEIGHT * (n_shared / (mine + theirs - n_shared)) + S.VECTOR_WEIGHT * cos
    bonus = np.minimum((theirs - n_shared) * S.BRANCH_NEW_TAG_BONUS, S.BRANCH_BONUS_CAP)
    branch_score = cos * S.BRANCH_VECTOR_WEIGHT + bonus + S.BRANCH_BASE
    return [
        (is_core, np.round(score, S.ROUND_DIGITS), keep, k)
        for is_core, score, keep, k in (
            (True, core_score, core & (core_score > S.CORE_MIN), S.CORE_PER_TAG),
            (False, branch_score, ~core & (branch_score > S.BRANCH_MIN), S.POOL_PER_TAG),
        )
    ]


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(source rows, target rows) of a cell: both ways, or all rows against each other."""
    if pdf["cell_a"].iat[0] == pdf["cell_b"].iat[0]:
        return [(np.arange(len(pdf)), np.arange(len(pdf)))]
    a, b = (np.flatnonzero(pdf["block"].to_numpy() == pdf[c].iat[0]) for c in ("cell_a", "cell_b"))
    return [(a, b), (b, a)] if len(a) and len(b) else []


#: Rows of a strip of kinds: its scores stay in a core's cache.
CELL_STRIP = 64
#: Rows and columns of a strip of vectors.
VECTOR_STRIP, VECTOR_COLUMNS = 1024, 4096
#: Pairs of a row that are scored in full to find a bound for all others.
FIRST_LOOK = 24
#: Scores are rounded before they are ranked; a bound leaves room for that.
ROUNDING = 2 * 10.0**-S.ROUND_DIGITS
#: Points of no score at all: pairs go by the points that their score lacks, fewest first.
POINTS = 10**S.ROUND_DIGITS
NO_SCORE = 2 * POINTS


class _Side:
    """One side of a cell: sources against targets, in order of their ids."""

    def __init__(self, pdf: pd.DataFrame, unit: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        ids = pdf["item_id"].to_numpy()
        self.src_ids, self.dst_ids, self.src_unit, self.dst_unit = ids[src], ids[dst], unit[src], unit[dst]
        self.rough, self.others = self.src_unit.astype(np.float32), self.dst_unit.astype(np.float32)
        self.room = blocks.single_error(unit)
        row, code, bits = blocks.tag_bits(pdf["tags"])
        self.src_bits, self.dst_bits = bits[src], bits[dst]
        n_tags = pdf["tags"].map(len).to_numpy(dtype=float)
        self.mine, self.theirs = n_tags[src], n_tags[dst]
        self.kind = pd.factorize(pdf["tags"].map(tuple))[0][src]
        # Targets by tag, and the tags of each source.
        at = np.full(len(pdf), -1)
        at[dst] = np.arange(len(dst))
        on = at[row] >= 0
        order = np.argsort(code[on], kind="stable")
        self.with_tag = np.split(at[row[on]][order], np.cumsum(np.bincount(code, weights=on).astype(int))[:-1])
        self.codes = np.split(code, np.cumsum(n_tags.astype(int))[:-1])
        self.src = src
        # How often a source may find itself.
        self.own = int(np.unique(self.dst_ids, return_counts=True)[1].max()) if np.isin(self.src_ids, self.dst_ids).any() else 0
        self.finite = np.isfinite(unit).all()

    def add(self, best: blocks.FirstRows, row: np.ndarray, col: np.ndarray, core: bool) -> None:
        """Score pairs in full and add those that are kept."""
        for i in range(0, len(row), blocks.FULL_ROWS):
            r, c = row[i : i + blocks.FULL_ROWS], col[i : i + blocks.FULL_ROWS]
            cos = np.einsum("ij,ij->i", self.src_unit[r], self.dst_unit[c])
            n_shared = np.bitwise_count(self.src_bits[r] & self.dst_bits[c]).sum(axis=1)
            _, score, keep, _ = _scored(n_shared.astype(float), self.mine[r], self.theirs[c], cos)[not core]
            keep &= self.src_ids[r] != self.dst_ids[c]
            best.add(r[keep], NO_SCORE - np.rint(score[keep] * POINTS).astype(np.int64), c[keep])

    def first(self, k: int, least: float) -> blocks.FirstRows:
        most = np.full(len(self.src), NO_SCORE - int(least * POINTS))
        return blocks.FirstRows(np.full(len(self.src), k), most, len(self.dst_ids))

    def reach(self, best: blocks.FirstRows, row: np.ndarray) -> np.ndarray:
        """The bound that a row's pairs must reach."""
        return (NO_SCORE - best.most[row]) / POINTS - ROUNDING - self.room

    def ranked(self, bound: np.ndarray) -> np.ndarray:
        """Pairs of vectors that are not finite have no score."""
        return bound if self.finite else np.where(np.isnan(bound), np.float32(-np.inf), bound)

    def core(self) -> blocks.FirstRows:
        """Best targets that have all tags of a source, found once for sources of the same tags."""
        best = self.first(S.CORE_PER_TAG, S.CORE_MIN)
        k = S.CORE_PER_TAG + self.own
        order = np.argsort(self.kind, kind="stable")
        for alike in np.split(order, np.flatnonzero(np.diff(self.kind[order])) + 1):
            bits = self.src_bits[alike[0]]
            lists = [self.with_tag[c] for c in self.codes[self.src[alike[0]]]]
            shortest = min(lists, key=len)
            targets = shortest[((self.dst_bits[shortest] & bits) == bits).all(axis=1)] if all(map(len, lists)) else shortest[:0]
            for low, high in blocks.strips(len(alike) if len(targets) else 0, max(1, VECTOR_STRIP * VECTOR_COLUMNS // max(1, len(targets)))):
                row = alike[low:high]
                near = self.ranked(self.rough[row] @ self.others[targets].T)
                near *= np.float32(S.VECTOR_WEIGHT)
                near += (S.TAG_WEIGHT * self.mine[row[0]] / self.theirs[targets]).astype(np.float32)
                reach = self.reach(best, row)
                if len(targets) > k:
                    kth = np.partition(near, len(targets) - k, axis=1)[:, len(targets) - k]
                    reach = np.maximum(reach, kth - 2 * self.room - ROUNDING)
                r, c = np.divmod(blocks.true_places(near >= reach.astype(np.float32)[:, None]), len(targets))
                self.add(best, row[r], targets[c], True)
        return best

    def branch(self) -> blocks.FirstRows:
        """Best targets that have some tags of a source.

        Any other tag than the cell's that is shared lowers a branch score, so the score with that tag only
        bounds it. A first look at the highest bounds gives a score that as many candidates reach as are
        wanted; only pairs whose bound reaches it, too, are scored.
        """
        best = self.first(S.POOL_PER_TAG, S.BRANCH_MIN)
        bonus = np.minimum((self.theirs - 1) * S.BRANCH_NEW_TAG_BONUS, S.BRANCH_BONUS_CAP) + S.BRANCH_BASE
        # The bonus is one more number of the targets' vectors.
        mine = np.hstack([self.rough, np.ones((len(self.rough), 1), dtype=np.float32)])
        theirs = np.hstack([self.others * np.float32(S.BRANCH_VECTOR_WEIGHT), bonus.astype(np.float32)[:, None]]).T
        for low, high in blocks.strips(len(mine), VECTOR_STRIP):
            row = np.arange(low, high)
            for start, end in blocks.strips(theirs.shape[1], VECTOR_COLUMNS):
                bound, width = self.ranked(mine[low:high] @ theirs[:, start:end]), end - start
                reach = self.reach(best, row)
                if not start and width > FIRST_LOOK:
                    look = np.partition(bound, width - FIRST_LOOK, axis=1)[:, width - FIRST_LOOK]
                    at = blocks.true_places(bound >= np.maximum(look, reach.astype(np.float32))[:, None])
                    self.add(best, low + at // width, at % width, False)
                    best.settle()
                    bound.ravel()[at] = -np.inf
                    reach = self.reach(best, row)
                at = blocks.true_places(bound >= reach.astype(np.float32)[:, None])
                self.add(best, low + at // width, start + at % width, False)
        return best


def _cell_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best core and branch candidates of every row of one (tag, block pair) cell."""
    pdf = pdf.sort_values("item_id").reset_index(drop=True)
    unit = blocks.unit_rows(pdf["vec"])
    parts = []
    for src, dst in _sides(pdf):
        side = _Side(pdf, unit, src, dst)
        for is_core, best in ((True, side.core()), (False, side.branch())):
            r, points, c = best.found()
            parts.append(
                pd.DataFrame(
                    {
                        "src": side.src_ids[r],
                        "core": is_core,
                        "dst": side.dst_ids[c],
                        "score": (NO_SCORE - points) / POINTS,
                        "n_tags": side.mine[r].astype(int),
                    }
                )
            )
    if not parts:
        return pd.DataFrame(columns=["src", "tag", "core", "dst", "score", "n_tags"])
    return pd.concat(parts, ignore_index=True).assign(tag=pdf["tag"].iat[0])


def _kind_candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best candidates of the kinds of one (tag, block pair) cell where vectors count for nothing.

    Twice: for the items without a vector, whom any item may answer, and for those with one, whom here
    only items without one answer. A kind's best ids are among the lists of as many best kinds, ordered
    by their least ids. Scores depend on three counts, so they are looked up by them.
    """
    kinds, parts = pdf["kind"].to_numpy(), []
    n_tags = pdf["tags"].map(len).to_numpy()
    counts = np.arange(n_tags.max() + 1)
    points = 10**S.ROUND_DIGITS

    @cache
    def by_counts(mine: int) -> list[tuple]:
        """(core, points or -1 by shared and their number of tags, candidates per tag) of a row with ``mine`` tags."""
        grid = counts[:, None], float(mine), np.maximum(counts, 1)[None, :], 0.0
        with np.errstate(divide="ignore"):
            return [(c, np.where(keep, np.rint(score * points), -1).ravel(), k) for c, score, keep, k in _scored(*grid)]

    for src, dst in _sides(pdf):
        n_shared = blocks.shared_counts(pdf["tags"], src, dst)
        n_shared *= len(counts)
        n_shared += n_tags[dst].astype(n_shared.dtype)
        for plain, asks, lists in ((True, "asks_plain", "ids"), (False, "asks_vec", "plain_ids")):
            size = pdf[lists].map(len).to_numpy()[dst]
            asking, listing = np.flatnonzero(pdf[asks].to_numpy(dtype=bool)[src]), np.flatnonzero(size > 0)
            if not len(asking) or not len(listing):
                continue
            listed = pdf[lists].to_numpy()[dst[listing]]
            order = np.argsort([v[0] for v in listed], kind="stable")
            listed, size, listing = listed[order], size[listing[order]], listing[order]
            asking = asking[np.argsort(n_tags[src[asking]], kind="stable")]
            at = np.arange(len(listing))
            for low, high in blocks.strips(len(asking), CELL_STRIP):
                of = n_tags[src[asking[low:high]]]
                for mine in np.unique(of):
                    rows = asking[low:high][of == mine]
                    places = n_shared[rows][:, listing]
                    for is_core, score, k in by_counts(int(mine)):
                        k += is_core  # an item may find itself
                        cost = score[places]
                        cost *= -len(at)
                        cost += at
                        r, c = blocks.least_per_row(cost, k)
                        if not len(r):
                            continue
                        n = size[c]
                        row, worth = np.repeat(r, n), np.repeat(score[places[r, c]] / points, n)
                        found = np.concatenate(listed[c])
                        order = np.lexsort((found, -worth, row))
                        row, worth, found = row[order], worth[order], found[order]
                        first = np.arange(len(row)) - np.searchsorted(row, row) < k
                        parts.append(
                            pd.DataFrame(
                                {
                                    "kind": kinds[src[rows[row[first]]]],
                                    "plain": plain,
                                    "core": is_core,
                                    "dst": found[first],
                                    "score": worth[first],
                                }
                            )
                        )
    if not parts:
        return pd.DataFrame(columns=["kind", "plain", "tag", "core", "dst", "score"])
    return pd.concat(parts, ignore_index=True).assign(tag=pdf["tag"].iat[0])


def _least_ids(rows: DataFrame, name: str) -> DataFrame:
    """The least ids of every kind, in order."""
    least = top_per(rows.select("kind", "item_id"), ["kind"], [F.asc("item_id")], KIND_IDS)
    return least.groupBy("kind").agg(F.sort_array(F.collect_list("item_id")).alias(name))


def _kinds(items: DataFrame, marker: str) -> DataFrame:
    """Connected items with their kind: items of the same tags are of one kind; ``plain`` ones lack a vector."""
    return _connected(items, marker).withColumn("kind", F.to_json("tags")).withColumn("plain", F.col("vec").isNull())


def kind_candidates(rows: DataFrame, block_rows: int) -> DataFrame:
    """Best candidates of every kind and tag among items for which vectors count for nothing."""
    kinds = (
        rows.groupBy("kind").agg(
            F.first("tags").alias("tags"),
            F.bool_or("plain").alias("asks_plain"), F.bool_or(~F.col("plain")).alias("asks_vec"),
        )
        .join(_least_ids(rows, "ids"), "kind")
        .join(_least_ids(rows.filter("plain"), "plain_ids"), "kind", "left")
        .withColumn("plain_ids", F.coalesce("plain_ids", F.expr("cast(array() as array<bigint>)")))
    )
    kinds = staged(kinds, "kinds")
    members = kinds.select("kind", F.explode("tags").alias("tag"))
    cells = blocks.pair_cells(members, kinds, "tag", "kind", block_rows)
    found = cells.groupBy("tag", "cell_a", "cell_b").applyInPandas(_kind_candidates, _KIND_CANDIDATE)
    best = top_per(
        found, ["kind", "plain", "tag", "core"], [F.desc("score"), F.asc("dst")], KIND_IDS, "_place"
    )
    return best.drop("_place")


def stand_ins(items: DataFrame, marker: str = X.MARKER_TAG) -> DataFrame:
    """(item_id, src): items without a vector whose candidates are those of another item of their tags.

    Such items differ at most in that each leaves itself out, and only the first of a kind are in its own
    lists. So the first other item of a kind without a vector stands in for all the others.
    """
    return _stand_ins(_kinds(items, marker))


def _stand_ins(kinds: DataFrame) -> DataFrame:
    rows = kinds.select("item_id", "kind", "plain")
    listed = top_per(rows, ["kind"], [F.asc("item_id")], KIND_IDS).select("item_id")
    alike = rows.filter("plain").join(listed, "item_id", "left_anti").select("item_id", "kind")
    first = alike.groupBy("kind").agg(F.min("item_id").alias("src"))
    return attach_to_key(alike, first, ["kind"], "item_id").filter("item_id <> src").select("item_id", "src")


def for_all(per_src: DataFrame, standing: DataFrame) -> DataFrame:
    """Rows of every item, those of items that others stand in for included. Reads ``per_src`` twice, so stages it."""
    per_src = per_src if hasattr(per_src, "staged_at") else staged(per_src, "per-src")
    copies = per_src.join(standing, "src").drop("src").withColumnRenamed("item_id", "src")
    return per_src.unionByName(copies)


def tag_candidates(
    items: DataFrame,
    marker: str = X.MARKER_TAG,
    block_rows: int | None = None,
    standing: DataFrame | None = None,
) -> DataFrame:
    """Best core and branch candidates per (item, tag), before the pools are cut.

    Core candidates share all of the item's tags, branch candidates only some. Pairs of items with
    vectors are compared in bounded blocks (see ``blocks``), so a tag carried by a third of all items runs as
    many cells. All other pairs score by their tags alone: there, kinds of items are compared instead of items.
    Items in ``standing`` (see ``stand_ins``) are left out as sources.
    The result is laid out by item, which every later step of the graph reuses.
    """
    return _tag_candidates(_kinds(items, marker), block_rows, standing)


def _tag_candidates(rows: DataFrame, block_rows: int | None, standing: DataFrame | None) -> DataFrame:
    with_vec = rows.filter(~F.col("plain")).select("item_id", "tags", "vec")
    members = with_vec.select("item_id", F.explode("tags").alias("tag"))
    cells = blocks.pair_cells(members, with_vec, "tag", "item_id", block_rows or VECTOR_ROWS)
    found = cells.groupBy("tag", "cell_a", "cell_b").applyInPandas(_cell_candidates, _CANDIDATE)
    narrow = rows.select("item_id", "tags", "kind", "plain")
    sources = narrow.select(F.col("item_id").alias("src"), "kind", "plain", F.size("tags").alias("n_tags"))
    if standing is not None:
        sources = sources.join(standing.select(F.col("item_id").alias("src")), "src", "left_anti")
    by_kind = sources.join(kind_candidates(narrow, block_rows or blocks.BLOCK_ROWS), ["kind", "plain"]).filter("src <> dst")
    return found.unionByName(by_kind.select(*found.columns)).repartition("src")


@dataclass
class Candidates:
    """What edges and pools of a graph are made from: pools of items that no other stands in for."""

    rows: DataFrame
    standing: DataFrame
    pooled: DataFrame

    def pools(self) -> DataFrame:
        """The pools of every (item, tag)."""
        return for_all(self.pooled, self.standing)

    def edges(self, k_max: int = S.K_MAX, per_tag_min: int = S.PER_TAG_MIN) -> DataFrame:
        return for_all(_pooled_edges(self.rows.select("item_id", "tags"), self.pooled, k_max, per_tag_min), self.standing)


def candidates(items: DataFrame, marker: str = X.MARKER_TAG, block_rows: int | None = None) -> Candidates:
    """Pools of a graph; what several of its steps read is derived from the items once and staged."""
    rows = staged(_kinds(items, marker), "connected")
    standing = staged(_stand_ins(rows), "stand-ins")
    return Candidates(rows, standing, pool_topk(_tag_candidates(rows, block_rows, standing)))


def candidate_pools(items: DataFrame, marker: str = X.MARKER_TAG, block_rows: int | None = None) -> DataFrame:
    """The pools of every (item, tag)."""
    return candidates(items, marker, block_rows).pools()


def pool_topk(candidates: DataFrame) -> DataFrame:
    """Top core pool plus the branch pool that fills up to eight per (item, tag)."""
    best = top_per(
        candidates, ["src", "tag", "core"], [F.desc("score"), F.asc("dst")], S.POOL_PER_TAG, "pool_rank"
    )
    best = best.filter(~F.col("core") | (F.col("pool_rank") <= S.CORE_PER_TAG))
    per_tag = Window.partitionBy("src", "tag")
    n_core = F.count_if(F.col("core")).over(per_tag)
    room = F.greatest(F.lit(S.CORE_PER_TAG), F.lit(S.POOL_PER_TAG) - n_core)
    return best.withColumn("_room", room).filter(
        F.col("core") | (F.col("pool_rank") <= F.col("_room"))
    ).drop("_room")


def allocate_slots(
    pooled: DataFrame, k_max: int = S.K_MAX, per_tag_min: int = S.PER_TAG_MIN
) -> DataFrame:
    """Give every tag of an item its share of the neighbour slots, best scores first."""
    w = Window.partitionBy("src", "tag").orderBy(
        F.desc("score"), F.desc("core"), F.asc("dst")
    )
    slots = F.greatest(F.lit(per_tag_min), F.floor(F.lit(k_max) / F.col("n_tags")))
    return pooled.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= slots)


def finalize_edges(allocated: DataFrame, k: int = S.K_MAX) -> DataFrame:
    """One row per (item, neighbour) with its best score; the best ``k`` per item, ranked."""
    merged = allocated.groupBy("src", "dst").agg(
        F.max("score").alias("score"), F.bool_or("core").alias("core")
    )
    return top_per(merged, ["src"], [F.desc("score"), F.desc("core"), F.asc("dst")], k).select(
        "src", "dst", "score", "rank"
    )


def similarity_graph(
    items: DataFrame,
    marker: str = X.MARKER_TAG,
    k_max: int = S.K_MAX,
    per_tag_min: int = S.PER_TAG_MIN,
    block_rows: int | None = None,
) -> DataFrame:
    """Edges (src, dst, score, shared_tags, rank) of the tag-balanced graph.

    ``items`` needs item_id, tags and vec (an array, null when the item has no vector). Scores are
    rounded to six digits before ranking; ties prefer core over branch, then the lower id.
    """
    return candidates(items, marker, block_rows).edges(k_max, per_tag_min)


def pooled_edges(
    items: DataFrame,
    pooled: DataFrame,
    marker: str = X.MARKER_TAG,
    k_max: int = S.K_MAX,
    per_tag_min: int = S.PER_TAG_MIN,
) -> DataFrame:
    """The edges of ``similarity_graph`` from candidate pools that are there already."""
    return _pooled_edges(_connected(items, marker).select("item_id", "tags"), pooled, k_max, per_tag_min)


def _pooled_edges(tags: DataFrame, pooled: DataFrame, k_max: int, per_tag_min: int) -> DataFrame:
    edges = finalize_edges(allocate_slots(pooled, k_max, per_tag_min), k_max)
    src = tags.select(F.col("item_id").alias("src"), F.col("tags").alias("src_tags"))
    dst = tags.select(F.col("item_id").alias("dst"), F.col("tags").alias("dst_tags"))
    return (
        edges.join(dst, "dst")
        .join(src, "src")
        .select(
            "src", "dst", "score",
            X.shared_tags(F.col("src_tags"), F.col("dst_tags")).alias("shared_tags"), "rank",
        )
    )


def with_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each given (src, dst) pair; 0 when either item has no vector."""
    a = vectors.select(F.col("item_id").alias("src"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("item_id").alias("dst"), F.col("vec").alias("_b"))
    cos = F.coalesce(S.cosine(F.col("_a"), F.col("_b")), F.lit(0.0))
    return pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("cos", cos).drop("_a", "_b")


def item_meta(items: DataFrame, marker: str = X.MARKER_TAG) -> DataFrame:
    """Metadata projection served next to the graph."""
    return items.select(
        "item_id",
        X.display_title(F.col("display"), F.col("translit")).alias("title"),
        "category", "author", "page",
        X.connector_tags(F.col("tags"), marker).alias("tags"),
        F.coalesce(F.array_contains("tags", marker), F.lit(False)).alias("is_marker"),
        "theme", "mood", "summary",
    )


def graph_stats(
    items: DataFrame, edges: DataFrame, marker: str = X.MARKER_TAG, pooled: DataFrame | None = None
) -> DataFrame:
    """Graph statistics as (metric, value) rows.

    Vector hits and misses are pair counts taken from per-tag sizes, (n·(n−1) ordered pairs per
    tag), not from enumerated pairs. With the candidate pools, the (item, tag) pairs without any
    candidate are counted, too.
    """
    tagged = items.filter(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)
    of_items = metric_rows(
        tagged,
        {
            "items": F.count(F.lit(1)),
            "markers": F.count_if(F.array_contains("tags", marker)),
        },
    )
    exploded = _connected(tagged, marker).select(
        F.explode("tags").alias("tag"), F.col("vec").isNotNull().alias("has_vec")
    )
    per_tag = exploded.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_vec").alias("v")
    )
    pairs = F.col("n") * (F.col("n") - 1)
    hits = F.col("v") * (F.col("v") - 1)
    of_tags = metric_rows(
        per_tag,
        {
            "tags": F.count(F.lit(1)),
            "items_per_tag": F.round(F.avg("n"), 1),
            "vector_hits": F.sum(hits),
            "vector_misses": F.sum(pairs - hits),
        },
    )
    degree = tagged.select(F.col("item_id").alias("src")).join(
        edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src", "left"
    )
    of_edges = metric_rows(
        degree, {"mean_degree": F.round(F.avg(F.coalesce("degree", F.lit(0))), 1)}
    )
    stats = of_items.unionByName(of_tags).unionByName(of_edges)
    if pooled is None:
        return stats
    empty = empty_clusters(items, pooled, marker)
    return stats.unionByName(metric_rows(empty, {"empty_clusters": F.count(F.lit(1))}))


def empty_clusters(
    items: DataFrame, pooled: DataFrame, marker: str = X.MARKER_TAG, least: float | None = None
) -> DataFrame:
    """(item, tag) pairs for which no candidate passed the score thresholds, or none scores ``least``."""
    keys = item_tags(items, marker).select(F.col("item_id").alias("src"), "tag")
    good = pooled if least is None else pooled.filter(F.col("score") >= least)
    return keys.join(good.select("src", "tag").distinct(), ["src", "tag"], "left_anti")


def diversity_metrics(edges: DataFrame, items: DataFrame, marker: str = X.MARKER_TAG) -> DataFrame:
    """Mean tag directions, redundant neighbours and neighbours per item with neighbours.

    Directions are the distinct tags over an item's neighbours that it does not carry itself; a
    neighbour is redundant when it shares all of the item's tags.
    """
    tags = _connected(items.withColumn("vec", F.lit(None)), marker).select("item_id", "tags")
    joined = (
        edges.select("src", "dst", F.size("shared_tags").alias("n_shared"))
        .join(tags.select(F.col("item_id").alias("src"), F.col("tags").alias("src_tags")), "src")
        .join(tags.select(F.col("item_id").alias("dst"), F.col("tags").alias("dst_tags")), "dst")
        .withColumn("fresh", X.new_tags(F.col("src_tags"), F.col("dst_tags")))
    )
    per_item = joined.groupBy("src").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("fresh")))).alias("directions"),
        F.count_if(F.col("n_shared") == F.size("src_tags")).alias("redundant"),
        F.count(F.lit(1)).alias("neighbours"),
    )
    return metric_rows(
        per_item,
        {m: F.round(F.avg(m), 4) for m in ("directions", "redundant", "neighbours")},
    )


@dataclass
class GraphBundle:
    """The tables of one saved graph."""

    edges: DataFrame
    index: DataFrame
    meta: DataFrame
    stats: DataFrame


def build_bundle(items: DataFrame, marker: str = X.MARKER_TAG) -> GraphBundle:
    """All graph tables of a corpus; ``items`` carries the metadata columns and ``vec``."""
    found = candidates(items, marker)
    found.pooled = staged(found.pooled, "pools")
    edges = staged(found.edges(), "edges")
    stats = graph_stats(items, edges, marker, found.pools())
    return GraphBundle(edges, tag_index(item_tags(items, marker)), item_meta(items, marker), stats)
