"""Exact vector search that visits only the regions which can hold an answer.

The corpus is dealt to regions by each row's nearest pivot. A region remembers how far from its pivot its
nearest and farthest rows are. Angles obey the triangle inequality, so a query's angle to a pivot bounds
its distance to every row of that region. A first pass compares each query with the regions around it and
gives the distance that an answer must not exceed; a second one visits the other regions whose bound does
not exceed it. On clustered vectors that is a small part of all pairs; on vectors without any structure the
bounds say nothing and every region is visited. Results are those of comparing all pairs in either case.
Neighbouring regions share shelves, whose rows and visitors meet in bounded cells; a vector is copied once for
each block that it meets, however many regions there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.operators import blocks
from tagweave.scale import staged, top_per, unstaged

#: Rows of a region that the number of pivots aims at, and the most pivots, which travel to every task.
REGION_ROWS = 4096
MAX_PIVOTS = 1024
#: A corpus of fewer regions is compared block by block; two passes would cost more than they spare.
MIN_REGIONS = 8
#: Rows read for each pivot; pivots are picked among them, each far from those before.
SAMPLE_PER_PIVOT = 8
#: Bounds give way by this much, more than rounding of distances and of angles can amount to.
SLACK = 2e-6
ANSWER = "query_id long, item_id long, distance double"


@dataclass(frozen=True)
class Regions:
    """Pivots (unit rows) and, by region, the number of rows and their least and largest angle.

    The last region has no pivot: its rows are zero vectors, at distance 1 from everything.
    """

    pivots: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles of unit rows to the pivots, and the least distance to any row of each region."""
        angle = _angles(unit, self.pivots)
        gap = np.maximum(np.maximum(angle - self.far[:-1], self.near[:-1] - angle), 0.0)
        least = np.where(unit.any(axis=1, keepdims=True), 1.0 - np.cos(gap), 1.0)
        return angle, np.hstack([least, np.ones((len(unit), 1))])

    def home(self, angle: np.ndarray, fetch: np.ndarray) -> np.ndarray:
        """By query and region: whether the region is among the nearest that hold ``fetch`` rows together."""
        order = np.argsort(angle, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros((len(angle), len(self.size)), dtype=bool)
        np.put_along_axis(out, order, before < fetch[:, None], axis=1)
        return out & (self.size > 0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(unit), 0))
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def pick_pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """``n`` pivots at most, among a sample of rows by the hash of their ids: each is the one farthest from
    those before. Pivots decide what is visited, never what is found."""
    some = corpus.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64(F.lit(11), "id"), "id")
    unit = blocks.unit_rows(some.limit(n * SAMPLE_PER_PIVOT).select("vec").toPandas()["vec"])
    if not len(unit):
        return unit
    picked, closest = [0], unit @ unit[0]
    while len(picked) < n and closest.min() < 1.0 - SLACK:
        picked.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[picked[-1]])
    return unit[picked]


def _placed(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``corpus`` with each row's region and its angle to the region's pivot."""

    @F.pandas_udf("region int, angle double")
    def place(vec: pd.Series) -> pd.DataFrame:
        region, least = np.full(len(vec), len(pivots)), np.zeros(len(vec))
        for low, high in blocks.strips(len(vec)):
            unit = blocks.unit_rows(vec.iloc[low:high])
            some = np.flatnonzero(unit.any(axis=1))
            if len(some):
                angle = _angles(unit[some], pivots)
                region[low + some], least[low + some] = angle.argmin(axis=1), angle.min(axis=1)
        return pd.DataFrame({"region": region, "angle": least})

    return corpus.withColumn("p", place("vec")).select(*corpus.columns, "p.region", "p.angle")


def build(corpus: DataFrame, rows: int, region_rows: int = REGION_ROWS) -> tuple[DataFrame, Regions]:
    """The corpus (id and vec, about ``rows`` rows) by region, staged, and what is known of the regions."""
    pivots = pick_pivots(corpus, max(1, min(MAX_PIVOTS, -(-rows // region_rows))))
    placed = staged(_placed(corpus, pivots), "regions")
    # One row a region, so not more than there are pivots.
    known = placed.groupBy("region").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle")).collect()
    size = np.zeros(len(pivots) + 1, dtype=np.int64)
    near, far = np.zeros(len(size)), np.zeros(len(size))
    for region, n, low, high in known:
        size[region], near[region], far[region] = n, low, high
    return placed, Regions(pivots, size, near, far)


def _going(regions: Regions, rest: bool) -> Callable[[pd.Series, pd.Series, pd.Series], Iterator[np.ndarray]]:
    """By query and region: whether the query visits it; a strip of queries at a time.

    First the regions around a query; for the ``rest`` a limit has the distance that rows must not exceed
    (null: any), and regions visited at first are left out.
    """

    def going(vec: pd.Series, fetch: pd.Series, limit: pd.Series) -> Iterator[np.ndarray]:
        for low, high in blocks.strips(len(vec)):
            angle, least = regions.bounds(blocks.unit_rows(vec.iloc[low:high]))
            # Zero vectors come last among the regions around a query.
            angle = np.hstack([angle, np.full((len(angle), 1), np.inf)])
            go = regions.home(angle, fetch.iloc[low:high].to_numpy())
            if rest:
                most = limit.iloc[low:high].astype(float).fillna(np.inf).to_numpy()
                go = ~go & (regions.size > 0) & (least <= most[:, None] + SLACK)
            yield go

    return going


def _limited(queries: DataFrame, rest: bool) -> DataFrame:
    return queries.withColumn("limit", F.col("limit") if rest else F.lit(None).cast("double"))


def visits(queries: DataFrame, regions: Regions, rest: bool) -> DataFrame:
    """Queries (vec and fetch, for the ``rest`` limit) once for each region that they visit."""
    going = _going(regions, rest)

    @F.pandas_udf("array<int>")
    def where(vec: pd.Series, fetch: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(row).tolist() for go in going(vec, fetch, limit) for row in go])

    return _limited(queries, rest).withColumn("region", F.explode(where("vec", "fetch", "limit")))


@dataclass(frozen=True)
class Shelves:
    """Regions next to each other share a shelf, so a query's vector travels once a shelf, not once a region.

    By region its ``shelf`` and its ``place`` there; by shelf the number of ``rows``.
    """

    shelf: np.ndarray
    place: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, regions: Regions, shelf_rows: int) -> Shelves:
        """Fills shelves up to ``shelf_rows`` rows, each region followed by the nearest one that is left."""
        near = regions.pivots @ regions.pivots.T
        order, left = [], np.ones(len(near), dtype=bool)
        while left.any():
            order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()) if order else 0)
            left[order[-1]] = False
        shelf, place = np.zeros((2, len(regions.size)), dtype=np.int64)
        rows = [0]
        n_there = 0
        for region in [*order, len(near)]:
            if rows[-1] and rows[-1] + regions.size[region] > shelf_rows:
                rows.append(0)
                n_there = 0
            shelf[region], place[region] = len(rows) - 1, n_there
            rows[-1] += int(regions.size[region])
            n_there += 1
        return cls(shelf, place, np.array(rows))


def _shelf_visits(queries: DataFrame, regions: Regions, shelves: Shelves, rest: bool) -> DataFrame:
    """Queries once for each shelf that they visit; ``places`` has a bit for each place of the shelf."""
    going = _going(regions, rest)
    order = np.lexsort((shelves.place, shelves.shelf))
    ends = np.searchsorted(shelves.shelf[order], np.arange(len(shelves.rows)), side="right")

    @F.pandas_udf("array<binary>")
    def where(vec: pd.Series, fetch: pd.Series, limit: pd.Series) -> pd.Series:
        out = []
        for go in going(vec, fetch, limit):
            on = np.split(go[:, order], ends[:-1], axis=1)
            bits = [np.packbits(x, axis=1) for x in on]
            some = [x.any(axis=1) for x in on]
            out.extend([b[i].tobytes() if s[i] else None for b, s in zip(bits, some)] for i in range(len(go)))
        return pd.Series(out)

    gone = _limited(queries, rest).withColumn("to", where("vec", "fetch", "limit"))
    return gone.select("id", "vec", "fetch", "limit", F.posexplode("to").alias("shelf", "places")).filter("places is not null")


#: Rows of a shelf and of a block of its visitors, at most; fewer while the corpus has less than eight such shelves.
SHELF_ROWS = 1 << 16
#: Columns of a strip of a cell, and its numbers in all.
STRIP_COLUMNS = 4096
STRIP_AREA = 1 << 22
POINTS = 10**S.ROUND_DIGITS
def _answers(cell: pa.Table) -> pa.Table:
    """Each query's nearest rows of one cell, as many as it fetches and none beyond its limit.

    Rows are compared in single precision; those that can be answers are compared in full.
    """
    is_query = cell["is_query"]
    left, right = cell.filter(is_query), cell.filter(pc.invert(is_query))
    # Queries that fetch alike go together: one that excludes many rows costs the others nothing.
    left = left.sort_by("fetch")
    right = right.take(pc.sort_indices(right["id"], null_placement="at_start"))
    out = {"query_id": left["id"].slice(0, 0), "item_id": right["id"].slice(0, 0), "distance": pa.array([], pa.float64())}
    if not len(left) or not len(right):
        return pa.table(out)
    mine, theirs = blocks.unit_matrix(left["vec"]), blocks.unit_matrix(right["vec"])
    if not (usable := np.isfinite(theirs).all(axis=1)).all():
        right, theirs = right.filter(pa.array(usable)), theirs[usable]
    place = right["place"].to_numpy()
    by_place = np.argsort(place, kind="stable")
    place = place[by_place]
    rough, others = mine.astype(np.float32), theirs[by_place].astype(np.float32)
    room = blocks.single_error(mine)
    limit = left["limit"].to_numpy()
    most = np.where(np.isnan(limit), blocks.MOST_POINTS, np.rint(np.nan_to_num(limit) * POINTS)).astype(np.int64)
    best = blocks.FirstRows(left["fetch"].to_numpy().astype(np.int64), most, len(right))
    places = left["places"].combine_chunks()
    bits = np.frombuffer(b"".join(places.to_pylist()), dtype=np.uint8).reshape(len(left), -1)
    for here in np.unique(place):
        asking = np.flatnonzero(bits[:, here // 8] & (128 >> here % 8))
        first, last = np.searchsorted(place, (here, here + 1))
        for c in range(first, last, STRIP_COLUMNS):
            columns = slice(c, min(c + STRIP_COLUMNS, last))
            width = columns.stop - c
            for low, high in blocks.strips(len(asking), max(blocks.STRIP_ROWS, STRIP_AREA // width)):
                at = asking[low:high]
                near = rough[at] @ others[columns].T
                reach = 1 - (best.most[at] + 0.5) / POINTS - room
                k = int(best.fetch[at].max())
                free = np.flatnonzero(best.most[at] == blocks.MOST_POINTS)
                if len(free) and k < width:
                    # Rows of as many points may have a lower id.
                    kth = np.partition(near[free], width - k, axis=1)[:, width - k]
                    reach[free] = np.maximum(reach[free], kth - 2 * room - 2 / POINTS)
                row, column = np.divmod(blocks.true_places(near >= reach.astype(np.float32)[:, None]), width)
                for i in range(0, len(row), blocks.FULL_ROWS):
                    query, item = at[row[i : i + blocks.FULL_ROWS]], by_place[c + column[i : i + blocks.FULL_ROWS]]
                    distance = 1.0 - np.einsum("ij,ij->i", mine[query], theirs[item])
                    best.add(query, np.maximum(np.rint(distance * POINTS), 0).astype(np.int64), item)
    query, points, item = best.found()
    out = {"query_id": left["id"].take(pa.array(query)), "item_id": right["id"].take(pa.array(item)), "distance": points / POINTS}
    return pa.table(out)


def _compared(visiting: DataFrame, placed: DataFrame, shelves: Shelves, block_rows: int) -> DataFrame:
    """Answers of the shelves visited. Rows and visitors of a shelf are dealt to blocks, a cell has one of each.

    Numbers of blocks are known by shelf, at most one for each pivot, so no row meets them by shuffle.
    """
    coming = dict(visiting.groupBy("shelf").count().collect())
    if not coming:
        return placed.sparkSession.createDataFrame([], ANSWER)
    n_query = [-(-coming.get(s, 0) // block_rows) for s in range(len(shelves.rows))]
    n_corpus = [max(1, -(-int(n) // block_rows)) for n in shelves.rows]

    def dealt(df: DataFrame, is_query: bool) -> DataFrame:
        own, other = (n_query, n_corpus) if is_query else (n_corpus, n_query)
        own, other = (F.get(F.lit(x), F.col("shelf")) for x in (own, other))
        cells = (F.pmod(F.xxhash64("id"), own).cast("int"), F.explode(F.sequence(F.lit(0), other - 1)))
        names = ("cell_a", "cell_b") if is_query else ("cell_b", "cell_a")
        return df.filter(other > 0).select(
            "shelf", "id", "vec", "fetch", "limit", "places", "place", F.lit(is_query).alias("is_query"),
            cells[0].alias(names[0]), cells[1].alias(names[1]),
        )

    corpus = placed.withColumns({
        "shelf": F.get(F.lit(shelves.shelf.tolist()), F.col("region")),
        "place": F.get(F.lit(shelves.place.tolist()), F.col("region")),
        "fetch": F.lit(0), "limit": F.lit(None).cast("double"), "places": F.lit(None).cast("binary"),
    })
    both = dealt(visiting.withColumn("place", F.lit(0)), True).unionByName(dealt(corpus, False))
    return blocks.by_cell(both, ["shelf"]).groupBy("shelf", "cell_a", "cell_b").applyInArrow(_answers, ANSWER)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    rows: int,
    n: int,
    exclude: DataFrame | None = None,
    block_rows: int | None = None,
    region_rows: int = REGION_ROWS,
) -> DataFrame:
    """The ``n`` nearest rows of each query: query_id, item_id, distance, rank.

    ``queries`` has id, vec and fetch (``n`` and the number of its excluded rows), ``corpus`` id and vec;
    ``exclude`` has query_id and item_id. Vectors are not null. An empty corpus or no queries give no rows.
    """
    queries = staged(queries, "queries")
    placed, regions = build(corpus, rows, region_rows)
    block_rows = block_rows or max(4 * blocks.BLOCK_ROWS, min(SHELF_ROWS, rows // 8))
    shelves = Shelves.of(regions, block_rows)

    def answers(queries: DataFrame, rest: bool) -> DataFrame:
        found = _compared(_shelf_visits(queries, regions, shelves, rest), placed, shelves, block_rows)
        if exclude is not None:
            found = found.join(exclude, ["query_id", "item_id"], "left_anti")
        return top_per(found, ["query_id"], [F.asc("distance"), F.asc("item_id")], n).drop("rank")

    first = staged(answers(queries, rest=False), "first")
    limits = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= n, F.max("distance")).alias("limit")
    )
    limited = staged(queries.join(limits, "id", "left"), "limited")
    second = staged(answers(limited, rest=True), "second")
    unstaged(queries, placed, limited)
    return top_per(first.unionByName(second), ["query_id"], [F.asc("distance"), F.asc("item_id")], n)
