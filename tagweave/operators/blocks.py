"""Bounded blocks: the exact way to rank inside groups too large for one task.

A group (a tag, a vector partition) is split by hash into blocks of about ``block_rows`` rows.
Each pair of blocks is one cell, small enough for one task, where numpy scores every row against
every row, a strip of rows at a time, and keeps only the best few per row. Cells of one large group spread over the cluster,
nothing emits the pairs themselves, and merging the cells' winners gives the exact top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.scale import attach_to_key

BLOCK_ROWS = 4096
STRIP_ROWS = 256
#: Tasks for cells, at least, for each core; those without a cell cost nothing.
CELL_TASKS = 8


def _block_count(n: Column, block_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows))).cast("int")


def _own_block(id_col: str, n: str) -> Column:
    return F.expr(f"pmod(xxhash64({id_col}), {n})").cast("int")


def by_cell(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lay rows out by cell.

    Explicit, because grouping alone would accept rows already laid out by the group key, which
    puts all cells of a large group into one task. Into a fixed number of tasks, because adaptive execution
    would join partitions by their bytes, and a few MB of rows are minutes of work.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffled, CELL_TASKS * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys, "cell_a", "cell_b")


def pair_cells(
    members: DataFrame, payload: DataFrame, key: str, id_col: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows keyed for an all-against-all comparison inside each group.

    ``members`` holds (id, key) pairs, ``payload`` the wide columns per id. A row of block b goes to
    the cells (min(b, o), max(b, o)) for every block o, so each unordered pair of blocks meets
    exactly once. Sizes of the groups of several blocks are joined to the narrow pairs, salted; the payload
    moves once by id and once to its cells.
    """
    sizes = members.groupBy(key).agg(_block_count(F.count(F.lit(1)), block_rows).alias("n_blocks"))
    placed = (
        attach_to_key(members, sizes.filter("n_blocks > 1"), [key], id_col, "left")
        .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        .withColumn("block", _own_block(id_col, "n_blocks"))
        .join(payload, id_col)
        .withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    )
    cells = placed.select(
        key,
        *payload.columns,
        "block",
        F.least("block", "other").alias("cell_a"),
        F.greatest("block", "other").alias("cell_b"),
    )
    return by_cell(cells, [key])


def grid_cells(
    queries: DataFrame, corpus: DataFrame, keys: Sequence[str], id_col: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows keyed for an every-query-against-every-row comparison inside each group.

    Both tables have the same columns; the result tells them apart by ``is_query``. Each query block
    meets each corpus block in one cell. With few queries there is one query block, so the corpus is
    not repeated at all. Without keys the block counts are two scalars; with keys they are joined
    to narrow rows only.
    """
    is_query = F.col("is_query")
    both = queries.withColumn("is_query", F.lit(True)).unionByName(
        corpus.withColumn("is_query", F.lit(False))
    )

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(_block_count(F.count(F.lit(1)), block_rows).alias(name))

    if keys:
        sizes = counts(queries, "n_query").join(counts(corpus, "n_corpus"), list(keys))
        narrow = attach_to_key(both.select(id_col, "is_query", *keys), sizes, list(keys), id_col).drop(*keys)
        sized = both.join(narrow, [id_col, "is_query"])
    else:
        sized = both.withColumn("n_query", counts(queries, "n").scalar()).withColumn(
            "n_corpus", counts(corpus, "n").scalar()
        )
    placed = (
        sized.withColumn("n_own", F.when(is_query, F.col("n_query")).otherwise(F.col("n_corpus")))
        .withColumn("n_other", F.when(is_query, F.col("n_corpus")).otherwise(F.col("n_query")))
        .withColumn("own", _own_block(id_col, "n_own"))
        .withColumn("other", F.explode(F.expr("sequence(0, n_other - 1)")))
    )
    cells = placed.select(
        *both.columns,
        F.when(is_query, F.col("own")).otherwise(F.col("other")).alias("cell_a"),
        F.when(is_query, F.col("other")).otherwise(F.col("own")).alias("cell_b"),
    )
    return by_cell(cells, keys)


# ---- numpy helpers used inside one cell ------------------------------------------------------


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Unit-length rows in float64; a missing or zero vector becomes a zero row."""
    dim = next((len(v) for v in vectors if v is not None), 1)
    rows = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None:
            rows[i] = v
    return _unit(rows)


def unit_matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """``unit_rows`` of an Arrow column."""
    lists = vectors.combine_chunks()
    size = pc.unique(pc.list_value_length(lists))
    if len(size) != 1 or not size[0].as_py():
        return unit_rows(lists.to_pandas())
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


#: Tags of a cell that are counted by a matrix product; rarer ones go by lists of their rows.
DENSE_TAGS = 256


def shared_counts(tags: pd.Series, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Numbers of tags that source rows and target rows of a cell have in common.

    A rows x tags matrix holds the most frequent tags only, because a cell may see any number of rare ones.
    """
    sizes = tags.map(len).to_numpy()
    row = np.repeat(np.arange(len(tags)), sizes)
    code, names = pd.factorize(np.concatenate([np.asarray(t, dtype=object) for t in tags]))
    often = np.argsort(-np.bincount(code), kind="stable")[:DENSE_TAGS]
    column = np.full(len(names), -1)
    column[often] = np.arange(len(often))
    dense = column[code] >= 0
    has = np.zeros((len(tags), len(often)), dtype=np.float32)
    has[row[dense], column[code[dense]]] = 1
    out = (has[src] @ has[dst].T).astype(np.int32)
    if dense.all():
        return out
    place = np.full((2, len(tags)), -1)
    place[0, src], place[1, dst] = np.arange(len(src)), np.arange(len(dst))
    rare = np.flatnonzero(~dense)
    rare = rare[np.argsort(code[rare], kind="stable")]
    for rows in np.split(row[rare], np.flatnonzero(np.diff(code[rare])) + 1):
        mine, theirs = (p[rows][p[rows] >= 0] for p in place)
        out[np.ix_(mine, theirs)] += 1
    return out


def strips(n: int, size: int = STRIP_ROWS) -> list[tuple[int, int]]:
    """Row ranges that bound the score matrix held at a time."""
    return [(low, min(low + size, n)) for low in range(0, n, size)]


def true_places(mask: np.ndarray) -> np.ndarray:
    """Flat places of a mask's few true values; eight are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.int64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


def best_per_row(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` best kept scores; equal scores go to the lower column."""
    cost = np.where(keep, -scores, np.inf)
    if k < cost.shape[1]:
        worst = np.partition(cost, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((cost <= worst) & np.isfinite(cost))
    else:
        rows, cols = np.nonzero(np.isfinite(cost))
    order = np.lexsort((cols, cost[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def least_per_row(cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` lowest costs, lowest first, of costs that differ within a row.

    Costs above the number of columns mean none.
    """
    width = cost.shape[1]
    if k < width:
        cols = np.argpartition(cost, k - 1, axis=1)[:, :k]
    else:
        cols = np.broadcast_to(np.arange(width), cost.shape)
    chosen = np.take_along_axis(cost, cols, axis=1)
    order = np.argsort(chosen, axis=1)
    cols, chosen = np.take_along_axis(cols, order, axis=1), np.take_along_axis(chosen, order, axis=1)
    rows, at = np.nonzero(chosen < width)
    return rows, cols[rows, at]


#: Pairs that are compared in full at a time.
FULL_ROWS = 1 << 16
#: More points than a pair has.
MOST_POINTS = (1 << 21) - 1


def single_error(unit: np.ndarray) -> float:
    """What the product of two unit rows can be wrong by in single precision."""
    return (unit.shape[1] + 8) * 2.0**-23


class FirstRows:
    """Each row's columns of fewest points so far, ``fetch`` at most, and the points that others may have at ``most``.

    A pair is one number: row, points and column, in this order; equal points go to the lower column.
    """

    def __init__(self, fetch: np.ndarray, most: np.ndarray, n_columns: int) -> None:
        self.fetch, self.most, self.n_columns = fetch, most, n_columns
        self.pairs, self.new, self.n_new = np.zeros(0, dtype=np.int64), [], 0

    def add(self, row: np.ndarray, points: np.ndarray, column: np.ndarray) -> None:
        some = points <= self.most[row]
        self.new.append(((row[some] << 21) + points[some]) * self.n_columns + column[some])
        self.n_new += len(self.new[-1])
        # Limits lag behind a little, and pairs are sorted a few times only.
        if self.n_new > len(self.pairs) + FULL_ROWS:
            self.settle()

    def parts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row_points, column = np.divmod(pairs, self.n_columns)
        return row_points >> 21, row_points & MOST_POINTS, column

    def settle(self) -> None:
        pairs = np.sort(np.concatenate([self.pairs, *self.new]))
        row, points, _ = self.parts(pairs)
        kept = np.arange(len(pairs)) - np.searchsorted(row, row) < self.fetch[row]
        self.pairs, self.new, self.n_new = pairs[kept], [], 0
        row, points = row[kept], points[kept]
        n = np.bincount(row, minlength=len(self.fetch))
        full = np.flatnonzero((n >= self.fetch) & (n > 0))
        self.most[full] = np.minimum(self.most[full], points[np.cumsum(n)[full] - 1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, points and columns, by row and points."""
        self.settle()
        return self.parts(self.pairs)


def tag_bits(tags: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tags of a cell's rows: (row, code) pairs and, as bits of each row, the tags that several rows have."""
    row = np.repeat(np.arange(len(tags)), tags.map(len).to_numpy())
    code, names = pd.factorize(np.concatenate([np.asarray(t, dtype=object) for t in tags]))
    shared = np.flatnonzero(np.bincount(code, minlength=len(names)) > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    bits = np.zeros((len(tags), max(1, -(-len(shared) // 64))), dtype=np.uint64)
    some = place[code] >= 0
    at = place[code[some]]
    np.bitwise_or.at(bits, (row[some], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return row, code, bits
