"""Exact vector search for a table of queries, and vector table upkeep."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.functions.text import first_present
from tagweave.operators import blocks, regions
from tagweave.scale import top_per


def _nearest(cell: pd.DataFrame) -> pd.DataFrame:
    """Nearest corpus rows of one cell's queries."""
    left = cell[cell["is_query"]]
    right = cell[~cell["is_query"]].sort_values("id")
    if left.empty or right.empty:
        return pd.DataFrame(columns=["query_id", "item_id", "distance"])
    mine, theirs = blocks.unit_rows(left["vec"]), blocks.unit_rows(right["vec"]).T
    query_ids, item_ids = left["id"].to_numpy(), right["id"].to_numpy()
    fetch = int(left["fetch"].max())
    parts = []
    for low, high in blocks.strips(len(left)):
        distance = np.round(1.0 - mine[low:high] @ theirs, S.ROUND_DIGITS) + 0.0  # no negative zero
        rows, cols = blocks.best_per_row(-distance, np.ones_like(distance, dtype=bool), fetch)
        parts.append(
            pd.DataFrame(
                {
                    "query_id": query_ids[low:high][rows],
                    "item_id": item_ids[cols],
                    "distance": distance[rows, cols],
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    n: int,
    where: Sequence[str] = (),
    exclude: DataFrame | None = None,
    block_rows: int | None = None,
    region_rows: int = regions.REGION_ROWS,
) -> DataFrame:
    """The ``n`` nearest corpus rows of each query by cosine distance: exact, block by block.

    Without ``where``, a corpus of more than a few regions of ``region_rows`` is searched region by region,
    and only the regions that can hold an answer are visited (see ``regions``); the answers are the same.

    ``queries`` has query_id and vec, ``corpus`` item_id and vec. ``where`` names columns that both
    sides carry and that must be equal; they become the grouping of the blocks, so a predicate
    prunes the work. ``exclude`` lists (query_id, item_id) pairs that may not be answers; each query
    fetches that many more rows, so the answer stays exact. Rows without a vector take no part.
    """
    # Vectors of single precision travel as they are; arithmetic is double.
    single = dict(queries.dtypes)["vec"] == dict(corpus.dtypes)["vec"] == "array<float>"
    vec = F.col("vec").cast("array<float>" if single else "array<double>").alias("vec")
    q = queries.filter(F.col("vec").isNotNull()).select(F.col("query_id").alias("id"), vec, *where)
    c = corpus.filter(F.col("vec").isNotNull()).select(F.col("item_id").alias("id"), vec, *where)
    keys = list(where)
    fetch = F.lit(n)
    if exclude is not None:
        exclude = exclude.select("query_id", "item_id").distinct()
        extra = exclude.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("_extra"))
        q = q.join(extra, "id", "left")
        fetch = F.lit(n) + F.coalesce("_extra", F.lit(0))
    q = q.select("id", "vec", *keys, fetch.cast("int").alias("fetch"))
    rows = 0 if keys else c.count()
    if rows > regions.MIN_REGIONS * region_rows:
        return regions.knn(q, c, rows, n, exclude, block_rows, region_rows)
    c = c.withColumn("fetch", F.lit(0))
    cells = blocks.grid_cells(q, c, keys, "id", block_rows or 4 * blocks.BLOCK_ROWS)
    found = cells.groupBy(*keys, "cell_a", "cell_b").applyInPandas(
        _nearest, "query_id long, item_id long, distance double"
    )
    if exclude is not None:
        found = found.join(exclude, ["query_id", "item_id"], "left_anti")
    return top_per(found, ["query_id"], [F.asc("distance"), F.asc("item_id")], n)


def matching(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """AND of equality conditions; pushed into the Parquet scan."""
    for column, value in conditions.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def embeddable(items: DataFrame) -> DataFrame:
    """Items with a translation or a transliteration."""
    return items.filter(first_present(F.col("translation"), F.col("translit")).isNotNull())


def centroid(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, built from per-dimension averages so no group is collected."""
    flat = vectors.select(key, F.posexplode("vec").alias("dim", "x"))
    means = flat.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec")
    )

