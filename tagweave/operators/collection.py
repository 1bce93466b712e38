"""Membership of items in a curated collection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.scale import metric_rows

FLAG_COLUMNS = ("flagged", "chapters", "n_entries")
DEFAULT_SOURCE = "G"


def collection_index(entries: DataFrame, source: str = DEFAULT_SOURCE) -> DataFrame:
    """Flag row per item of one source: its chapters, sorted, and its number of entries.

    Entries are counted per (item, chapter) first, so the list step sees each chapter once.
    """
    rows = entries.filter(
        (F.col("source") == source) & F.col("item_id").isNotNull() & F.col("header_id").isNotNull()
    )
    per_chapter = rows.groupBy("item_id", "header_id").agg(F.count(F.lit(1)).alias("n"))
    return per_chapter.groupBy("item_id").agg(
        F.lit(True).alias("flagged"),
        F.sort_array(F.collect_list("header_id")).alias("chapters"),
        F.sum("n").alias("n_entries"),
    )


def collection_coverage(flags: DataFrame) -> DataFrame:
    """Flagged items and distinct chapters covered."""
    items = metric_rows(flags, {"flagged_items": F.count_if("flagged")})
    chapters = flags.select(F.explode("chapters").alias("c")).agg(F.count_distinct("c").cast("double").alias("value"))
    return items.unionByName(chapters.select(F.lit("chapters").alias("metric"), "value"))


def merge_flags(existing: DataFrame, new: DataFrame, cols: tuple[str, ...] = FLAG_COLUMNS) -> DataFrame:
    """Replace one source's flag columns; rows without any flag left go, other sources stay."""
    others = [c for c in existing.columns if c not in {"item_id", *cols}]
    kept = existing.select("item_id", *others)
    has_other = reduce(or_, [F.col(c).isNotNull() for c in others], F.lit(False))
    kept = kept.filter(has_other)
    return kept.join(new.select("item_id", *cols), "item_id", "full_outer")


def by_flag(items: DataFrame, flags: DataFrame, mode: str = "all") -> DataFrame:
    """All items, only flagged ones, or only unflagged ones."""
    if mode == "all":
        return items
    how = {"flagged": "left_semi", "unflagged": "left_anti"}[mode]
    return items.join(flags.filter("flagged"), "item_id", how)
