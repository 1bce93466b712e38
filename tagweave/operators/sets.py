"""Saved sets: ordered lists of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.functions import text as X
from tagweave.scale import next_in_sequence, positions, top_per

# Texts of automatic names.
NAME_TAGS = 2
NAME_FALLBACK = ("Set (", " items)")
# Additions numbered together: a range of so many sequence numbers.
SEQ_RANGE = 4096


def transitions(sets: DataFrame) -> DataFrame:
    """Review of consecutive items: shared tags, strength and the edge between them.

    ``sets``: set_id, pos (dense from 0), item_id, tags. The last item of a set has no successor.
    """
    paired = next_in_sequence(sets, ["set_id"], "pos", {"item_id": "next_id", "tags": "next_tags"})
    shared = F.when(F.col("next_id").isNotNull(), X.shared_tags(F.col("tags"), F.col("next_tags")))
    return paired.filter(F.col("next_id").isNotNull()).select(
        "set_id", "pos", "item_id", "next_id", shared.alias("shared_tags")
    ).withColumn("strength", S.transition_strength(F.size("shared_tags")))


def trail_edges(sets: DataFrame) -> DataFrame:
    """Distinct directed edges between consecutive items of each set."""
    paired = next_in_sequence(sets, ["set_id"], "pos", {"item_id": "dst"})
    return paired.filter(F.col("dst").isNotNull()).select("set_id", F.col("item_id").alias("src"), "dst").distinct()


def set_details(sets: DataFrame, meta: DataFrame, items: DataFrame) -> DataFrame:
    """Details of every listed item, keyed by (set_id, pos), with metadata fallbacks."""
    m = meta.select("item_id", F.col("title").alias("_title"), F.col("theme").alias("_theme"), "tags")
    i = items.select("item_id", "display", "translit", "body", "translation", "theme", "refrain")
    return sets.join(m, "item_id", "left").join(i, "item_id", "left").select(
        "set_id", "pos", "item_id",
        F.coalesce(X.blank_to_null(F.col("_title")), X.display_title(F.col("display"), F.col("translit"))).alias("title"),
        F.coalesce(X.first_present(F.col("_theme"), F.col("theme")), F.lit("")).alias("theme"),
        F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("translation", F.lit("")).alias("translation"),
        F.coalesce("refrain.translation", F.lit("")).alias("refrain_translation"),
    )


def name_sets(sets: DataFrame) -> DataFrame:
    """Automatic name per set: its two most frequent tags, else its number of items."""
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_items"))
    counts = sets.select("set_id", F.explode("tags").alias("tag")).groupBy("set_id", "tag").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = top_per(counts, ["set_id"], [F.desc("n"), F.asc("tag")], NAME_TAGS)
    tags = F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"])
    named = top.groupBy("set_id").agg(F.array_join(tags, " & ").alias("name"))
    fallback = F.concat(F.lit(NAME_FALLBACK[0]), F.col("n_items").cast("string"), F.lit(NAME_FALLBACK[1]))
    return sizes.join(named, "set_id", "left").select("set_id", F.coalesce("name", fallback).alias("name"), "n_items")


def list_sets(sets: DataFrame) -> DataFrame:
    """Saved sets with their size, the latest change first."""
    rows = sets.groupBy("set_id").agg(
        F.min_by("name", "pos").alias("name"),
        F.count("item_id").alias("n_items"),
        F.max("created").alias("created"),
        F.max("updated").alias("updated"),
    )
    return rows.orderBy(F.desc(F.coalesce("updated", "created")), "set_id")


def add_to_set(sets: DataFrame, additions: DataFrame) -> DataFrame:
    """Append (set_id, seq, item_id) to sets; an item already in the set is skipped.

    New positions continue after the set's last one without gaps, in the order of ``seq``. Accepted
    additions are numbered range by range of ``seq``, so no set is ordered in one task.
    """
    last = sets.groupBy("set_id").agg((F.max("pos") + 1).alias("_base"))
    fresh = additions.groupBy("set_id", "item_id").agg(F.min("seq").alias("seq")).join(
        sets.select("set_id", "item_id"), ["set_id", "item_id"], "left_anti"
    )
    order = [F.asc("seq"), F.asc("item_id")]
    numbered = positions(fresh, ["set_id"], F.floor(F.col("seq") / SEQ_RANGE), order, "_nr")
    placed = numbered.join(last, "set_id", "left").select(
        "set_id", (F.coalesce("_base", F.lit(0)) + F.col("_nr")).cast("bigint").alias("pos"), "item_id"
    )
    return sets.select("set_id", F.col("pos").cast("bigint").alias("pos"), "item_id").unionByName(placed)
