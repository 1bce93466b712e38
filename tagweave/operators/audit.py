"""Before/after comparison of two tag snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag family whose flips are reviewed, and the sample's defaults.
FAMILY_NAMES = ("hukam", "divine will", "divine command", "command", "will")
FAMILY_PART = "hukam"
SAMPLE_ROWS = 20
SAMPLE_SEED = 42
TOP_TAGS = 25


def _counts(snapshot: DataFrame, name: str) -> DataFrame:
    return snapshot.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias(name))


def snapshot_counts(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Uses of each tag before and after."""
    both = _counts(pre, "n_pre").join(_counts(post, "n_post"), "tag", "full_outer")
    zero = F.lit(0)
    return both.select("tag", F.coalesce("n_pre", zero).alias("n_pre"), F.coalesce("n_post", zero).alias("n_post"))


def top_tags(counts: DataFrame, n: int = TOP_TAGS) -> DataFrame:
    """Most used tags of the later snapshot."""
    return counts.filter(F.col("n_post") > 0).orderBy(F.desc("n_post"), "tag").limit(n)


def taxonomy_diff(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Tags that were added or dropped, with the uses they have or had."""
    counts = snapshot_counts(pre, post).filter((F.col("n_pre") == 0) | (F.col("n_post") == 0))
    change = F.when(F.col("n_pre") == 0, "added").otherwise("dropped")
    return counts.select("tag", change.alias("change"), F.greatest("n_pre", "n_post").alias("n")).orderBy(
        "change", F.desc("n"), "tag"
    )


def missing_refs(flags: DataFrame, items: DataFrame) -> DataFrame:
    """Flagged ids that the item table lacks."""
    return flags.filter("flagged").join(items, "item_id", "left_anti").select("item_id")


def in_family(tag: Column) -> Column:
    return F.lower(tag).isin(list(FAMILY_NAMES)) | F.contains(F.lower(tag), F.lit(FAMILY_PART))


def family_flips(pre: DataFrame, post: DataFrame, family: Callable[[Column], Column] = in_family) -> DataFrame:
    """Items of the later snapshot whose membership in a tag family changed."""
    empty = F.expr("cast(array() as array<string>)")
    joined = post.select("item_id", F.coalesce("tags", empty).alias("tags_post")).join(
        pre.select("item_id", F.col("tags").alias("tags_pre")), "item_id", "left"
    ).withColumn("tags_pre", F.coalesce("tags_pre", empty))
    before, after = F.exists("tags_pre", family), F.exists("tags_post", family)
    return joined.withColumn("before", before).withColumn("after", after).filter("before <> after")


def sample_n(df: DataFrame, n: int, seed: int = SAMPLE_SEED, key: str = "item_id") -> DataFrame:
    """``n`` rows without replacement, the same ones for every partitioning of the data."""
    lot = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(lot, key).limit(n)


def sample_diff(pre: DataFrame, post: DataFrame, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    """Sampled items with theme and tags before and after."""
    chosen = sample_n(post, n, seed).select(
        "item_id", F.col("theme").alias("theme_post"), F.col("tags").alias("tags_post")
    )
    return chosen.join(
        pre.select("item_id", F.col("theme").alias("theme_pre"), F.col("tags").alias("tags_pre")), "item_id", "left"
    )
