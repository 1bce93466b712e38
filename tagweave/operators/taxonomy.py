"""Raw theme values, their mapping to a vocabulary, and tagging by that mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.scale import metric_rows

ALIAS_SOURCE = "alias"


def value_counts(items: DataFrame, column: str) -> DataFrame:
    """Frequency of the non-blank values of a column."""
    value = F.col(column)
    return (
        items.filter(X.blank_to_null(value).isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_clusters(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge per-batch clusters (batch, tag, description, native_term, raw_values).

    Returns the tags, with the description of the first batch, and the mapping (tag, value): the
    union of the raw values. The mapping stays in rows because a tag's values are not bounded.
    """
    first = F.min_by(F.struct("description", "native_term"), "batch")
    tags = batches.groupBy("tag").agg(first.alias("f")).select("tag", "f.*")
    mapping = batches.select("tag", F.explode("raw_values").alias("value")).distinct()
    return tags, mapping


def vocab_coverage(mapping: DataFrame, counts: DataFrame) -> DataFrame:
    """Items covered and raw values mapped per tag, widest first."""
    return (
        mapping.join(counts, "value", "left")
        .groupBy("tag")
        .agg(
            F.sum(F.coalesce("n", F.lit(0))).alias("n_items"),
            F.count(F.lit(1)).alias("n_values"),
        )
        .orderBy(F.desc("n_items"), "tag")
    )


def mapping_disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Raw values (value, tag_a, tag_b) that two mappings (value, tag) send to different tags."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("value", X.blank_to_null(F.col("tag")).alias(name)).filter(F.col(name).isNotNull())

    return side(a, "tag_a").join(side(b, "tag_b"), "value").filter(F.col("tag_a") != F.col("tag_b"))


def disagreement_rate(disagreements: DataFrame, sample: DataFrame) -> DataFrame:
    """Disagreements, sample size and the whole-number percentage."""
    marked = sample.select("value").distinct().join(
        disagreements.select("value", F.lit(1).alias("_d")).distinct(), "value", "left"
    )
    total, bad = F.count(F.lit(1)), F.count("_d")
    return metric_rows(
        marked,
        {
            "disagreements": bad,
            "sampled": total,
            "percent": F.floor(bad * 100 / F.greatest(F.lit(1), total)),
        },
    )


def no_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items whose two tag sets are both non-empty and share nothing."""
    joined = a.select("item_id", F.col("tags").alias("tags_a")).join(
        b.select("item_id", F.col("tags").alias("tags_b")), "item_id"
    )
    return joined.filter(
        (F.size("tags_a") > 0) & (F.size("tags_b") > 0) & ~F.arrays_overlap("tags_a", "tags_b")
    )


def theme_aliases(vocabulary: DataFrame) -> DataFrame:
    """(alias, alias_tags): every tag of the vocabulary that lists the raw theme."""
    rows = vocabulary.filter(F.col("kind") == "theme").select("tag", F.explode("raw_values").alias("raw"))
    return rows.groupBy(X.value_key(F.col("raw")).alias("alias")).agg(
        F.sort_array(F.collect_set("tag")).alias("alias_tags")
    )


def mood_aliases(vocabulary: DataFrame) -> DataFrame:
    """(mood_alias, mood_tag): one tag per raw mood; the last vocabulary entry wins."""
    rows = vocabulary.filter(F.col("kind") == "mood").select(
        "tag", "ordinal", F.explode("raw_values").alias("raw")
    )
    return rows.groupBy(X.value_key(F.col("raw")).alias("mood_alias")).agg(
        F.max_by("tag", "ordinal").alias("mood_tag")
    )


def alias_tags(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Items with ``alias_tags``: theme aliases plus the mood's tag, null when neither matches."""
    keyed = items.withColumn("alias", X.value_key(F.coalesce("theme", F.lit("")))).withColumn(
        "mood_alias", X.value_key(F.coalesce("mood", F.lit("")))
    )
    joined = keyed.join(theme_aliases(vocabulary), "alias", "left").join(
        mood_aliases(vocabulary), "mood_alias", "left"
    )
    from_mood = F.when(F.col("mood_tag").isNotNull(), F.array("mood_tag"))
    tags = F.coalesce(F.array_union("alias_tags", from_mood), "alias_tags", from_mood)
    return joined.withColumn("alias_tags", F.sort_array(tags)).drop("alias", "mood_alias", "mood_tag")


def tag_by_alias(
    items: DataFrame, vocabulary: DataFrame, overwrite: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(tagged, unmatched) after alias tagging.

    Items that have tags keep them, unless ``overwrite`` is set (the library variant). Items no
    alias matches come back apart, for a slower annotator.
    """
    done = F.size(F.coalesce("tags", F.expr("cast(array() as array<string>)"))) > 0
    rows = alias_tags(items, vocabulary)
    matched = F.col("alias_tags").isNotNull()
    replace = matched if overwrite else matched & ~done
    tagged = (
        rows.filter(matched | done)
        .withColumn("tags_source", F.when(replace, ALIAS_SOURCE).otherwise(F.col("tags_source")))
        .withColumn("tags", F.when(replace, F.col("alias_tags")).otherwise(F.col("tags")))
        .drop("alias_tags")
    )
    return tagged, rows.filter(~matched & ~done).drop("alias_tags")


def valid_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tag rows whose tag the vocabulary holds, as theme or as mood."""
    return tags.join(vocabulary.select("tag").distinct(), "tag", "left_semi")


def _n_tags(c: Column) -> Column:
    return F.size(F.coalesce(c, F.expr("cast(array() as array<string>)")))


def tag_coverage(items: DataFrame) -> DataFrame:
    """Tagged items, whole-number percentage and mean tags per tagged item."""
    n = _n_tags(F.col("tags"))
    tagged = F.count_if(n > 0)
    return metric_rows(
        items,
        {
            "tagged": tagged,
            "total": F.count(F.lit(1)),
            "percent": F.floor(tagged * 100 / F.count(F.lit(1))),
            "mean_tags": F.round(F.sum(n) / F.greatest(F.lit(1), tagged), 4),
        },
    )
