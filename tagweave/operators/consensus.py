"""Votes of several annotators turned into agreed tags and a controlled vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.scale import metric_rows

# Defaults of the vote.
MIN_VOTES = 2
CONSENSUS_SOURCE = "multi_llm_consensus_v1"
#: Synonym rows (two short keys and a spelling each) that are broadcast at most.
SYNONYM_ROWS = 50_000


def synonym_map(synonyms: DataFrame) -> DataFrame:
    """(raw_key, key, surface): comparison key of each variant and canonical.

    ``ordinal`` follows the order of the source list. When a variant is listed under several
    canonicals the last one wins; a canonical stands for itself unless a later row claims it.
    """
    canonical = X.normalize_tag(F.col("canonical"))
    rows = synonyms.filter((canonical != "") & ~F.col("canonical").startswith("_"))
    surfaces = rows.groupBy(canonical.alias("key")).agg(
        F.max_by("canonical", "ordinal").alias("surface"), F.min("ordinal").alias("first")
    )
    own = surfaces.select(
        F.col("key").alias("raw_key"), "key", F.struct("first", F.lit(0).alias("own")).alias("place")
    )
    variants = rows.select(
        X.normalize_tag(F.col("variant")).alias("raw_key"),
        canonical.alias("key"),
        F.struct(F.col("ordinal").alias("first"), F.lit(1).alias("own")).alias("place"),
    ).filter(F.coalesce("raw_key", F.lit("")) != "")
    chosen = own.unionByName(variants).groupBy("raw_key").agg(F.max_by("key", "place").alias("key"))
    return chosen.join(surfaces.select("key", "surface"), "key")


def synonym_conflicts(synonyms: DataFrame) -> DataFrame:
    """Variants listed under more than one canonical, for curation."""
    keyed = synonyms.select(
        X.normalize_tag(F.col("variant")).alias("raw_key"), "canonical"
    ).filter(F.coalesce("raw_key", F.lit("")) != "")
    return (
        keyed.groupBy("raw_key")
        .agg(F.sort_array(F.collect_set("canonical")).alias("canonicals"))
        .filter(F.size("canonicals") > 1)
    )


def fold_synonyms(tags: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Add ``key`` (folded comparison key) and ``surface`` (canonical spelling, if any) to tag rows.

    Rows whose tag has no letters or digits are dropped.
    """
    keyed = tags.withColumn("tag", X.strip("tag")).withColumn("raw_key", X.normalize_tag(F.col("tag")))
    keyed = keyed.filter(F.col("raw_key") != "")
    return (
        keyed.join(synonym_map(synonyms), "raw_key", "left")
        .withColumn("key", F.coalesce("key", "raw_key"))
    )


def answered(annotations: DataFrame, lineup: Sequence[str] | None = None) -> DataFrame:
    """Annotations that carry a tag list (an empty one counts), of the line-up or of everyone."""
    rows = annotations.filter(F.col("tags").isNotNull())
    return rows if lineup is None else rows.filter(F.col("annotator").isin(list(lineup)))


def _annotator_order(lineup: Sequence[str] | None) -> Column:
    """Line-up order first, then by name."""
    known = F.array(*[F.lit(a) for a in lineup or ()]).cast("array<string>")
    place = F.array_position(known, F.col("annotator"))
    return F.struct(F.when(place == 0, F.lit(1 << 30)).otherwise(place).alias("place"), F.col("annotator"))


def votes(annotations: DataFrame, synonyms: DataFrame, lineup: Sequence[str] | None = None) -> DataFrame:
    """Vote detail per (item, key): votes, voters, spellings and the surface form to show."""
    rows = answered(annotations, lineup).select(
        "item_id", "annotator", F.posexplode("tags").alias("pos", "tag")
    )
    seen = F.struct(_annotator_order(lineup).alias("who"), F.col("pos"))
    counted = fold_synonyms(rows, synonyms).groupBy("item_id", "key").agg(
        F.sort_array(F.collect_set("annotator")).alias("voters"),
        F.sort_array(F.collect_set("tag")).alias("surface_forms"),
        F.coalesce(F.max("surface"), F.min_by("tag", seen)).alias("tag"),
    )
    return counted.withColumn("votes", F.size("voters"))


def gate(annotations: DataFrame, min_votes: int, lineup: Sequence[str] | None = None) -> DataFrame:
    """Items answered by at least ``min_votes`` annotators."""
    return (
        answered(annotations, lineup)
        .groupBy("item_id")
        .agg(F.count_distinct("annotator").alias("n_answers"))
        .filter(F.col("n_answers") >= min_votes)
        .select("item_id")
    )


def consensus(
    annotations: DataFrame,
    synonyms: DataFrame,
    min_votes: int = MIN_VOTES,
    lineup: Sequence[str] | None = None,
) -> DataFrame:
    """Agreed tags per item, most votes first, then by key.

    Items with too few answers are left out; an item that passes but agrees on nothing gets an
    empty list.

    Annotations are laid out by item once; the gate, the votes and the lists are aggregations over that
    layout. An answer itself is one more row of its item, without a key, so that items are gated by the
    same aggregation that counts the votes. Synonyms are broadcast up to SYNONYM_ROWS, beyond that tags
    meet them by key and are laid out by item afterwards.
    """
    rows = answered(annotations, lineup).select("item_id", "annotator", "tags")
    names = synonym_map(synonyms)
    small = names.limit(SYNONYM_ROWS + 1).count() <= SYNONYM_ROWS
    if small:
        names, rows = F.broadcast(names), rows.repartition("item_id")
    some = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(None).cast("string")))
    spread = rows.select("item_id", "annotator", F.posexplode(some).alias("pos", "tag"))
    spread = spread.withColumn("tag", X.strip("tag"))
    # Tags without letters and digits count for nothing, but their annotator has answered.
    spread = spread.withColumn("raw_key", F.nullif(X.normalize_tag(F.col("tag")), F.lit("")))
    folded = spread.join(names, "raw_key", "left").withColumn("key", F.coalesce("key", "raw_key"))
    if not small:
        folded = folded.repartition("item_id")
    seen = F.struct(_annotator_order(lineup).alias("who"), F.col("pos"))
    counted = folded.groupBy("item_id", "key").agg(
        F.collect_set("annotator").alias("voters"),
        F.coalesce(F.max("surface"), F.min_by("tag", seen)).alias("tag"),
    )
    agreed = F.col("key").isNotNull() & (F.size("voters") >= min_votes)
    listed = F.when(agreed, F.struct((-F.size("voters")).alias("v"), "key", "tag"))
    lists = counted.groupBy("item_id").agg(
        F.sort_array(F.collect_list(listed)).alias("listed"),
        F.size(F.array_distinct(F.flatten(F.collect_list("voters")))).alias("answers"),
    )
    return lists.filter(F.col("answers") >= min_votes).select(
        "item_id", F.transform("listed", lambda s: s["tag"]).alias("tags")
    )


def preferred_annotation(annotations: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Theme, mood and summary, all three from the first trusted annotator that has a theme."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("annotator"))
    rows = annotations.filter(X.blank_to_null(F.col("theme")).isNotNull()).withColumn("place", place)
    fields = F.struct("annotator", "theme", "mood", "summary")
    return (
        rows.filter(F.col("place") > 0)
        .groupBy("item_id")
        .agg(F.min_by(fields, "place").alias("f"))
        .select("item_id", "f.*")
    )


def run_consensus(
    items: DataFrame,
    annotations: DataFrame,
    synonyms: DataFrame,
    priority: Sequence[str],
    min_votes: int = MIN_VOTES,
    lineup: Sequence[str] | None = None,
    flags: DataFrame | None = None,
) -> DataFrame:
    """Items with agreed tags and preferred fields; items below the gate keep what they had.

    ``flags`` (item_id, flagged) restricts the vote to flagged items.
    """
    if flags is not None:
        annotations = annotations.join(flags.filter("flagged"), "item_id", "left_semi")
    agreed = consensus(annotations, synonyms, min_votes, lineup).withColumnRenamed("tags", "_tags")
    fields = preferred_annotation(annotations, priority).select(
        "item_id", *[F.col(c).alias(f"_{c}") for c in ("theme", "mood", "summary")]
    )
    joined = items.join(agreed.join(fields, "item_id", "left"), "item_id", "left")
    updated = F.col("_tags").isNotNull()
    joined = joined.withColumn(
        "tags_source", F.when(updated, F.lit(CONSENSUS_SOURCE)).otherwise(F.col("tags_source"))
    ).withColumn("tags", F.coalesce("_tags", "tags"))
    for c in ("theme", "mood", "summary"):
        joined = joined.withColumn(c, F.when(F.col("_theme").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return joined.drop("_tags", "_theme", "_mood", "_summary")


def consensus_vocabulary(agreed: DataFrame) -> DataFrame:
    """Tags with the number of items that carry them, most used first."""
    return (
        agreed.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "tag")
    )


def annotator_coverage(annotations: DataFrame) -> DataFrame:
    """Per annotator: rows with a tag list, successful rows and error rows."""
    has_tags = F.col("tags").isNotNull()
    failed = X.blank_to_null(F.col("error")).isNotNull()
    return annotations.groupBy("annotator").agg(
        F.count_if(has_tags).alias("with_tags"),
        F.count_if(has_tags & ~failed).alias("ok"),
        F.count_if(failed).alias("errors"),
    )


def full_lineup_items(annotations: DataFrame, lineup: Sequence[str]) -> DataFrame:
    """Number of items answered by every annotator of the line-up."""
    per_item = answered(annotations, lineup).groupBy("item_id").agg(
        F.count_distinct("annotator").alias("n")
    )
    return metric_rows(
        per_item, {"full_lineup": F.count_if(F.col("n") == len(set(lineup))), "answered": F.count(F.lit(1))}
    )


def singleton_tags(annotations: DataFrame, lineup: Sequence[str] | None = None) -> DataFrame:
    """Tags only one annotator ever used, by lower-trim spelling over the whole corpus.

    Not the consensus rule: no folding, and voters are counted across items.
    """
    rows = answered(annotations, lineup).select("item_id", "annotator", F.explode("tags").alias("surface"))
    rows = rows.withColumn("tag", X.value_key(F.col("surface"))).filter(F.col("tag") != "")
    return (
        rows.groupBy("tag")
        .agg(
            F.count_distinct("annotator").alias("voters"),
            F.count_distinct("item_id").alias("n_items"),
            F.min("surface").alias("surface"),
        )
        .filter(F.col("voters") == 1)
        .select("tag", "surface", "n_items")
    )
