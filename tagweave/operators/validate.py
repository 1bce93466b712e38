"""Two scorers check the tags of every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.scale import metric_rows

# Thresholds of the sampled rules.
NEUTRAL = 3
WEAK_RATE_MIN = 0.3
GLOBAL_WEAK_RATE = 0.5
RULE_MIN_COUNT = 3
UNKNOWN_THEME = "unknown"


def exploded_tags(items: DataFrame) -> DataFrame:
    """One row per item and current tag."""
    return items.select("item_id", F.explode("tags").alias("tag"))


def _scores_of(scores: DataFrame, scorer: str, name: str) -> DataFrame:
    """Score text per (item, tag) of one scorer."""
    return scores.filter(F.col("scorer") == scorer).select(
        "item_id", F.explode("scores").alias("tag", name)
    )


def raw_scores(item_tags: DataFrame, scores: DataFrame, a: str, b: str) -> DataFrame:
    """Score texts of both scorers next to every (item, tag); null where a scorer gave none."""
    keys = ["item_id", "tag"]
    return item_tags.join(_scores_of(scores, a, "raw_a"), keys, "left").join(
        _scores_of(scores, b, "raw_b"), keys, "left"
    )


def _as_int(c: Column) -> Column:
    return c.try_cast("int")


def align_scores(
    item_tags: DataFrame, scores: DataFrame, a: str, b: str, reset_both: bool = False
) -> DataFrame:
    """Integer scores of both scorers per (item, tag); a missing score counts as neutral.

    A score that is not a number is neutral too; with ``reset_both`` (the sampled variant) one bad
    score makes both neutral.
    """
    rows = raw_scores(item_tags, scores, a, b)
    neutral = F.lit(NEUTRAL)
    text_a, text_b = (F.coalesce(c, F.lit(str(NEUTRAL))) for c in ("raw_a", "raw_b"))
    score_a, score_b = _as_int(text_a), _as_int(text_b)
    if reset_both:
        bad = score_a.isNull() | score_b.isNull()
        score_a, score_b = (F.when(bad, neutral).otherwise(s) for s in (score_a, score_b))
    return rows.select(
        *item_tags.columns,
        F.coalesce(score_a, neutral).alias("score_a"),
        F.coalesce(score_b, neutral).alias("score_b"),
    )


def suggested_by_both(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(item, tag) pairs that both scorers suggest."""
    def of(scorer: str) -> DataFrame:
        rows = scores.filter(F.col("scorer") == scorer)
        return rows.select("item_id", F.explode("suggested").alias("tag")).distinct()

    return of(a).join(of(b), ["item_id", "tag"], "left_semi")


def validate(
    items: DataFrame, scores: DataFrame, vocabulary: DataFrame, a: str, b: str
) -> DataFrame:
    """Decision per (item, tag): kept, flagged, removed or added.

    Everything that is not weak for both scorers stays. A tag both suggest is added when it is in
    the vocabulary and not among the tags that stay, so a removed tag can come back.
    """
    aligned = align_scores(exploded_tags(items), scores, a, b)
    decided = aligned.withColumn("action", S.score_action(F.col("score_a"), F.col("score_b")))
    staying = decided.filter(F.col("action") != "removed").select("item_id", "tag")
    added = (
        suggested_by_both(scores, a, b)
        .join(items.filter(F.size("tags") > 0).select("item_id"), "item_id", "left_semi")
        .join(vocabulary.select("tag").distinct(), "tag", "left_semi")
        .join(staying, ["item_id", "tag"], "left_anti")
        .select(
            "item_id", "tag", F.lit(None).cast("int").alias("score_a"),
            F.lit(None).cast("int").alias("score_b"), F.lit("added").alias("action"),
        )
    )
    return decided.unionByName(added)


def tags_after(changes: DataFrame) -> DataFrame:
    """Tag list per item after the decisions."""
    kept = changes.filter(F.col("action") != "removed")
    return kept.groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def change_stats(changes: DataFrame) -> DataFrame:
    """Counters of a validation run; total counts the tags that were judged."""
    action = F.col("action")
    return metric_rows(
        changes,
        {
            "total": F.count_if(action != "added"),
            **{name: F.count_if(action == name) for name in ("kept", "removed", "added", "flagged")},
        },
    )


def weak_tags(aligned: DataFrame, min_rate: float = WEAK_RATE_MIN) -> DataFrame:
    """Share of uses that both scorers call weak, for tags above ``min_rate``."""
    weak = ((F.col("score_a") <= 2) & (F.col("score_b") <= 2)).cast("int")
    rates = aligned.groupBy("tag").agg(F.avg(weak).alias("rate"), F.count(F.lit(1)).alias("uses"))
    return rates.filter(F.col("rate") > min_rate).withColumn("rate", F.round("rate", 2))


def suggestion_rules(sample: DataFrame, scores: DataFrame, a: str, b: str) -> DataFrame:
    """How often both scorers suggest a tag, per theme of the sampled items."""
    theme = F.coalesce("theme", F.lit(UNKNOWN_THEME)).alias("theme")
    return (
        suggested_by_both(scores, a, b)
        .join(sample.select("item_id", theme), "item_id")
        .groupBy("theme", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def apply_suggestions(
    items: DataFrame, rules: DataFrame, present: DataFrame, min_count: int = RULE_MIN_COUNT
) -> DataFrame:
    """(item, tag) additions: rules seen often enough, on items of that theme without the tag."""
    theme = F.coalesce("theme", F.lit(UNKNOWN_THEME)).alias("theme")
    strong = rules.filter(F.col("n") >= min_count).select("theme", "tag")
    return (
        items.filter(F.size("tags") > 0)
        .select("item_id", theme)
        .join(strong, "theme")
        .join(present.select("item_id", "tag"), ["item_id", "tag"], "left_anti")
        .select("item_id", "tag")
    )


def validate_sampled(items: DataFrame, sample: DataFrame, scores: DataFrame, a: str, b: str) -> DataFrame:
    """Decisions for all items from rules learned on a scored sample.

    Tags scored by both follow their own scores. Others are removed when the tag is weak in more
    than half of its sampled uses and its name is not part of the item's theme. Suggestions that
    recur for a theme are added; they are not checked against the vocabulary.
    """
    in_sample = scores.join(sample.select("item_id"), "item_id", "left_semi")
    aligned = align_scores(exploded_tags(sample), in_sample, a, b, reset_both=True)
    weak = weak_tags(aligned).filter(F.col("rate") > GLOBAL_WEAK_RATE).select(
        "tag", F.lit(True).alias("weak")
    )
    judged = items.select("item_id", "theme", F.explode("tags").alias("tag"))
    rows = raw_scores(judged, in_sample, a, b).join(weak, "tag", "left")
    score_a, score_b = _as_int(F.col("raw_a")), _as_int(F.col("raw_b"))
    scored = F.col("raw_a").isNotNull() & F.col("raw_b").isNotNull()
    own_weak = F.coalesce((score_a <= 2) & (score_b <= 2), F.lit(False))
    theme = F.lower(F.coalesce("theme", F.lit("")))
    off_theme = F.coalesce("weak", F.lit(False)) & ~F.contains(theme, F.lower("tag"))
    rule = (
        F.when(scored & own_weak, "own_scores")
        .when(~scored & off_theme, "global_weak")
    )
    decided = rows.select("item_id", "tag", rule.alias("rule")).withColumn(
        "action", F.when(F.col("rule").isNull(), "kept").otherwise("removed")
    )
    staying = decided.filter(F.col("action") == "kept")
    added = apply_suggestions(items, suggestion_rules(sample, in_sample, a, b), staying)
    return decided.unionByName(
        added.withColumn("rule", F.lit("suggested")).withColumn("action", F.lit("added"))
    )
