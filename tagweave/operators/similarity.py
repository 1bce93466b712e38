"""How alike titles and lines are, as joins over distinct pairs of texts and words.

A pair is measured only if bounds from lengths and common letters leave it open; the measure is a function
of two columns and runs once for each distinct pair.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tagweave.functions import text as X
from tagweave.scale import staged

# Fixed values of the title score.
PREFIX_SCORE = 0.85
PREFIX_CHARS = 12
WORD_WEIGHT = 0.9
WORD_MATCH_MIN = 0.7

#: A ratio between 0 and 1 of two texts, at most 2 * common letters / length of both.
Measure = Callable[[Column, Column], Column]


@pandas_udf(DoubleType())
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of both texts in their matching blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer text."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def ratio_bound(a: Column, b: Column) -> Column:
    """No measure of the pair exceeds this: common characters, counted with repeats, over both lengths."""
    def count(c: Column, letter: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))

    both, rest = F.lit(0), [F.length(a), F.length(b)]
    for letter in " " + ascii_lowercase:
        n = [count(a, letter), count(b, letter)]
        both = both + F.least(*n)
        rest = [r - k for r, k in zip(rest, n)]
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * (both + F.least(*rest)) / total)


def measured(pairs: DataFrame, measure: Measure) -> DataFrame:
    """Distinct pairs left, right with their ratio; equal texts need no measuring."""
    same = F.col("left") == F.col("right")
    distinct = pairs.select("left", "right").distinct()
    alike = distinct.filter(same).withColumn("ratio", F.lit(1.0))
    return alike.unionByName(distinct.filter(~same).withColumn("ratio", measure(F.col("left"), F.col("right"))))


def similar_words(pairs: DataFrame, measure: Measure, above: float = WORD_MATCH_MIN) -> DataFrame:
    """Pairs of words left, right with a ratio above a limit."""
    distinct = pairs.select("left", "right").distinct()
    open_ = distinct.filter(ratio_bound(F.col("left"), F.col("right")) > above)
    return measured(open_, measure).filter(F.col("ratio") > above).select("left", "right")


def title_scores(pairs: DataFrame, title: str, line: str, measure: Measure = matching_blocks) -> DataFrame:
    """Distinct pairs of a clean title and a line with a score between 0 and 1.

    The highest of: the measure of the texts, the measure of their folded forms, a fixed score if the line
    begins like the title, and a weighted share of title words that are, or resemble, a word of the line.
    A line without letters scores 0; null lines are left out.
    """
    def words(c: Column) -> Column:
        return F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), X.normalize_translit)

    text = X.strip(F.lower(F.regexp_replace(F.col(line), r"[^a-zA-Z\s]", "")))
    texts = pairs.select(title, line).filter(F.coalesce(line, F.lit("")) != "").distinct()
    texts = texts.withColumn("_text", text).withColumns(
        {"_folded": X.normalize_translit(F.col(title)), "_line": X.normalize_translit(F.col("_text")),
         "_tw": words(F.col(title)), "_lw": F.array_distinct(words(F.col("_text")))}
    )
    texts = staged(texts, "title-texts")
    # Words: those in the line, and those that resemble one of its words.
    each = texts.select(title, line, "_lw", F.posexplode("_tw").alias("_pos", "_word"))
    found = F.array_contains("_lw", F.col("_word"))
    others = each.filter(~found).select(title, line, "_pos", "_word", F.explode("_lw").alias("_other"))
    others = staged(others, "title-words")
    near = similar_words(others.select(F.col("_word").alias("left"), F.col("_other").alias("right")), measure)
    near = near.select(F.col("left").alias("_word"), F.col("right").alias("_other"))
    resembling = others.join(near, ["_word", "_other"]).select(title, line, "_pos").distinct()
    matched = each.filter(found).select(title, line, "_pos").unionByName(resembling)
    matched = matched.groupBy(title, line).agg(F.count(F.lit(1)).alias("_matched"))
    share = WORD_WEIGHT * F.coalesce("_matched", F.lit(0)) / F.size("_tw")
    begins = F.col("_line").startswith(F.substring("_folded", 1, PREFIX_CHARS))
    base = F.greatest(
        F.when(begins, PREFIX_SCORE).otherwise(0.0),
        F.when((F.size("_tw") > 0) & (F.size("_lw") > 0), share).otherwise(0.0),
    )
    scored = texts.join(matched, [title, line], "left").withColumn("_base", base)
    scored = staged(scored.drop("_tw", "_lw", "_matched"), "title-bases")
    # Whole texts, where they can still raise the score.
    two = F.array(*[F.struct(F.col(a).alias("left"), F.col(b).alias("right")) for a, b in ((title, "_text"), ("_folded", "_line"))])
    open_ = scored.select("_base", F.explode(two).alias("p")).select("_base", "p.left", "p.right")
    open_ = open_.filter(ratio_bound(F.col("left"), F.col("right")) > F.col("_base"))
    ratios = staged(measured(open_, measure), "title-ratios")
    for left, right, name in ((title, "_text", "_r1"), ("_folded", "_line", "_r2")):
        side = ratios.select(F.col("left").alias(left), F.col("right").alias(right), F.col("ratio").alias(name))
        scored = scored.join(side, [left, right], "left")
    best = F.greatest("_base", F.coalesce("_r1", F.lit(0.0)), F.coalesce("_r2", F.lit(0.0)))
    return scored.select(title, line, best.alias("score"))
