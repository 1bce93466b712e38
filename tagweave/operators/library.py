"""The personal library: clean-up, carry-forward, title linkage, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.operators.search import keyword_hits
from tagweave.operators.similarity import Measure, matching_blocks, title_scores
from tagweave.scale import metric_rows, staged, top_per

# Fields an earlier run hands on, and the limits of the title linkage.
ENRICHMENT_FIELDS = (
    "page", "category", "author", "body", "translation", "translit", "item_id", "theme",
    "secondary_themes", "occasions", "mood", "summary", "match_confidence", "status",
)
MIN_TITLE_SCORE = 0.4
MAX_HITS = 30
MAX_QUERY_RESULTS = 500
DEFAULT_CONFIDENCE = "Medium"
COMPLETE = "complete"
UNMATCHED = "unmatched"
MIN_TRANSLATION = 20


def clean_field(c: Column) -> Column:
    """Trimmed text; blanks and the literal ``nan`` are missing."""
    return F.nullif(X.blank_to_null(c), F.lit("nan"))


def clean_tracks(df: DataFrame) -> DataFrame:
    """Library records from a track list with an explicit zero-based ``row_index``.

    Rows without a title go, their numbers stay unused.
    """
    rows = df.withColumn("title", clean_field(F.col("title"))).filter(F.col("title").isNotNull())
    optional = [c for c in ("perf_category", "style", "link", "notes") if c in df.columns]
    return rows.select(
        (F.col("row_index") + 1).cast("bigint").alias("rec_id"),
        "title",
        X.strip(F.coalesce("contributor", F.lit(""))).alias("contributor"),
        *[clean_field(F.col(c)).alias(c) for c in optional],
        F.coalesce(clean_field(F.col("confidence")), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.lit("pending").alias("status"),
    )


def carry_forward(fresh: DataFrame, prior: DataFrame, fields: tuple[str, ...] = ENRICHMENT_FIELDS) -> DataFrame:
    """Fresh records with the enrichment of an earlier run, matched on title and contributor.

    A prior value replaces the fresh one where it is not null. Among prior duplicates the one with
    the highest rec_id wins.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_t", X.value_key(F.col("title"))).withColumn(
            "_c", X.value_key(F.coalesce("contributor", F.lit("")))
        )

    used = [f for f in fields if f in prior.columns]
    last = keyed(prior).groupBy("_t", "_c").agg(
        F.max_by(F.struct(*used), "rec_id").alias("_prior")
    )
    joined = keyed(fresh).join(last, ["_t", "_c"], "left")
    carried = [
        F.coalesce(F.col(f"_prior.{f}"), F.col(f)).alias(f) if f in fresh.columns else F.col(f"_prior.{f}").alias(f)
        for f in used
    ]
    return joined.select(*[c for c in fresh.columns if c not in used], *carried)


def title_candidates(titles: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidate lines per distinct clean title, from progressively shorter keyword queries.

    The query is the title's first n words, then n−1 and n−2; the first length with 1 to 500 hits
    is used, else the first two words. All lengths share their first words, so one keyword search
    for those finds every hit and the number of leading words a line holds tells the lengths apart.
    The first thirty hits in line order remain, then one line per item.
    """
    clean = titles.select(X.clean_title(F.col("title")).alias("clean")).filter(F.col("clean") != "").distinct()
    split = clean.withColumn("words", F.split("clean", r"\s+")).withColumn("n", F.size("words"))
    base = F.slice("words", 1, 2)
    rows = lines.select("item_id", "line_no", X.word_array(X.clean_title(F.col("translit"))).alias("words"))
    found = keyword_hits(split.select(F.col("clean").alias("query_id"), base.alias("words")), rows, 2)
    held = (
        found.withColumnRenamed("query_id", "clean")
        .join(split.withColumnRenamed("words", "title_words"), "clean")
        .join(rows, ["item_id", "line_no"])
        .withColumn(
            "lead",
            F.aggregate(
                "title_words",
                F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
                lambda s, w: F.struct(
                    F.when(s["on"] & F.array_contains(F.col("words"), w), s["k"] + 1).otherwise(s["k"]).alias("k"),
                    (s["on"] & F.array_contains(F.col("words"), w)).alias("on"),
                ),
            )["k"],
        )
        .select("clean", "n", "item_id", "line_no", "lead")
    )
    counts = held.groupBy("clean", "n").agg(
        *[F.count_if(F.col("lead") >= F.col("n") - i).alias(f"c{i}") for i in range(3)]
    )
    usable = F.lit(None).cast("int")
    for i in (2, 1, 0):
        ok = (F.col("n") - i >= 2) & F.col(f"c{i}").between(1, MAX_QUERY_RESULTS)
        usable = F.when(ok, F.col("n") - i).otherwise(usable)
    length = counts.select("clean", F.coalesce(usable, F.least(F.lit(2), F.col("n"))).alias("use"))
    hits = held.join(length, "clean").filter(F.col("lead") >= F.col("use"))
    top = top_per(hits, ["clean"], [F.asc("item_id"), F.asc("line_no")], MAX_HITS)
    return top.groupBy("clean", "item_id").agg(F.min("line_no").alias("line_no"))


def best_match(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Best-scoring row per key; equal scores go to the earlier hit."""
    order = [F.desc("score"), F.asc("item_id"), F.asc("line_no")]
    return top_per(scored, keys, order, 1).drop("rank")


def link_titles(
    titles: DataFrame, lines: DataFrame, min_score: float = MIN_TITLE_SCORE, measure: Measure = matching_blocks
) -> DataFrame:
    """Link each title (rec_id, title) to the item of its best line, or mark it unmatched."""
    cands = title_candidates(titles, lines).join(lines.select("item_id", "line_no", "translit"), ["item_id", "line_no"])
    cands = staged(cands, "title-candidates")
    scores = title_scores(cands, "clean", "translit", measure)
    scored = cands.join(scores, ["clean", "translit"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = best_match(scored, ["clean"]).filter(F.col("score") >= min_score)
    linked = titles.withColumn("clean", X.clean_title(F.col("title"))).join(
        best.select("clean", "item_id", F.round("score", 2).alias("match_confidence")), "clean", "left"
    )
    status = F.when(F.col("item_id").isNull(), UNMATCHED).otherwise("pending")
    return linked.select("rec_id", "title", "item_id", "match_confidence", status.alias("status"))


def enrichable(items: DataFrame, min_length: int = MIN_TRANSLATION) -> DataFrame:
    """Items without a theme whose translation is longer than ``min_length``."""
    return items.filter(
        X.blank_to_null(F.col("theme")).isNull()
        & (F.length(F.coalesce("translation", F.lit(""))) > min_length)
    )


def enrichment_stats(library: DataFrame) -> DataFrame:
    """Totals, matched and complete records."""
    return metric_rows(
        library,
        {
            "total": F.count(F.lit(1)),
            "matched": F.count("item_id"),
            "complete": F.count_if(F.col("status") == COMPLETE),
        },
    )


def facets(library: DataFrame, columns: tuple[str, ...] = ("category", "perf_category")) -> DataFrame:
    """Sorted distinct values of facet columns, as (facet, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
    rows = library.select(F.explode(pairs).alias("p")).select("p.*")
    return rows.filter(X.blank_to_null(F.col("value")).isNotNull()).distinct().orderBy("facet", "value")


def search_library(
    library: DataFrame,
    q: str = "",
    contributor: str | None = None,
    category: str | None = None,
    confidence: str | None = None,
    fields: tuple[str, ...] = ("title", "theme", "contributor", "translation"),
) -> DataFrame:
    """Case-insensitive substring over ``fields`` and equality filters; slim rows."""
    rows = library
    if q:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(q.lower()))
        rows = rows.filter(hit)
    if contributor:
        rows = rows.filter(F.col("contributor") == contributor)
    if category:
        rows = rows.filter((F.col("category") == category) | (F.col("perf_category") == category))
    if confidence:
        rows = rows.filter(F.col("confidence") == confidence)
    return rows.select(
        "rec_id", "title", X.first_body_line(F.col("body")).alias("first_line"), "contributor",
        "category", "perf_category", "page", "author", "theme", "mood", "confidence", "status", "item_id",
    )


def mark_in_library(hits: DataFrame, library: DataFrame) -> DataFrame:
    """Mark hits whose item a library record is linked to and give that record's id."""
    linked = library.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.max("rec_id").alias("library_id")
    )
    return hits.join(linked, "item_id", "left").withColumn("in_library", F.col("library_id").isNotNull())
