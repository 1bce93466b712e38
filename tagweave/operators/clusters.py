"""Neighbour clusters for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.functions import scores as S
from tagweave.functions import text as X

VECTOR_HITS = 30
MIN_CLUSTER = 2
DEFAULT_THRESHOLD = 0.3
DEFAULT_PER_TAG = 8
NO_TAG_CLUSTER = "Similar"

# Boosted scores and means have more than six digits; rounding there would tie them by accident.
EXACT_DIGITS = 9

def _no_tags() -> Column:
    return F.expr("cast(array() as array<string>)")


def graph_hits(requests: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """Edges of each request with the boosted score; still without the threshold.

    ``requests``: req_id, src, threshold, per_tag, boost. ``flags``: item_id, flagged.
    """
    flagged = flags.select(F.col("item_id").alias("dst"), "flagged")
    return (
        requests.join(edges.select("src", "dst", F.col("score").alias("base_score"), "shared_tags"), "src")
        .join(flagged, "dst", "left")
        .withColumn("score", S.boost(F.col("base_score"), F.col("flagged"), F.col("boost")))
        .withColumn("from_vector", F.lit(False))
        .drop("flagged")
    )


def vector_hits(requests: DataFrame, found: DataFrame, flags: DataFrame) -> DataFrame:
    """Vector answers (req_id, dst, distance) of requests, thresholded after the boost."""
    flagged = flags.select(F.col("item_id").alias("dst"), "flagged")
    base = S.distance_to_score(F.col("distance"))
    return (
        requests.join(found, "req_id")
        .join(flagged, "dst", "left")
        .withColumn("score", S.boost(base, F.col("flagged"), F.col("boost")))
        .filter(F.col("score") >= F.col("threshold"))
        .withColumn("score", F.round("score", EXACT_DIGITS))
        .withColumn("base_score", F.col("score"))
        .withColumn("shared_tags", _no_tags())
        .withColumn("from_vector", F.lit(True))
        .drop("flagged", "distance")
    )


def blend(vector: DataFrame | None, graph: DataFrame) -> DataFrame:
    """Vector hits plus the graph hits over the threshold; a vector hit replaces the graph hit."""
    kept = graph.filter(F.col("score") >= F.col("threshold"))
    if vector is None:
        return kept
    keys = ["req_id", "dst"]
    rest = [c for c in kept.columns if c not in keys]
    both = kept.unionByName(vector).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "from_vector").alias("h")
    )
    return both.select(*keys, "h.*")


def ranked_tags(meta: DataFrame, tag_sizes: DataFrame) -> DataFrame:
    """(item_id, tags, theme, by_size): the item's tags also ordered from rarest to most common."""
    tags = meta.select("item_id", F.explode("tags").alias("tag")).join(tag_sizes, "tag", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tag")))
    by_size = tags.groupBy("item_id").agg(F.transform(order, lambda t: t["tag"]).alias("by_size"))
    return meta.select("item_id", "tags", "theme").join(by_size, "item_id", "left")


def rarest_tag(by_size: Column, mine: Column) -> Column:
    """First tag of a rarest-first list that the item does not carry itself; null if none."""
    return F.get(F.filter(by_size, lambda t: ~F.array_contains(mine, t)), 0)


def assign_clusters(hits: DataFrame, meta: DataFrame, tag_sizes: DataFrame) -> DataFrame:
    """One row per hit and cluster.

    A graph hit that shares all of the item's tags, or brings none of its own, joins every shared
    tag; otherwise it joins its rarest new tag. A vector hit joins the first of its tags that the
    item carries, else its rarest new tag; without tags it goes to its theme.
    """
    src = meta.select(F.col("item_id").alias("src"), F.col("tags").alias("src_tags"))
    dst = ranked_tags(meta, tag_sizes).select(
        F.col("item_id").alias("dst"), F.col("tags").alias("dst_tags"), F.col("theme").alias("dst_theme"), "by_size"
    )
    joined = (
        hits.join(src, "src", "left").join(dst, "dst", "left")
        .withColumn("src_tags", F.coalesce("src_tags", _no_tags()))
        .withColumn("dst_tags", F.coalesce("dst_tags", _no_tags()))
        .withColumn("by_size", F.coalesce("by_size", _no_tags()))
        .withColumn("rarest", rarest_tag(F.col("by_size"), F.col("src_tags")))
    )
    theme = F.coalesce(F.nullif(X.strip("dst_theme"), F.lit("")), F.lit(NO_TAG_CLUSTER))
    matching = F.array_intersect("dst_tags", "src_tags")
    all_shared = F.size(F.array_except("src_tags", "shared_tags")) == 0
    from_vector = F.col("from_vector")
    clusters = (
        F.when(from_vector & (F.size("dst_tags") == 0), F.array(theme))
        .when(from_vector & (F.size(matching) > 0), F.slice(matching, 1, 1))
        .when(~from_vector & (all_shared | F.col("rarest").isNull()), F.col("shared_tags"))
        .otherwise(F.array("rarest"))
    )
    return joined.select(
        "req_id", "src", "dst", "score", "per_tag", "from_vector", "src_tags",
        F.explode(clusters).alias("cluster"),
    )


def _cap(clustered: DataFrame) -> DataFrame:
    w = Window.partitionBy("req_id", "cluster").orderBy(F.desc("score"), F.asc("dst"))
    return clustered.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("per_tag"))


def merge_thin(clustered: DataFrame, min_size: int = MIN_CLUSTER) -> DataFrame:
    """Fold one-item clusters that are not a tag of the item into a better one, then cap again.

    The target is the core cluster with the highest mean score, else the largest cluster that is
    not thin, measured once before merging; ties go to the first name. With no target, thin
    clusters stay as they are. A request has few rows, so all of this runs over one shuffle.
    """
    cluster, request = Window.partitionBy("req_id", "cluster"), Window.partitionBy("req_id")
    core = F.array_contains("src_tags", F.col("cluster"))
    measured = (
        clustered.withColumn("_n", F.count(F.lit(1)).over(cluster))
        .withColumn("_mean", F.round(F.avg("score").over(cluster), EXACT_DIGITS))
        .withColumn("_thin", ~core & (F.col("_n") < min_size))
    )
    core_rank = F.struct(-F.col("_mean"), F.col("cluster"))
    size_rank = F.struct(-F.col("_n"), F.col("cluster"))
    target = F.coalesce(
        F.min_by("cluster", F.when(core, core_rank)).over(request),
        F.min_by("cluster", F.when(~F.col("_thin"), size_rank)).over(request),
    )
    moved = measured.withColumn("_target", target).withColumn(
        "cluster", F.when(F.col("_thin"), F.coalesce("_target", "cluster")).otherwise(F.col("cluster"))
    )
    return _cap(moved.drop("_n", "_mean", "_thin", "_target", "rank"))


def neighbor_clusters(
    requests: DataFrame,
    edges: DataFrame,
    meta: DataFrame,
    tag_sizes: DataFrame,
    flags: DataFrame,
    vector_found: DataFrame | None = None,
) -> DataFrame:
    """Clusters (req_id, cluster, dst, score, rank) of every request in one job.

    ``vector_found`` (req_id, dst, distance) holds the nearest items of the requests' own query
    vectors; leave it out for the pure graph answer.
    """
    graph = graph_hits(requests, edges, flags)
    vector = None if vector_found is None else vector_hits(requests, vector_found, flags)
    assigned = assign_clusters(blend(vector, graph), meta, tag_sizes).repartition("req_id")
    return merge_thin(_cap(assigned)).select(
        "req_id", "src", "cluster", "dst", "score", "from_vector", "rank"
    )


def shown_totals(clustered: DataFrame) -> DataFrame:
    """Rows shown per request (repeats count) and distinct items shown."""
    return clustered.groupBy("req_id").agg(
        F.count(F.lit(1)).alias("total_shown"), F.count_distinct("dst").alias("distinct_shown")
    )


def score_range(graph: DataFrame, vector: DataFrame | None = None) -> DataFrame:
    """Min, max and upper median of the unboosted graph scores and the kept vector scores.

    At most ``K_MAX`` edges and ``VECTOR_HITS`` hits exist per request, which bounds the list.
    """
    cols = ["req_id", "base_score"]
    rows = graph.select(*cols)
    if vector is not None:
        rows = rows.unionByName(vector.select(*cols))
    ordered = F.sort_array(F.collect_list("base_score"))
    return rows.groupBy("req_id").agg(
        F.min("base_score").alias("score_min"),
        F.max("base_score").alias("score_max"),
        F.element_at(ordered, (F.count(F.lit(1)) / 2).cast("int") + 1).alias("score_median"),
        F.count(F.lit(1)).alias("total_available"),
    )


def with_meta(df: DataFrame, meta: DataFrame, items: DataFrame, key: str = "dst") -> DataFrame:
    """Per-field fallback: graph metadata first, then the item itself."""
    fields = ["title", "category", "author", "theme", "mood", "summary"]
    m = meta.select(F.col("item_id").alias(key), *[F.col(f).alias(f"_m_{f}") for f in fields], F.col("page").alias("_m_page"), "tags", "is_marker")
    source = {"title": F.coalesce(F.nullif(X.strip("display"), F.lit("")), F.substring("translit", 1, 80))}
    i = items.select(
        F.col("item_id").alias(key),
        *[source.get(f, F.col(f)).alias(f"_i_{f}") for f in fields],
        F.col("page").alias("_i_page"),
    )
    joined = df.join(m, key, "left").join(i, key, "left")
    for f in fields:
        present = [F.nullif(X.strip(F.col(f"_{s}_{f}")), F.lit("")) for s in ("m", "i")]
        joined = joined.withColumn(f, F.coalesce(*present, F.lit("")))
    page = F.coalesce(F.nullif("_m_page", F.lit(0)), F.col("_i_page"), F.lit(0))
    return joined.withColumn("page", page).withColumn(
        "tags", F.coalesce("tags", _no_tags())
    ).drop(*[f"_{s}_{f}" for s in ("m", "i") for f in [*fields, "page"]])
