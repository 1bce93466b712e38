"""Suggestions for tables of seed sets and occasions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.functions import text as X
from tagweave.operators.vectors import knn, matching
from tagweave.scale import attach_to_key, staged, top_per

# Result sizes.
MAX_RESULTS = 10
VECTOR_FETCH = 20
THEME_TAGS = 5
OCCASION_COUNT = 10

#: Seeds of a request whose neighbours one task may merge.
PART_SEEDS = 4096
#: Seeds whose neighbours a task merges.
TASK_SEEDS = 1 << 14
#: Neighbours of a seed that give a bound for all others.
FIRST_LOOK = 3


def _lists(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct seeds (req_id, src, parts), and of each seed its neighbours, best first, as one row, staged.

    Every seed has a bounded number of edges. Sets of tags are listed once each; ``place`` is that of an edge's.
    """
    seed = staged(seeds.select("req_id", F.col("item_id").alias("src")).filter("src is not null").distinct(), "seeds")
    lists = (
        edges.join(seed.select("src").distinct(), "src", "left_semi")
        .groupBy("src")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("lack"), "dst", "score", "shared_tags"))).alias("n"))
        .withColumn("sets", F.array_distinct(F.transform("n", lambda e: e["shared_tags"])))
    )
    place = F.transform("n", lambda e: F.struct(
        e["dst"].alias("dst"), e["score"].alias("score"),
        F.array_position("sets", e["shared_tags"]).cast("int").alias("place"),
    ))
    many = seed.groupBy("req_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART_SEEDS)).cast("int").alias("parts")).filter("parts > 1")
    dealt = attach_to_key(seed, many, ["req_id"], "src", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return staged(dealt, "dealt"), staged(lists.select("src", place.alias("n"), "sets"), "neighbours")


def _merged(seed: DataFrame, lists: DataFrame, without_seeds: bool, kept: str = "n") -> DataFrame:
    """(req_id, dst, score, shared_tags) of requests whose seeds have these neighbours.

    A seed's neighbours travel to the request as one row and are laid out by request and part there; a request of
    many seeds has several parts, each for some of the neighbours. ``kept`` has those that are merged at
    all. Lists without sets of tags give none.
    """
    # A request's seed is a neighbour at place 0; without a request nothing is left out.
    dst = lists.schema["n"].dataType.elementType["dst"].dataType.simpleString()
    itself = f"struct(cast(src as {dst}) as dst, cast(null as double) as score, 0 as place)"
    itself = f"filter(array({itself}), e -> {'req_id is not null' if without_seeds else 'false'})"
    joined = seed.join(lists, "src", "left").withColumn("n", F.expr(kept)).withColumn("n", F.expr(f"concat(coalesce(n, filter({itself}, e -> false)), {itself})"))
    parted = joined.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "n", F.expr("if(parts = 1, n, filter(n, e -> pmod(xxhash64(e.dst), parts) = part))")
    )
    # A fixed number of tasks: rows that hold many neighbours look few, and merging them sorts them in memory.
    n_tasks = max(int(seed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seed.count() // TASK_SEEDS))
    sets = ["sets"] if "sets" in lists.columns else []
    rows = parted.select("req_id", "part", "n", *sets).repartition(n_tasks, "req_id", "part")
    each = rows.select("req_id", "part", *sets, F.inline("n")).select(
        "req_id", "part", "dst", "score", (F.coalesce("place", F.lit(1)) == 0).alias("seed"),
        *[F.get(c, F.nullif("place", F.lit(0)) - 1).alias("tags") for c in sets],
    )
    merged = each.groupBy("req_id", "part", "dst").agg(
        F.max("score").alias("score"), F.bool_or("seed").alias("seed"),
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("shared_tags") for _ in sets],
    )
    return merged.filter("not seed").drop("part", "seed")


def merge_seeds(edges: DataFrame, seeds: DataFrame, without_seeds: bool = False) -> DataFrame:
    """Neighbours of all seeds of a request: best score, union of shared tags.

    ``seeds``: req_id, item_id. A request's seeds are left out while merging if asked for, which spares the
    join of ``exclude``.
    """
    return _merged(*_lists(edges, seeds), without_seeds)


def top_from_seeds(edges: DataFrame, seeds: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """Best neighbours of each seed set, seeds left out, with display score and explanation.

    The best few neighbours of every seed give a score that ``n`` answers of a request reach. Neighbours that reach
    it are ranked on scores alone, and tags are collected for the winners only. Requests without an id have no answers.
    """
    seed, lists = _lists(edges, seeds.filter("req_id is not null"))
    bare, order = lists.select("src", "n"), [F.desc("score"), F.asc("dst")]
    few = _merged(seed, bare.withColumn("n", F.slice("n", 1, FIRST_LOOK)), True)
    least = top_per(few, ["req_id"], order, n).groupBy("req_id").agg(F.when(F.count("score") >= n, F.min("score")).alias("least"))
    asked = seed.join(staged(least, "least"), "req_id", "left")
    best = top_per(_merged(asked, bare, True, "if(least is null, n, filter(n, e -> e.score >= least))"), ["req_id"], order, n)
    wins = staged(best.groupBy("req_id").agg(F.collect_list("dst").alias("wins")), "wins")
    asked = seed.join(wins, "req_id")
    return top_suggestions(_merged(asked, lists, True, "filter(n, e -> array_contains(wins, e.dst))"), n)


def answering(
    edges: DataFrame, source: str, library: DataFrame, meta: DataFrame, category: str | None = None
) -> DataFrame:
    """Edges to items that ``filter_source`` keeps: others need not be merged."""
    own = edges.select("dst").distinct()
    kept = filter_source(own, source, library, meta, category).select("dst")
    return edges if source != "library" and category is None else edges.join(kept, "dst", "left_semi")


def exclude(cands: DataFrame, listed: DataFrame, item: str = "dst") -> DataFrame:
    """Drop candidates listed as (req_id, item_id), or as item_id alone for every request."""
    on = [c for c in ("req_id",) if c in listed.columns]
    renamed = listed.select(*on, F.col("item_id").alias(item)).distinct()
    return cands.join(renamed, [*on, item], "left_anti")


def filter_source(
    cands: DataFrame, source: str, library: DataFrame, meta: DataFrame, category: str | None = None
) -> DataFrame:
    """Keep candidates of a source and add ``rec_id``, the library id of the answer.

    ``library`` answers only with items that a library record is linked to (the last record of an
    item); ``corpus`` and ``all`` keep every item. The category condition applies to every source.
    """
    if source not in ("library", "corpus", "all"):
        raise ValueError(f"unknown source: {source}")
    if category is not None:
        wanted = meta.filter(F.col("category") == category).select(F.col("item_id").alias("dst"))
        cands = cands.join(wanted, "dst", "left_semi")
    if source != "library":
        return cands.withColumn("rec_id", F.lit(None).cast("bigint"))
    linked = library.filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("dst")).agg(
        F.max("rec_id").alias("rec_id")
    )
    return cands.join(linked, "dst")


def top_suggestions(cands: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """Best candidates per request with display score and explanation."""
    return _described(top_per(cands, ["req_id"], [F.desc("score"), F.asc("dst")], n))


def _described(best: DataFrame) -> DataFrame:
    return best.withColumn(
        "connection_score", S.graph_connection_score(F.col("score"), F.col("shared_tags"))
    ).withColumn("explanation", S.connection_text(F.col("shared_tags")))


def theme_summary(suggestions: DataFrame, n: int = THEME_TAGS) -> DataFrame:
    """Most shared tags over the suggestions of a request, as one text."""
    counts = (
        suggestions.select("req_id", F.explode(F.array_distinct("shared_tags")).alias("tag"))
        .groupBy("req_id", "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = top_per(counts, ["req_id"], [F.desc("n"), F.asc("tag")], n)
    tags = F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda s: s["tag"])
    return top.groupBy("req_id").agg(F.concat(F.lit("Themes: "), F.array_join(tags, ", ")).alias("summary"))


def query_text(seeds: DataFrame) -> DataFrame:
    """Semantic query text per request.

    ``seeds``: req_id, pos, seed_line, theme, secondary_themes, mood, summary, translation. Selected
    lines come first, then each seed's themes, mood and summary; translations only if nothing else.
    """
    empty = F.expr("cast(array() as array<string>)")
    def present(c: Column) -> Column:
        return X.blank_to_null(c)

    own = F.filter(
        F.concat(
            F.array(present(F.col("theme"))), F.coalesce("secondary_themes", empty),
            F.array(present(F.col("mood")), present(F.col("summary"))),
        ),
        lambda t: t.isNotNull(),
    )
    def collected(c: Column) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct("pos", c.alias("t"))))
        return F.flatten(F.transform(pairs, lambda s: s["t"]))

    def single(c: Column) -> Column:
        return F.filter(F.array(present(c)), lambda t: t.isNotNull())

    parts = seeds.groupBy("req_id").agg(
        F.concat(collected(single(F.col("seed_line"))), collected(own)).alias("parts"),
        collected(single(F.substring("translation", 1, 300))).alias("fallback"),
    )
    chosen = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.col("fallback"))
    return parts.select("req_id", F.array_join(chosen, " | ").alias("query_text"))


def rank_vector(cands: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """Nearest candidates per request with their display score."""
    order = [F.asc(F.coalesce("distance", F.lit(1.0))), F.asc("source"), F.asc("item_id")]
    best = top_per(cands, ["req_id"], order, n)
    return best.withColumn("connection_score", S.vector_connection_score(F.col("distance")))


def vector_suggestions(
    queries: DataFrame,
    corpus: DataFrame,
    library: DataFrame,
    seeds: DataFrame,
    source: str = "all",
    n: int = MAX_RESULTS,
    category: str | None = None,
    contributor: str | None = None,
    confidence: str | None = None,
) -> DataFrame:
    """Vector answers for requests (req_id, vec) from the library, the corpus or both.

    ``library``: rec_id, item_id, vec. With both sources the corpus side leaves out items that a
    library record is linked to, before ranking. Seeds (req_id, item_id) never answer. The category
    holds for both sides, contributor and confidence for library records; a side must carry the
    columns asked for. Each side is searched for ``n`` answers, 20 at least.
    """
    fetch = max(n, VECTOR_FETCH)
    asked = {"category": category, "contributor": contributor, "confidence": confidence}
    own_conditions = {k: v for k, v in asked.items() if v is not None}
    q = queries.select(F.col("req_id").alias("query_id"), "vec")
    seed = seeds.select(F.col("req_id").alias("query_id"), "item_id")
    parts = []
    if source in ("library", "all"):
        records = matching(library, own_conditions).select(F.col("rec_id").alias("item_id"), "vec")
        own = seed.join(library.select("rec_id", "item_id"), "item_id").select(
            "query_id", F.col("rec_id").alias("item_id")
        )
        parts.append(knn(q, records, fetch, exclude=own).withColumn("source", F.lit("library")))
    if source in ("corpus", "all"):
        rows = corpus if category is None else matching(corpus, {"category": category})
        if source == "all":
            rows = rows.join(library.select("item_id").distinct(), "item_id", "left_anti")
        parts.append(knn(q, rows, fetch, exclude=seed).withColumn("source", F.lit("corpus")))
    cands = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rank_vector(cands.withColumnRenamed("query_id", "req_id").drop("rank"), n)


def seed_suggestions(
    seeds: DataFrame,
    edges: DataFrame,
    library: DataFrame,
    meta: DataFrame,
    query_vectors: DataFrame,
    corpus: DataFrame,
    source: str = "all",
    category: str | None = None,
    n: int = MAX_RESULTS,
) -> DataFrame:
    """Suggestions per request: from the graph, or by vector for requests the graph leaves empty.

    The category holds for either way; with one, ``corpus`` and ``library`` carry a category column.
    """
    cands = merge_seeds(answering(edges, source, library, meta, category), seeds, without_seeds=True)
    graph = top_suggestions(filter_source(cands, source, library, meta, category), n).select(
        "req_id", F.col("dst").alias("item_id"), "rank", "connection_score", "explanation",
        F.lit("graph").alias("method"),
    )
    unanswered = query_vectors.join(graph.select("req_id").distinct(), "req_id", "left_anti")
    vector = vector_suggestions(unanswered, corpus, library, seeds, source, n, category).select(
        "req_id", "item_id", "rank", "connection_score", F.lit("").alias("explanation"),
        F.lit("vector").alias("method"),
    )
    return graph.unionByName(vector)


def occasion_suggestions(
    occasions: DataFrame, library: DataFrame, n: int = OCCASION_COUNT, where: list[str] | None = None
) -> DataFrame:
    """Nearest library records per occasion (query_id, vec) with their relevance."""
    found = knn(occasions, library, n, where or ())
    return found.withColumn("relevance", S.relevance(F.col("distance")))


