"""Graph, cluster, vector and suggestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.functions import text as X
from tagweave.operators import clusters, graph, suggest, vectors
from tagweave.plans import bindings as B
from tagweave.plans.bindings import sql
from tagweave.plans.registry import query
from tagweave.scale import durable, staged, staged_path
from tagweave.sources import tables

R6 = "round({}, 6)"
#: Best candidate scores below this make a cluster weak.
WEAK_BELOW = 0.75


def _join(c: str) -> str:
    return f"array_to_string({c}, ',')"


@query(sql("edges", "SELECT src, dst, score, array_to_string(shared_tags, ',') AS shared_tags, rank FROM edges"))
def similarity_graph(spark, sf):
    """Tag-balanced neighbour graph over all tagged items."""
    return B.edge_rows(spark, sf)


@query(sql("it", "ts", "SELECT tag, item_id, n FROM it JOIN ts USING (tag)"))
def tag_index(spark, sf):
    return graph.tag_index(graph.item_tags(B.tagged_items(spark, sf)))


@query(sql("edges", "nt", """SELECT src, dst, score, n AS n_shared, round(n / (a.nt + b.nt - n)::DOUBLE, 6) AS jaccard,
    round(CASE WHEN a.norm * b.norm > 0 THEN list_dot_product(a.vec, b.vec) / (a.norm * b.norm) ELSE 0 END, 6) AS cos
    FROM (SELECT src, dst, score, len(shared_tags) AS n FROM edges) JOIN nt a ON a.item_id = src JOIN nt b ON b.item_id = dst"""))
def edge_similarities(spark, sf):
    """Jaccard and cosine of every edge, recomputed from tags and vectors."""
    items = B.tagged_items(spark, sf)
    edges = graph.with_vectors(graph.similarity_graph(items), items.select("item_id", "vec"))
    tags = items.select("item_id", "tags")
    joined = edges.join(tags.toDF("src", "_a"), "src").join(tags.toDF("dst", "_b"), "dst")
    jac = S.jaccard(F.col("_a"), F.col("_b"))
    return joined.select(
        "src", "dst", "score", F.size("shared_tags").alias("n_shared"), F.round(jac, 6).alias("jaccard"), F.round("cos", 6).alias("cos")
    )


@query(sql("pooled", "SELECT src, tag, core, dst, score, pool_rank FROM pooled"))
def candidate_pools(spark, sf):
    """Core and branch pools per (item, tag)."""
    return graph.candidate_pools(B.tagged_items(spark, sf)).drop("n_tags")


@query(sql("slotted", "SELECT src, tag, core, dst, score, slot FROM slotted"))
def slot_allocation(spark, sf):
    pooled = graph.candidate_pools(B.tagged_items(spark, sf))
    return graph.allocate_slots(pooled).drop("pool_rank", "n_tags")


@query(sql("f1", "ts", "pooled", "edges", """+ vts AS (SELECT tag, count(*) AS n, count(vec) AS v FROM it JOIN f1 USING (item_id) GROUP BY 1)
    SELECT 'items' AS metric, count(*)::DOUBLE AS value FROM f1 WHERE len(tags) > 0
    UNION ALL SELECT 'markers', count(*)::DOUBLE FROM f1 WHERE list_contains(tags, 'Repertoire')
    UNION ALL SELECT 'tags', count(*)::DOUBLE FROM ts
    UNION ALL SELECT 'items_per_tag', round(avg(n), 1) FROM ts
    UNION ALL SELECT 'vector_hits', sum(v * (v - 1))::DOUBLE FROM vts
    UNION ALL SELECT 'vector_misses', sum(n * (n - 1) - v * (v - 1))::DOUBLE FROM vts
    UNION ALL SELECT 'mean_degree', round((SELECT count(*) FROM edges) / (SELECT count(*) FROM f1 WHERE len(tags) > 0)::DOUBLE, 1)
    UNION ALL SELECT 'empty_clusters', count(*)::DOUBLE FROM it WHERE (item_id, tag) NOT IN (SELECT (src, tag) FROM pooled)"""))
def graph_stats(spark, sf):
    items = B.tagged_items(spark, sf)
    found = graph.candidates(items)
    found.pooled = staged(found.pooled, "pools")
    return graph.graph_stats(items, found.edges(), pooled=found.pools())


@query(sql("it", "pooled", "SELECT item_id AS src, tag FROM it WHERE (item_id, tag) NOT IN (SELECT (src, tag) FROM pooled)"))
def empty_clusters(spark, sf):
    items = B.tagged_items(spark, sf)
    return graph.empty_clusters(items, graph.candidate_pools(items))


@query(sql("it", "pooled", f"""SELECT item_id AS src, tag FROM it
    WHERE (item_id, tag) NOT IN (SELECT (src, tag) FROM pooled WHERE score >= {WEAK_BELOW})"""))
def weak_clusters(spark, sf):
    """(item, tag) pairs whose best candidate scores below a bound."""
    items = B.tagged_items(spark, sf)
    return graph.empty_clusters(items, graph.candidate_pools(items), least=WEAK_BELOW)


@query(sql("edges", "nt", """+ x AS (SELECT src, list_filter(b.tags, lambda t: NOT list_contains(a.tags, t)) AS fresh, len(shared_tags) = a.nt AS red
      FROM edges JOIN nt a ON a.item_id = src JOIN nt b ON b.item_id = dst),
    y AS (SELECT src, len(list_distinct(flatten(list(fresh)))) AS d, count(*) FILTER (WHERE red) AS r, count(*) AS n FROM x GROUP BY 1)
    SELECT 'directions' AS metric, round(avg(d), 4) AS value FROM y UNION ALL SELECT 'redundant', round(avg(r), 4) FROM y
    UNION ALL SELECT 'neighbours', round(avg(n), 4) FROM y"""))
def diversity_metrics(spark, sf):
    items = B.tagged_items(spark, sf)
    return graph.diversity_metrics(graph.similarity_graph(items), items)


@query(sql("f1", "SELECT item_id, display AS title, category, author, page, array_to_string(tags, ',') AS tags, false AS is_marker, theme, mood, summary FROM f1"))
def item_meta(spark, sf):
    return graph.item_meta(B.tagged_items(spark, sf))


@query(sql("edges", "f1", """+ g AS (SELECT category, count(*) AS n FROM f1 GROUP BY 1)
    SELECT 'edges' AS part, count(*) AS n FROM edges UNION ALL SELECT 'tag_index', count(*) FROM it
    UNION ALL SELECT 'item_meta', count(*) FROM f1 UNION ALL SELECT 'graph_stats', 8"""))
def saved_graph(spark, sf):
    """Write all graph tables to the shared folder, read them back and count them."""
    path = staged_path(spark, "graph")
    tables.write_graph(graph.build_bundle(B.tagged_items(spark, sf)), path)
    saved = tables.read_graph(spark, path)
    parts = {"edges": saved.edges, "tag_index": saved.index, "item_meta": saved.meta, "graph_stats": saved.stats}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("f1", """SELECT a.item_id, b.item_id AS other, array_to_string(list_sort(list_intersect(a.tags, b.tags)), ',') AS shared,
    array_to_string(list_sort(list_filter(b.tags, lambda t: NOT list_contains(a.tags, t))), ',') AS fresh,
    array_to_string(list_sort(list_distinct(list_concat(a.tags, b.tags))), ',') AS combined
    FROM f1 a JOIN f1 b ON b.item_id = a.item_id + 1"""))
def tag_set_columns(spark, sf):
    """Shared, new and combined tags of each item and the next one."""
    f1 = B.tagged_items(spark, sf).select("item_id", "tags")
    nxt = f1.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("tags").alias("theirs"))
    mine, theirs = F.col("tags"), F.col("theirs")
    return f1.join(nxt, "item_id").select(
        "item_id", "other", X.shared_tags(mine, theirs).alias("shared"),
        X.new_tags(mine, theirs).alias("fresh"), X.combined_tags(mine, theirs).alias("combined"),
    )


# ---- neighbour clusters ----------------------------------------------------------------------

CLUSTER_SQL = """
  req AS (SELECT item_id AS req_id, item_id AS src, {threshold} AS threshold, {per_tag} AS per_tag, {boost} AS boost, tags AS src_tags, vec FROM f1),
  gh AS (SELECT r.*, e.dst, e.score AS base_score, e.shared_tags,
      CASE WHEN boost AND f.flagged THEN least(1.0, e.score * 1.3) ELSE e.score END AS score, false AS from_vector
    FROM req r JOIN edges e ON e.src = r.src LEFT JOIN flags f ON f.item_id = e.dst),
  {vector}
  blended AS (SELECT req_id, src, dst, src_tags, per_tag, shared_tags, score, from_vector FROM gh WHERE score >= threshold
      AND (req_id, dst) NOT IN (SELECT (req_id, dst) FROM vh)
    UNION ALL SELECT req_id, src, dst, src_tags, per_tag, shared_tags, score, from_vector FROM vh),
  tagged AS (SELECT b.*, CASE WHEN from_vector AND len(f.tags) = 0 THEN [f.theme] ELSE f.tags END AS dst_tags FROM blended b JOIN f1 f ON f.item_id = b.dst),
  freshened AS (SELECT *, list_filter(dst_tags, lambda t: NOT list_contains(src_tags, t)) AS fresh,
      list_filter(dst_tags, lambda t: list_contains(src_tags, t)) AS matching FROM tagged),
  rare AS (SELECT req_id, dst, arg_min(tag, lpad(coalesce(n, 0)::VARCHAR, 12, '0') || tag) AS rarest
    FROM (SELECT req_id, dst, unnest(fresh) AS tag FROM freshened) LEFT JOIN ts USING (tag) GROUP BY 1, 2),
  assigned AS (SELECT req_id, src, dst, score, per_tag, from_vector, src_tags, unnest(CASE
      WHEN from_vector AND len(matching) > 0 THEN matching[1:1]
      WHEN NOT from_vector AND (len(shared_tags) = len(src_tags) OR len(fresh) = 0) THEN shared_tags
      ELSE [rarest] END) AS cluster FROM freshened LEFT JOIN rare USING (req_id, dst)),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id, cluster ORDER BY score DESC, dst) AS rk FROM assigned) WHERE rk <= per_tag),
  stats AS (SELECT req_id, cluster, count(*) AS n, round(avg(score), 9) AS mean, bool_or(list_contains(src_tags, cluster)) AS core FROM capped GROUP BY 1, 2),
  best_core AS (SELECT req_id, cluster AS target FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY mean DESC, cluster) AS o FROM stats WHERE core) WHERE o = 1),
  best_size AS (SELECT req_id, cluster AS target FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY n DESC, cluster) AS o FROM stats WHERE core OR n >= 2) WHERE o = 1),
  moved AS (SELECT c.req_id, c.src, c.dst, c.score, c.per_tag, c.from_vector,
      CASE WHEN NOT s.core AND s.n < 2 THEN coalesce(bc.target, bs.target, c.cluster) ELSE c.cluster END AS cluster
    FROM capped c JOIN stats s USING (req_id, cluster) LEFT JOIN best_core bc USING (req_id) LEFT JOIN best_size bs USING (req_id)),
  clustered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id, cluster ORDER BY score DESC, dst) AS rank FROM moved) WHERE rank <= per_tag)
"""
NO_VECTOR = "vh AS (SELECT req_id, src, dst, src_tags, per_tag, shared_tags, score, base_score, from_vector FROM gh WHERE false),"
WITH_VECTOR = """
  vd AS (SELECT a.req_id, b.item_id AS dst, round(1.0 - list_dot_product(a.vec, b.vec) / (an.norm * bn.norm), 6) AS distance
    FROM req a JOIN nt0 an ON an.item_id = a.req_id, f1 b JOIN nt0 bn ON bn.item_id = b.item_id
    WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL AND a.req_id <> b.item_id),
  vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY distance, dst) AS o FROM vd) WHERE o <= 30),
  vh AS (SELECT r.req_id, r.src, k.dst, r.src_tags, r.per_tag, CAST([] AS VARCHAR[]) AS shared_tags, round(s, 9) AS score, round(s, 9) AS base_score, true AS from_vector
    FROM (SELECT k.*, CASE WHEN r.boost AND f.flagged THEN least(1.0, 1.3 * greatest(0.0, least(1.0, 1 - k.distance))) ELSE greatest(0.0, least(1.0, 1 - k.distance)) END AS s
      FROM vk k JOIN req r USING (req_id) LEFT JOIN flags f ON f.item_id = k.dst) k JOIN req r USING (req_id) WHERE s >= r.threshold),"""
NT0 = "nt0 AS (SELECT item_id, sqrt(list_dot_product(vec, vec)) AS norm FROM f1),"


def _cluster_sql(body: str, threshold="0.3::DOUBLE", per_tag=8, boost="false", vector=NO_VECTOR) -> str:
    ctes = CLUSTER_SQL.format(threshold=threshold, per_tag=per_tag, boost=boost, vector=vector)
    return sql("f1", "ts", "edges", "flags", f"+{NT0}{ctes} {body}")


CLUSTERED = "SELECT req_id, src, cluster, dst, round(score, 9) AS score, from_vector, rank FROM clustered"


def _requests(spark, sf, threshold=clusters.DEFAULT_THRESHOLD, per_tag=clusters.DEFAULT_PER_TAG, boost=False):
    return B.tagged_items(spark, sf).select(
        F.col("item_id").alias("req_id"), F.col("item_id").alias("src"), F.lit(threshold).alias("threshold"),
        F.lit(per_tag).alias("per_tag"), F.lit(boost).alias("boost"),
    )


def _clustered(spark, sf, vector=False, **request):
    items = B.tagged_items(spark, sf)
    edges = graph.similarity_graph(items)
    sizes = graph.tag_sizes(graph.item_tags(items))
    found = _own_vector_hits(items) if vector else None
    out = clusters.neighbor_clusters(
        _requests(spark, sf, **request), edges, graph.item_meta(items), sizes, B.item_flags(spark, sf), found
    )
    return out.withColumn("score", F.round("score", 9))


def _own_vector_hits(items):
    """Nearest items of every item's own vector, itself left out."""
    q = items.select(F.col("item_id").alias("query_id"), "vec")
    own = q.select("query_id", F.col("query_id").alias("item_id"))
    found = vectors.knn(q, items.select("item_id", "vec"), clusters.VECTOR_HITS, exclude=own)
    return found.select(F.col("query_id").alias("req_id"), F.col("item_id").alias("dst"), "distance")


@query(_cluster_sql(CLUSTERED))
def neighbor_clusters(spark, sf):
    """Clusters of every item's neighbours at the default threshold."""
    return _clustered(spark, sf)


@query(_cluster_sql(CLUSTERED, "0.5::DOUBLE", 3, "true"))
def boosted_clusters(spark, sf):
    """Clusters with flagged items lifted and a tighter cap."""
    return _clustered(spark, sf, threshold=0.5, per_tag=3, boost=True)


@query(_cluster_sql(CLUSTERED, "0.2::DOUBLE", 6, "true", WITH_VECTOR))
def blended_clusters(spark, sf):
    """Vector hits of every item blended with its graph neighbours."""
    return _clustered(spark, sf, vector=True, threshold=0.2, per_tag=6, boost=True)


@query(_cluster_sql("SELECT req_id, count(*) AS total_shown, count(DISTINCT dst) AS distinct_shown FROM clustered GROUP BY 1"))
def shown_totals(spark, sf):
    return clusters.shown_totals(_clustered(spark, sf))


@query(_cluster_sql("""SELECT req_id, dst, cluster, title, theme, page, tags, is_marker FROM clustered
    JOIN (SELECT item_id AS dst, display AS title, theme, page, array_to_string(tags, ',') AS tags, false AS is_marker FROM f1) USING (dst)"""))
def clusters_with_meta(spark, sf):
    """Cluster rows with metadata, each field falling back from the graph to the item."""
    items = B.tagged_items(spark, sf)
    full = clusters.with_meta(_clustered(spark, sf), graph.item_meta(items), items)
    return full.select("req_id", "dst", "cluster", "title", "theme", "page", "tags", "is_marker")


@query(_cluster_sql("""SELECT req_id, min(base_score) AS score_min, max(base_score) AS score_max,
    list_sort(list(base_score))[count(*) // 2 + 1] AS score_median, count(*) AS total_available
    FROM (SELECT req_id, base_score FROM gh UNION ALL SELECT req_id, base_score FROM vh) GROUP BY 1""", "0.2::DOUBLE", 6, "true", WITH_VECTOR))
def score_range(spark, sf):
    """Score range over raw graph scores and kept vector hits."""
    items = B.tagged_items(spark, sf)
    requests = _requests(spark, sf, threshold=0.2, per_tag=6, boost=True)
    flags = B.item_flags(spark, sf)
    hits = clusters.graph_hits(requests, graph.similarity_graph(items), flags)
    return clusters.score_range(hits, clusters.vector_hits(requests, _own_vector_hits(items), flags))


# ---- vector search and suggestions -----------------------------------------------------------

UNIT = """u AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS vec, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)"""


def _embeddings(spark, sf):
    return B.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label"
    )


NEAREST = f"""WITH {UNIT}, d AS (SELECT a.item_id AS query_id, b.item_id, round(1.0 - list_dot_product(a.vec, b.vec) / (a.norm * b.norm), 6) AS distance
      FROM u a JOIN u b ON a.item_id <> b.item_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d) WHERE rank <= 10"""


@query(NEAREST)
def vector_knn_regions(spark, sf):
    """The same answers region by region, with regions as small as these tables need to have several."""
    e = _embeddings(spark, sf)
    q = e.select(F.col("item_id").alias("query_id"), "vec")
    return vectors.knn(q, e, 10, exclude=q.select("query_id", F.col("query_id").alias("item_id")), region_rows=50)


@query(NEAREST)
def vector_knn(spark, sf):
    """Ten nearest vectors of every vector, itself left out."""
    e = _embeddings(spark, sf)
    q = e.select(F.col("item_id").alias("query_id"), "vec")
    return vectors.knn(q, e, 10, exclude=q.select("query_id", F.col("query_id").alias("item_id")))


@query(f"""WITH {UNIT}, d AS (SELECT a.item_id AS query_id, b.item_id, a.label, round(1.0 - list_dot_product(a.vec, b.vec) / (a.norm * b.norm), 6) + 0.0 AS distance
      FROM u a JOIN u b ON a.label = b.label)
    SELECT query_id, item_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d) WHERE rank <= 5""")
def vector_knn_where(spark, sf):
    """Five nearest vectors with the same label; the predicate groups the work."""
    e = _embeddings(spark, sf)
    return vectors.knn(e.withColumnRenamed("item_id", "query_id"), e, 5, where=["label"])


@query("SELECT vec_id AS item_id, label::BIGINT AS label FROM embeddings WHERE label = 3")
def vectors_matching(spark, sf):
    """Equality predicate, pushed into the scan."""
    return vectors.matching(_embeddings(spark, sf), {"label": 3}).select("item_id", "label")


OCC = f"""WITH {UNIT}, flat AS (SELECT label, i, avg(vec[i]) AS x FROM (SELECT label, vec, unnest(range(1, len(vec) + 1)) AS i FROM u) GROUP BY 1, 2),
    c AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS vec FROM flat GROUP BY 1),
    d AS (SELECT query_id, item_id, round(1.0 - list_dot_product(c.vec, u.vec) / (sqrt(list_dot_product(c.vec, c.vec)) * norm), 6) AS distance FROM c, u)
    SELECT query_id, item_id, distance, rank, round((1 - distance) * 10, 1) AS relevance
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d) WHERE rank <= 10"""


@query(OCC)
def occasion_suggestions(spark, sf):
    """Ten nearest records per occasion; an occasion is the mean vector of a label."""
    e = _embeddings(spark, sf)
    occasions = vectors.centroid(e, "label").withColumnRenamed("label", "query_id")
    return suggest.occasion_suggestions(occasions, e)


SEEDS = "seeds AS (SELECT o_custkey AS req_id, o_orderkey % (SELECT max(vec_id) + 1 FROM embeddings) AS item_id FROM orders GROUP BY 1, 2)"


def _seeds(spark, sf):
    """Orders of a customer as a seed set over the vector ids."""
    o = B.table(spark, sf, "orders")
    n = B.table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).scalar()
    return o.select(F.col("o_custkey").alias("req_id"), (F.col("o_orderkey") % n).alias("item_id")).distinct()


MERGED_SQL = SEEDS + """, sm AS (SELECT req_id, dst, max(score) AS score, list_sort(list_distinct(flatten(list(shared_tags)))) AS shared_tags
      FROM edges JOIN seeds ON seeds.item_id = edges.src GROUP BY 1, 2),
    cand AS (SELECT * FROM sm WHERE (req_id, dst) NOT IN (SELECT (req_id, item_id) FROM seeds))"""
TOP_SQL = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, dst) AS rank FROM {source}) WHERE rank <= 10),
    shown AS (SELECT *, round(greatest(1.0, least(10.0, score * 9 + least(len(shared_tags) * 0.3::DOUBLE, 1.0))), 1) AS connection_score,
      'Connected through: ' || array_to_string(shared_tags[1:4], ', ') AS explanation FROM best)"""


@query(sql("edges", "+" + MERGED_SQL + " SELECT req_id, dst, score, array_to_string(shared_tags, ',') AS shared_tags FROM cand"))
def merged_seed_neighbours(spark, sf):
    seeds = _seeds(spark, sf)
    return suggest.merge_seeds(B.edge_rows(spark, sf), seeds, without_seeds=True)


@query(sql("edges", "+" + MERGED_SQL + "," + TOP_SQL.format(source="cand") + " SELECT req_id, dst, score, rank, connection_score, explanation FROM shown"))
def seed_suggestions(spark, sf):
    """Ten best neighbours per seed set with display score and explanation."""
    return suggest.top_from_seeds(B.edge_rows(spark, sf), _seeds(spark, sf)).drop("shared_tags")


LIB_SQL = """linked AS (SELECT item_id AS dst, max(rec_id) AS rec_id FROM lib WHERE item_id IS NOT NULL GROUP BY 1),
    src AS (SELECT cand.*, rec_id FROM cand JOIN linked USING (dst) WHERE dst IN (SELECT item_id FROM f1 WHERE category = 'Brand#1'))"""


@query(sql("edges", "f1", "lib", "+" + MERGED_SQL + "," + LIB_SQL + "," + TOP_SQL.format(source="src") + " SELECT req_id, dst, rec_id, rank, connection_score FROM shown"))
def library_suggestions(spark, sf):
    """Suggestions restricted to items of one category that the library holds."""
    seeds, items = _seeds(spark, sf), B.tagged_items(spark, sf)
    source = "library", B.library(spark, sf), items, "Brand#1"
    edges = suggest.answering(B.edge_rows(spark, sf), *source)
    own = suggest.filter_source(suggest.merge_seeds(edges, seeds, without_seeds=True), *source)
    return suggest.top_suggestions(own).select("req_id", "dst", "rec_id", "rank", "connection_score")


@query(sql("edges", "+" + MERGED_SQL + "," + TOP_SQL.format(source="cand") + """,
    tc AS (SELECT req_id, tag, count(*) AS n FROM (SELECT req_id, unnest(shared_tags) AS tag FROM shown) GROUP BY 1, 2),
    tr AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY n DESC, tag) AS o FROM tc)
    SELECT req_id, 'Themes: ' || array_to_string(list(tag ORDER BY o), ', ') AS summary FROM tr WHERE o <= 5 GROUP BY 1"""))
def theme_summary(spark, sf):
    return suggest.theme_summary(suggest.top_from_seeds(B.edge_rows(spark, sf), _seeds(spark, sf)))


VEC_SQL = f"""WITH {UNIT}, rq AS (SELECT item_id AS req_id, vec, norm, item_id AS seed FROM u),
    recs AS (SELECT item_id + 1000000 AS rec_id, item_id, vec, norm FROM u WHERE label < 3),
    ld AS (SELECT req_id, rec_id AS item_id, round(1.0 - list_dot_product(rq.vec, recs.vec) / (rq.norm * recs.norm), 6) AS distance FROM rq JOIN recs ON recs.item_id <> seed),
    cd AS (SELECT req_id, u.item_id, round(1.0 - list_dot_product(rq.vec, u.vec) / (rq.norm * u.norm), 6) AS distance FROM rq JOIN u ON u.item_id <> seed WHERE u.label >= 3),
    al AS (SELECT * FROM (SELECT *, 'library' AS source, row_number() OVER (PARTITION BY req_id ORDER BY distance, item_id) AS o FROM ld) WHERE o <= 20
      UNION ALL SELECT * FROM (SELECT *, 'corpus' AS source, row_number() OVER (PARTITION BY req_id ORDER BY distance, item_id) AS o FROM cd) WHERE o <= 20)
    SELECT req_id, item_id, source, distance, rank, round(greatest(1.0, least(10.0, (1 - distance) * 10)), 1) AS connection_score
    FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY distance, source, item_id) AS rank FROM al) WHERE rank <= 10"""


@query(VEC_SQL)
def vector_suggestions(spark, sf):
    """Vector answers from library and corpus in one ranked list; every vector asks."""
    e = _embeddings(spark, sf)
    queries = e.select(F.col("item_id").alias("req_id"), "vec")
    recs = e.filter(F.col("label") < 3).select((F.col("item_id") + 1000000).alias("rec_id"), "item_id", "vec")
    seeds = e.select(F.col("item_id").alias("req_id"), "item_id")
    out = suggest.vector_suggestions(queries, e.select("item_id", "vec"), recs, seeds)
    return out.select("req_id", "item_id", "source", "distance", "rank", "connection_score")


@query(VEC_SQL.replace("o <= 20", "o <= 25").replace("rank <= 10", "rank <= 25"))
def many_vector_suggestions(spark, sf):
    """More answers than a side is searched for by default."""
    e = _embeddings(spark, sf)
    queries = e.select(F.col("item_id").alias("req_id"), "vec")
    recs = e.filter(F.col("label") < 3).select((F.col("item_id") + 1000000).alias("rec_id"), "item_id", "vec")
    seeds = e.select(F.col("item_id").alias("req_id"), "item_id")
    out = suggest.vector_suggestions(queries, e.select("item_id", "vec"), recs, seeds, n=25)
    return out.select("req_id", "item_id", "source", "distance", "rank", "connection_score")


@query(f"""WITH {UNIT},
    d AS (SELECT a.item_id AS req_id, u.item_id, round(1.0 - list_dot_product(a.vec, u.vec) / (a.norm * u.norm), 6) AS distance
      FROM u a JOIN u ON u.item_id <> a.item_id WHERE u.label = 3),
    v AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY distance, item_id) AS rank FROM d)
    SELECT req_id, item_id, rank, round(greatest(1.0, least(10.0, (1 - distance) * 10)), 1) AS connection_score, 'vector' AS method FROM v WHERE rank <= 10""")
def category_fallback(spark, sf):
    """Requests of a category that no graph edge answers: the vector way stays within it."""
    e = _embeddings(spark, sf)
    corpus = e.select("item_id", "vec", F.col("label").cast("string").alias("category"))
    seeds = e.select(F.col("item_id").alias("req_id"), "item_id")
    edges = e.select(
        F.col("item_id").alias("src"), (F.col("item_id") + 1).alias("dst"), F.lit(0.5).alias("score"), F.array(F.lit("t")).alias("shared_tags")
    )
    meta = corpus.select("item_id", F.when(F.col("category") != "3", F.col("category")).alias("category"))
    asked = e.select(F.col("item_id").alias("req_id"), "vec")
    out = suggest.seed_suggestions(seeds, edges, B.library(spark, sf), meta, asked, corpus, "corpus", "3")
    return out.select("req_id", "item_id", "rank", "connection_score", "method")


@query(sql("edges", "f1", "+" + UNIT + """,
    seeds AS (SELECT item_id AS req_id, item_id FROM f1),
    cand AS (SELECT src AS req_id, dst, score, shared_tags FROM edges), """ + TOP_SQL.format(source="cand") + """,
    open AS (SELECT item_id AS req_id, vec, norm FROM u WHERE item_id IN (SELECT item_id FROM f1) AND item_id NOT IN (SELECT req_id FROM shown)),
    d AS (SELECT req_id, u.item_id, round(1.0 - list_dot_product(o.vec, u.vec) / (o.norm * u.norm), 6) AS distance FROM open o JOIN u ON u.item_id <> req_id),
    v AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY distance, item_id) AS rank FROM d)
    SELECT req_id, dst AS item_id, rank, connection_score, explanation, 'graph' AS method FROM shown
    UNION ALL SELECT req_id, item_id, rank, round(greatest(1.0, least(10.0, (1 - distance) * 10)), 1), '', 'vector' FROM v WHERE rank <= 10"""))
def suggestions_with_fallback(spark, sf):
    """Graph suggestions for every item; items without neighbours are answered by vector."""
    items, e = B.tagged_items(spark, sf), _embeddings(spark, sf)
    seeds = items.select(F.col("item_id").alias("req_id"), "item_id")
    asked = e.join(items, "item_id", "left_semi").select(F.col("item_id").alias("req_id"), "vec")
    edges = durable(B.edge_rows(spark, sf))
    return suggest.seed_suggestions(seeds, edges, B.library(spark, sf), items, asked, e.select("item_id", "vec"), "corpus")


@query(sql("f1", """SELECT item_id AS req_id, array_to_string(list_concat(
      CASE WHEN item_id % 2 = 0 THEN [summary] ELSE CAST([] AS VARCHAR[]) END, [theme], tags, [mood], [summary]), ' | ') AS query_text FROM f1"""))
def seed_query_text(spark, sf):
    """Semantic query text of single-seed requests."""
    f1 = B.tagged_items(spark, sf)
    seeds = f1.select(
        F.col("item_id").alias("req_id"), F.lit(0).alias("pos"),
        F.when(F.col("item_id") % 2 == 0, F.col("summary")).alias("seed_line"), "theme",
        F.col("tags").alias("secondary_themes"), "mood", "summary", F.col("translit").alias("translation"),
    )
    return suggest.query_text(seeds)


@query(sql("f1", """+ s AS (SELECT item_id, (item_id % 100) / 100.0::DOUBLE AS d, (item_id % 7) AS k, item_id % 2 = 0 AS flagged FROM f1)
    SELECT item_id, round(CASE WHEN flagged THEN least(1.0, d * 1.3) ELSE d END, 6) AS boosted, round(greatest(0.0, least(1.0, 1 - d)), 6) AS as_score,
    CASE WHEN k >= 3 THEN 'STRONG' WHEN k >= 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength,
    CASE WHEN k >= 7 THEN 'high' WHEN k >= 4 THEN 'mid' ELSE 'low' END AS band FROM s"""))
def score_columns(spark, sf):
    """Boost, distance and band columns over all items."""
    f1 = B.tagged_items(spark, sf).select("item_id")
    d, k = (F.col("item_id") % 100) / F.lit(100.0), F.col("item_id") % 7
    return f1.select(
        "item_id", F.round(S.boost(d, F.col("item_id") % 2 == 0, F.lit(True)), 6).alias("boosted"),
        F.round(S.distance_to_score(d), 6).alias("as_score"),
        S.transition_strength(k).alias("strength"), S.score_band(k).alias("band"),
    )
