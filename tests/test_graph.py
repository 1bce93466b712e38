"""The graph against a plain loop, and its properties."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagweave.operators import clusters, graph, regions, vectors
from tagweave.scale import tune

SCHEMA = (
    "item_id BIGINT, tags ARRAY<STRING>, vec ARRAY<DOUBLE>, display STRING, translit STRING, "
    "category STRING, author STRING, page INT, theme STRING, mood STRING, summary STRING"
)


def make_rows(n, seed=5, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tags = rng.sample([f"t{j}" for j in range(12)], rng.choice([0, 1, 1, 2, 3, 4, 7]))
        if hot and i % 3 == 0:
            tags.append("hot")
        if i % 11 == 0:
            tags.append("Repertoire")
        vec = None if i % 13 == 0 else [rng.gauss(0, 1) for _ in range(8)]
        if i % 17 == 0:
            vec = [0.0] * 8
        rows.append((i, tags, vec, f"item {i}", "", "c", "a", i, "th", "m", "s"))
    return rows


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na * nb > 0 else 0.0


def brute_force(rows, k_max=40, per_tag_min=3):
    tags = {r[0]: set(r[1]) - {"Repertoire"} for r in rows if r[1]}
    vec = {r[0]: r[2] for r in rows}
    index = defaultdict(list)
    for i, ts in tags.items():
        for t in ts:
            index[t].append(i)
    edges = {}
    for i, mine in tags.items():
        best = {}
        for t in mine:
            pools = {True: [], False: []}
            for j in index[t]:
                if j == i:
                    continue
                shared, cos = mine & tags[j], cosine(vec[i], vec[j])
                if shared == mine:
                    s = 0.5 * len(shared) / len(mine | tags[j]) + 0.5 * cos
                    if s > 0.05:
                        pools[True].append((-round(s, 6), False, j))
                else:
                    s = 0.7 * cos + min(0.1 * len(tags[j] - mine), 0.3) + 0.1
                    if s > 0.15:
                        pools[False].append((-round(s, 6), True, j))
            core = sorted(pools[True])[:4]
            branch = sorted(pools[False])[: max(4, 8 - len(core))]
            for s, not_core, j in sorted(core + branch)[: max(per_tag_min, k_max // len(mine))]:
                old = best.get(j, (1, True))
                best[j] = (min(old[0], s), old[1] and not_core)
        ranked = sorted((s, nc, j) for j, (s, nc) in best.items())[:k_max]
        for rank, (s, _, j) in enumerate(ranked, 1):
            edges[(i, j)] = (rank, -s, sorted(mine & tags[j]))
    return edges


def collected(df):
    return {(r.src, r.dst): (r["rank"], r.score, r.shared_tags) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return make_rows(160)


@pytest.fixture(scope="module")
def items(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
def test_graph_equals_brute_force(items, rows, block_rows):
    """Also with tags split into many blocks."""
    got, want = collected(graph.similarity_graph(items, block_rows=block_rows)), brute_force(rows)
    assert got.keys() == want.keys()
    for pair, (rank, score, shared) in want.items():
        assert got[pair][0] == rank and got[pair][2] == shared
        assert got[pair][1] == pytest.approx(score, abs=1e-9)


def test_slots_bind_and_degree_is_capped(items, rows):
    got = collected(graph.similarity_graph(items, k_max=6, per_tag_min=2))
    assert got.keys() == brute_force(rows, 6, 2).keys()
    assert max(r for r, _, _ in got.values()) <= 6


def test_graph_does_not_depend_on_partitioning(items):
    one = collected(graph.similarity_graph(items.coalesce(1)))
    many = collected(graph.similarity_graph(items.repartition(13)))
    assert one == many


def test_cells_of_one_hot_tag_spread_over_tasks(spark):
    """Grouping must not fall back to the layout by tag, which would put a hot tag in one task."""
    from tagweave.operators import blocks

    rows = spark.range(4000).select(F.col("id").alias("item_id"), F.lit("hot").alias("tag"))
    payload = rows.select("item_id", F.lit(1).alias("x"))
    cells = blocks.pair_cells(rows, payload, "tag", "item_id", 100)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [hot, cell_a" in plan
    sizes = cells.groupBy("cell_a", "cell_b").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 400 and sizes[1] == 40 * 41 // 2


def test_rows_of_a_hot_tag_meet_its_size_in_many_tasks(spark):
    n = 9000
    tag = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 2000))
    tags = spark.range(n).select(F.col("id").alias("item_id"), tag.alias("tag"))
    changed = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        placed = graph.tag_index(tags).withColumn("task", F.spark_partition_id())
        per_task = [r[1] for r in placed.filter("tag = 'hot'").groupBy("task").agg(F.count("*")).collect()]
        assert sum(per_task) == n // 3 and max(per_task) < n // 3 / 4
        plan = graph.tag_index(tags)._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan.split("Join", 1)[1].split("\n")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(r.tag, r.item_id) for r in tags.collect()}
    got = graph.tag_index(tags).collect()
    assert len(got) == n and {(r.tag, r.item_id) for r in got} == want
    assert all(r.n == n // 3 for r in got if r.tag == "hot")


def test_stats(items, rows):
    edges = graph.similarity_graph(items)
    stats = {r.metric: r.value for r in graph.graph_stats(items, edges).collect()}
    tagged = [r for r in rows if r[1]]
    assert stats["items"] == len(tagged)
    assert stats["markers"] == sum("Repertoire" in r[1] for r in tagged)
    assert stats["tags"] == 13
    assert stats["mean_degree"] == pytest.approx(round(edges.count() / len(tagged), 1))
    by_tag = defaultdict(list)
    for r in tagged:
        for t in set(r[1]) - {"Repertoire"}:
            by_tag[t].append(r[2] is not None)
    hits = sum(sum(v) * (sum(v) - 1) for v in by_tag.values())
    assert stats["vector_hits"] == hits
    assert "empty_clusters" not in stats


def test_empty_clusters_are_counted(items, rows, spark):
    alone = spark.createDataFrame([(10**6, ["only here", "Repertoire"], None)], items.select("item_id", "tags", "vec").schema)
    more = items.select("item_id", "tags", "vec").unionByName(alone)
    pooled = graph.pool_topk(graph.tag_candidates(more))
    best = {}
    for r in pooled.collect():
        best[(r.src, r.tag)] = max(r.score, best.get((r.src, r.tag), 0))
    pairs = {(r.item_id, r.tag) for r in graph.item_tags(more).collect()}
    found = {tuple(r) for r in graph.empty_clusters(more, pooled).collect()}
    assert (10**6, "only here") in found and found == pairs - set(best)
    bound = sorted(best.values())[len(best) // 2]
    weak = {tuple(r) for r in graph.empty_clusters(more, pooled, least=bound).collect()}
    assert weak == {p for p in pairs if best.get(p, -1) < bound} and len(weak) > len(found)
    stats = {r.metric: r.value for r in graph.graph_stats(more, graph.pooled_edges(more, pooled), pooled=pooled).collect()}
    assert stats["empty_clusters"] == len(found)
    same = lambda e: sorted(map(tuple, e.select("src", "dst", "score", "rank").collect()))
    assert same(graph.pooled_edges(more, pooled)) == same(graph.similarity_graph(more))


def test_item_meta_hides_the_marker(items):
    row = graph.item_meta(items).filter("item_id = 33").first()
    assert row.is_marker and "Repertoire" not in row.tags


@pytest.mark.parametrize("block_rows, region_rows", [(9, 4096), (4096, 4096), (4096, 10), (7, 10), (16, 100), (16, 19)])
def test_knn_is_exact_with_exclusions(items, rows, block_rows, region_rows):
    """Block by block, and region by region."""
    q = items.select(F.col("item_id").alias("query_id"), "vec")
    exclude = q.select("query_id", F.explode(F.array(F.col("query_id"), (F.col("query_id") + 1) % 160)).alias("item_id"))
    got = defaultdict(list)
    found = vectors.knn(q, items, 4, exclude=exclude, block_rows=block_rows, region_rows=region_rows)
    for r in found.orderBy("rank").collect():
        got[r.query_id].append(r.item_id)
    usable = [r for r in rows if r[2] is not None]
    for i, _, v, *_ in usable:
        ranked = sorted((round(1 - cosine(v, r[2]), 6), r[0]) for r in usable if r[0] not in (i, (i + 1) % 160))
        assert got[i] == [j for _, j in ranked[:4]]


def test_self_query_has_distance_zero(items):
    q = items.filter("item_id = 5").select(F.col("item_id").alias("query_id"), "vec")
    best = vectors.knn(q, items, 1).first()
    assert best.item_id == 5 and best.distance == 0.0


def planted(spark, n=4000, clusters=40, dim=16):
    """Vectors around centres far apart, a third of all around the first; some zero vectors and copies."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, dim))
    own = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))
    vecs = centres[own] + 0.02 * rng.normal(size=(n, dim))
    vecs[::500] = 0.0
    vecs[7::400] = vecs[7]
    return vecs, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id BIGINT, vec ARRAY<DOUBLE>")


def test_regions_visit_a_small_part_of_all_pairs(spark):
    vecs, corpus = planted(spark)
    queries = corpus.filter("id % 5 = 1").withColumn("fetch", F.lit(6))
    _, known = regions.build(corpus, len(vecs), 40)
    assert known.size.sum() == len(vecs) and known.size[-1] == 8
    first = [r for r in regions.visits(queries, known, rest=False).select("id", "region").collect()]
    unit = np.divide(vecs, np.linalg.norm(vecs, axis=1, keepdims=True), out=np.zeros_like(vecs), where=vecs.any(axis=1, keepdims=True))
    distance = np.round(1 - unit @ unit.T, 6)
    limits = [(i, float(np.sort(distance[i])[5])) for i in range(len(vecs))]
    limited = queries.join(spark.createDataFrame(limits, "id BIGINT, limit DOUBLE"), "id")
    second = [r for r in regions.visits(limited, known, rest=True).select("id", "region").collect()]
    compared = sum(int(known.size[r.region]) for r in first + second)
    # A query around the first centre has a third of all rows that are as near as its answers.
    assert compared < 0.25 * 800 * len(vecs)
    assert len(set(map(tuple, first + second))) == len(first) + len(second)
    got = defaultdict(list)
    for r in regions.knn(queries, corpus, len(vecs), 6, block_rows=150, region_rows=40).orderBy("rank").collect():
        got[r.query_id].append((r.item_id, r.distance))
    assert len(got) == 800
    for i, found in got.items():
        want = np.lexsort((np.arange(len(vecs)), distance[i]))[:6]
        assert [j for j, _ in found] == want.tolist() and [d for _, d in found] == pytest.approx(distance[i][want])


@pytest.mark.parametrize("kind", ["double", "float"])
def test_a_vector_travels_once_a_block_not_once_a_region(spark, monkeypatch, kind):
    """Without structure every region is visited; the answers are those of all pairs, ties to the lower id."""
    rng = np.random.default_rng(9)
    vecs = rng.integers(-2, 3, size=(600, 8)).astype(float)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], f"item_id BIGINT, vec ARRAY<{kind}>")
    queries = corpus.filter("item_id % 3 = 0").withColumnRenamed("item_id", "query_id")
    laid, moved = regions.blocks.by_cell, []
    monkeypatch.setattr(regions.blocks, "by_cell", lambda df, keys: moved.append(df.count()) or laid(df, keys))
    found = vectors.knn(queries, corpus, 5, block_rows=150, region_rows=10)
    got = defaultdict(list)
    for r in found.orderBy("rank").collect():
        got[r.query_id].append(r.item_id)
    # At most two blocks of queries and seven shelves, once around the queries and once for the rest.
    assert len(moved) == 2 and max(moved) < 2 * 600 + 7 * 200
    unit = np.divide(vecs, np.linalg.norm(vecs, axis=1, keepdims=True), out=np.zeros_like(vecs), where=vecs.any(axis=1, keepdims=True))
    distance = np.round(1 - unit @ unit.T, 6)
    assert got == {i: np.lexsort((np.arange(600), distance[i]))[:5].tolist() for i in range(0, 600, 3)}


def test_zero_queries_and_odd_tables(spark):
    _, corpus = planted(spark, 60, 3)
    zero = spark.createDataFrame([(1, [0.0] * 16), (2, None)], "query_id BIGINT, vec ARRAY<DOUBLE>")
    items = corpus.withColumnRenamed("id", "item_id")
    found = vectors.knn(zero, items, 3, region_rows=5).orderBy("rank").collect()
    assert [(r.query_id, r.item_id, r.distance) for r in found] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    nothing = items.withColumn("vec", F.array(*[F.lit(0.0)] * 16))
    q = items.filter("item_id = 9").select(F.col("item_id").alias("query_id"), "vec")
    assert [r.item_id for r in vectors.knn(q, nothing, 2, region_rows=5).orderBy("rank").collect()] == [0, 1]
    assert vectors.knn(q, items.filter("false"), 2, region_rows=5).isEmpty()
    assert vectors.knn(q.filter("false"), items, 2, region_rows=5).isEmpty()
    assert vectors.knn(q, items, 100, region_rows=5).count() == 60


def test_predicate_restricts_answers(items):
    e = items.withColumn("kind", F.col("item_id") % 2)
    q = e.select(F.col("item_id").alias("query_id"), "vec", "kind")
    out = vectors.knn(q, e, 3, where=["kind"])
    assert out.filter("query_id % 2 <> item_id % 2").count() == 0


# ---- clusters --------------------------------------------------------------------------------

META = "item_id BIGINT, tags ARRAY<STRING>, theme STRING"
EDGES = "src BIGINT, dst BIGINT, score DOUBLE, shared_tags ARRAY<STRING>"


def cluster(spark, edges, meta, flags=(), boost=False, threshold=0.3, per_tag=8, found=None):
    requests = spark.createDataFrame([(1, 1, threshold, per_tag, boost)], "req_id BIGINT, src BIGINT, threshold DOUBLE, per_tag INT, boost BOOLEAN")
    meta_df = spark.createDataFrame(meta, META)
    sizes = graph.tag_sizes(meta_df.select("item_id", F.explode("tags").alias("tag")))
    flag_df = spark.createDataFrame([(i, True) for i in flags], "item_id BIGINT, flagged BOOLEAN")
    vector = None if found is None else spark.createDataFrame(found, "req_id BIGINT, dst BIGINT, distance DOUBLE")
    out = clusters.neighbor_clusters(requests, spark.createDataFrame(edges, EDGES), meta_df, sizes, flag_df, vector)
    got = defaultdict(list)
    for r in out.orderBy("cluster", "rank").collect():
        got[r.cluster].append(r.dst)
    return dict(got)


def test_neighbour_with_all_tags_appears_in_every_cluster(spark):
    meta = [(1, ["a", "b"], "x"), (2, ["a", "b", "c"], "x"), (3, ["a"], "x")]
    edges = [(1, 2, 0.9, ["a", "b"]), (1, 3, 0.8, ["a"])]
    assert cluster(spark, edges, meta) == {"a": [2, 3], "b": [2]}


def test_branch_goes_to_rarest_new_tag_and_thin_ones_fold_into_best_core(spark):
    meta = [
        (1, ["a", "b"], "x"), (2, ["a", "b"], "x"), (3, ["b", "c", "d"], "x"), (4, ["a", "d"], "x"),
        (5, ["a", "c"], "x"), (6, ["d"], "x"), (7, ["c", "d"], "x"),
    ]
    edges = [(1, 2, 0.5, ["a", "b"]), (1, 3, 0.7, ["b"]), (1, 4, 0.6, ["a"]), (1, 5, 0.4, ["a"])]
    # c and d: three items carry c (3, 5, 7), four carry d, so 3 goes to c and 4 to d.
    assert cluster(spark, edges, meta) == {"a": [4, 2], "b": [2], "c": [3, 5]}


def test_thin_clusters_without_target_stay(spark):
    meta = [(1, ["a"], "x"), (2, ["b"], "x"), (3, ["c"], "x")]
    edges = [(1, 2, 0.5, []), (1, 3, 0.6, [])]
    assert cluster(spark, edges, meta) == {"b": [2], "c": [3]}


def test_boost_lifts_over_the_threshold(spark):
    meta = [(1, ["a"], "x"), (2, ["a"], "x")]
    edges = [(1, 2, 0.25, ["a"])]
    assert cluster(spark, edges, meta, flags=[2]) == {}
    assert cluster(spark, edges, meta, flags=[2], boost=True) == {"a": [2]}


def test_vector_hit_wins_and_uses_its_first_matching_tag(spark):
    meta = [(1, ["a", "b"], "x"), (2, ["b", "a"], "x"), (3, [], "Calm"), (4, [], None), (5, ["a"], "x")]
    edges = [(1, 2, 0.9, ["a", "b"]), (1, 5, 0.9, ["a"])]
    found = [(1, 2, 0.0), (1, 3, 0.1), (1, 4, 0.2)]
    got = cluster(spark, edges, meta, found=found)
    # 2 only under its first tag; the two untagged hits are thin and fold into the best core cluster.
    assert got == {"b": [2, 3, 4], "a": [5]}


def test_untagged_vector_hits_cluster_by_theme(spark):
    meta = [(1, ["a"], "x"), (3, [], "Calm"), (4, [], "Calm"), (5, [], None), (6, [], " ")]
    got = cluster(spark, [(1, 9, 0.1, [])], meta, found=[(1, 3, 0.1), (1, 4, 0.2), (1, 5, 0.3), (1, 6, 0.4)])
    assert got == {"Calm": [3, 4], "Similar": [5, 6]}


def test_score_range_uses_raw_scores_and_upper_median(spark):
    rows = spark.createDataFrame([(1, s) for s in (0.1, 0.4, 0.2, 0.3)], "req_id BIGINT, base_score DOUBLE")
    r = clusters.score_range(rows).first()
    assert (r.score_min, r.score_max, r.score_median, r.total_available) == (0.1, 0.4, 0.3, 4)


def test_tune_is_idempotent(spark):
    assert tune(tune(spark)) is spark


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_items_without_vectors_are_compared_by_kind(spark, monkeypatch, block_rows):
    """The cells see kinds and items with vectors, not all items; the edges are those of the plain loop."""
    rng = random.Random(3)
    sets = [rng.sample("abcdefg", rng.choice([1, 2, 3, 5])) for _ in range(9)]
    rows = [
        (i, rng.choice(sets), [rng.gauss(0, 1) for _ in range(4)] if i % 10 == 9 else None, "", "", "", "", 0, "", "", "")
        for i in range(400)
    ]
    many, seen = spark.createDataFrame(rows, SCHEMA), []
    cells = graph.blocks.pair_cells
    monkeypatch.setattr(graph.blocks, "pair_cells", lambda m, p, *a: seen.append(p.count()) or cells(m, p, *a))
    got = collected(graph.similarity_graph(many, block_rows=block_rows))
    assert got == brute_force(rows)
    assert sorted(seen) == [len({tuple(sorted(s)) for s in sets}), 40]


def test_cells_of_few_bytes_are_many_tasks(spark):
    """Adaptive execution joins partitions by their bytes, of which a cell has few for its work."""
    rows = spark.range(400).select(F.col("id").alias("item_id"), F.lit("t").alias("tag"))
    cells = graph.blocks.pair_cells(rows, rows.select("item_id"), "tag", "item_id", 20)
    tasks = cells.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > 20


def test_shared_counts_with_more_tags_than_the_matrix_holds(monkeypatch):
    rng = np.random.default_rng(5)
    tags = pd.Series([sorted({f"t{x}" for x in rng.zipf(1.3, 6) % 500}) for _ in range(120)])
    src, dst = np.arange(0, 120, 2), np.arange(0, 120, 3)
    want = [[len(set(tags[a]) & set(tags[b])) for b in dst] for a in src]
    for columns in (256, 7):
        monkeypatch.setattr(graph.blocks, "DENSE_TAGS", columns)
        assert graph.blocks.shared_counts(tags, src, dst).tolist() == want


def test_rows_of_a_cell_are_scored_in_full_only_where_a_bound_allows(monkeypatch):
    """The best of each row, as a comparison of all pairs finds them, from a part of the pairs."""
    rng = np.random.default_rng(6)
    n = 400
    tags = [["t", *sorted({f"u{x}" for x in rng.integers(0, 6, rng.integers(0, 4))})] for _ in range(n)]
    vec = rng.normal(size=(n, 16))
    pdf = pd.DataFrame({"item_id": np.arange(n), "tags": tags, "vec": list(vec), "tag": "t"})
    pdf = pdf.assign(block=pdf["item_id"] % 2, cell_a=0, cell_b=1)
    unit, scored, seen = graph.blocks.unit_rows(pdf["vec"]), graph._scored, []
    want = set()
    for i in range(n):
        found = []
        for j in range(1 - i % 2, n, 2):
            shared = len(set(tags[i]) & set(tags[j]))
            of = scored(np.array(shared), np.array(len(tags[i])), np.array(len(tags[j])), unit[i] @ unit[j])
            found += [(core, float(-s), j, k) for core, s, keep, k in of if keep]
        for side in (True, False):
            best = sorted(x for x in found if x[0] == side)
            want |= {(i, side, j, round(-s, 6)) for _, s, j, k in best[: best[0][3]]} if best else set()
    monkeypatch.setattr(graph, "_scored", lambda *a: seen.append(np.size(a[0])) or scored(*a))
    got = graph._cell_candidates(pdf)
    assert {(r.src, r.core, r.dst, round(r.score, 6)) for r in got.itertuples()} == want
    assert sum(seen) < n * n / 2 * 0.8


def test_vector_cells_strip_by_strip_equal_all_pairs(monkeypatch):
    """Also with an id that several rows have, and with vectors of which some are zero or missing."""
    rng = np.random.default_rng(7)
    n = 300
    tags = [["t", *sorted({f"u{x}" for x in rng.integers(0, 5, rng.integers(0, 4))})] for _ in range(n)]
    vec = [None if i % 29 == 0 else v * (i % 31 > 0) for i, v in enumerate(rng.integers(-2, 3, size=(n, 6)).astype(float))]
    ids = np.where(np.arange(n) % 50 < 3, np.arange(n) // 50 * 50, np.arange(n))
    pdf = pd.DataFrame({"item_id": ids, "tags": tags, "vec": vec, "tag": "t", "block": 0, "cell_a": 0, "cell_b": 0})
    unit, want = graph.blocks.unit_rows(pdf["vec"]), []
    for i in range(n):
        found = {True: [], False: []}
        for j in np.flatnonzero(ids != ids[i]):
            shared = len(set(tags[i]) & set(tags[j]))
            of = graph._scored(np.array(shared), np.array(len(tags[i])), np.array(len(tags[j])), unit[i] @ unit[j])
            for core, s, keep, _ in of:
                if keep:
                    found[core].append((-float(s), int(ids[j])))
        for core, k in ((True, 4), (False, 8)):
            want += [(int(ids[i]), core, j, round(-s, 6)) for s, j in sorted(found[core])[:k]]
    monkeypatch.setattr(graph, "VECTOR_STRIP", 70)
    monkeypatch.setattr(graph, "VECTOR_COLUMNS", 40)
    got = graph._cell_candidates(pdf)
    assert sorted((r.src, r.core, r.dst, round(r.score, 6)) for r in got.itertuples()) == sorted(want)


def test_cells_run_once_for_items_and_those_they_stand_in_for(items):
    """Pools and edges are read twice; what is read must be a table, not the cells."""
    for df in (graph.candidate_pools(items), graph.similarity_graph(items)):
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
