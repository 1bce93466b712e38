import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.operators import collection, graph, library, passes, search, sets, similarity, suggest
from tagweave.sources import incremental, tables


# ---- sources ---------------------------------------------------------------------------------


def test_items_roundtrip_as_json_array(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"item_id": 1, "tags": ["a"], "refrain": {"start": 2}}, {"item_id": 2}]))
    got = {r.item_id: r for r in tables.read_items(spark, str(tmp_path), multiline=True).collect()}
    assert got[1].tags == ["a"] and got[1].refrain.start == 2 and got[2].tags is None


def test_annotation_shards_replace_only_their_own(spark, tmp_path):
    rows = [(1, "t", None, None, ["x"], None, 0.1, False, None)]
    def shard(name):
        df = spark.createDataFrame(rows, schemas.ANNOTATIONS.replace("annotator STRING, ", ""))
        return df.withColumn("annotator", F.lit(name))

    path = str(tmp_path / "ann")
    tables.write_annotations(shard("a").union(shard("b")), path)
    tables.write_annotations(shard("b").limit(0).union(shard("b").withColumn("theme", F.lit("new"))), path)
    got = {r.annotator: r.theme for r in tables.read_annotations(spark, path).collect()}
    assert got == {"a": "t", "b": "new"}


def test_vocabulary_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"theme_tags": {"B": {"description": "d", "raw_themes": ["x"], "count": 3}, "A": {}}, "mood_tags": {"M": {}}}))
    (tmp_path / "b.json").write_text(json.dumps(["Z", "Y", "Z"]))
    got = [(r.tag, r.kind, r.raw_values) for r in tables.read_vocabulary(spark, str(tmp_path / "a.json")).collect()]
    assert got == [("A", "theme", []), ("B", "theme", ["x"]), ("M", "mood", [])]
    assert [r.tag for r in tables.read_vocabulary(spark, str(tmp_path / "b.json")).collect()] == ["Y", "Z"]


def test_synonyms_keep_file_order_and_skip_comments(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"_comment": "text", "Zed": ["b", "a"], "Alpha": []}))
    got = [(r.canonical, r.variant) for r in tables.read_synonyms(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [("Zed", "b"), ("Zed", "a"), ("Alpha", None)]


def test_graph_bundle_roundtrip(spark, tmp_path):
    from tests.test_graph import SCHEMA, make_rows

    bundle = graph.build_bundle(spark.createDataFrame(make_rows(60), SCHEMA))
    tables.write_graph(bundle, str(tmp_path))
    saved = tables.read_graph(spark, str(tmp_path))
    assert saved.edges.count() == bundle.edges.count() > 0
    assert saved.index.count() == bundle.index.count()


def test_latest_wins_and_upsert(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k INT, ts INT, v STRING")
    assert {r.k: r.v for r in incremental.latest_wins(df, ["k"], "ts").collect()} == {1: "c", 2: "x"}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "item_id BIGINT, v STRING")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "item_id BIGINT, v STRING")
    assert {r.item_id: r.v for r in incremental.upsert_vectors(old, new).collect()} == {1: "a", 2: "B", 3: "C"}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(i, f"v{i}", 0) for i in range(60)], "item_id BIGINT, v STRING, seq INT")
    incremental.create_bucketed(rows, path, buckets=8)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "vectors").rglob("*.parquet")}

    before = files()
    new = [(3, "old", 1), (3, "new", 2), (100, "added", 1)]
    touched = incremental.upsert_bucketed(spark, path, spark.createDataFrame(new, rows.schema), buckets=8, order="seq")
    same = lambda names: {f for f in names if int(f.split("/")[0].split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 2 and same(files()) == same(before) and files() != before
    got = {r.item_id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {i: f"v{i}" for i in range(60)} | {3: "new", 100: "added"}
    assert spark.read.parquet(path).count() == 61
    assert incremental.upsert_bucketed(spark, path, rows.limit(0), buckets=8) == [] and files() >= same(before)
    twice = incremental.upsert_vectors(rows.filter("item_id < 5"), spark.createDataFrame(new, rows.schema), order="seq")
    assert sorted(r.v for r in twice.collect()) == ["added", "new", "v0", "v1", "v2", "v4"]


# ---- collection ------------------------------------------------------------------------------


def test_collection_index_and_flag_merge(spark):
    entries = spark.createDataFrame(
        [(1, 5, "G"), (1, 3, "G"), (1, 5, "G"), (2, 1, "D"), (None, 1, "G"), (3, None, "G")], schemas.COLLECTION_ENTRIES
    )
    index = collection.collection_index(entries)
    row = index.first()
    assert (row.item_id, row.chapters, row.n_entries) == (1, [3, 5], 3) and index.count() == 1
    old = spark.createDataFrame(
        [(1, True, [9], 1, None), (7, True, [9], 1, None), (8, True, [9], 1, "other")],
        "item_id BIGINT, flagged BOOLEAN, chapters ARRAY<BIGINT>, n_entries BIGINT, extra STRING",
    )
    got = {r.item_id: (r.flagged, r.chapters, r.extra) for r in collection.merge_flags(old, index).collect()}
    assert got == {1: (True, [3, 5], None), 8: (None, None, "other")}


# ---- library ---------------------------------------------------------------------------------


def test_tracks_keep_their_row_numbers(spark):
    raw = spark.createDataFrame(
        [(0, " A ", " K ", "nan", None), (1, "nan", "K", "", "High"), (2, None, "K", "x", "Low"), (3, "B", None, "x ", " High ")],
        "row_index BIGINT, title STRING, contributor STRING, style STRING, confidence STRING",
    )
    got = [(r.rec_id, r.title, r.contributor, r.style, r.confidence) for r in library.clean_tracks(raw).orderBy("rec_id").collect()]
    assert got == [(1, "A", "K", None, "Medium"), (4, "B", "", "x", "High")]


def test_carry_forward_takes_the_last_duplicate_where_not_null(spark):
    schema = "rec_id BIGINT, title STRING, contributor STRING, theme STRING, mood STRING"
    fresh = spark.createDataFrame([(1, "A", "k", None, "m0"), (2, "B", None, "t0", None)], schema)
    prior = spark.createDataFrame([(1, " a", "K", "old", "m1"), (5, "a ", "k ", "newer", None), (6, "c", "k", "z", "z")], schema)
    got = {r.rec_id: (r.theme, r.mood) for r in library.carry_forward(fresh, prior).collect()}
    assert got == {1: ("newer", "m0"), 2: ("t0", None)}


def test_titles_link_through_shorter_queries(spark):
    rows = [(1, 0, "tera naam karee channaatheeaa"), (2, 0, "tera naam aur kuchh"), (3, 0, "bilkul alag shabda"), (4, 0, "tera ghar naam")]
    df = spark.createDataFrame(rows, "item_id BIGINT, line_no INT, translit STRING")
    titles = spark.createDataFrame(
        [(1, "Tera Naam Karee (live)"), (2, "tera naam kuchh aur"), (3, "zzz qqq"), (4, "(only)"), (5, "alag")], "rec_id BIGINT, title STRING"
    )
    got = {r.rec_id: (r.item_id, r.status) for r in library.link_titles(titles, df).collect()}
    assert got[1] == (1, "pending") and got[2] == (2, "pending")
    assert got[3] == (None, "unmatched") and got[4] == (None, "unmatched")
    assert got[5] == (3, "pending")


def _plain_score(title, line, ratio):
    """The title score of one pair by loops."""
    def fold(t):
        t = re.sub(r"[^a-zA-Z\s]", "", t).lower().strip()
        for pattern, repl in (("aa+", "a"), ("ee+", "i"), ("oo+", "u"), ("ai", "e"), ("au", "o"), (r"(.)\1+", r"\1"), (r"\s+", " ")):
            t = re.sub(pattern, repl, t)
        return t.strip()

    text = re.sub(r"[^a-zA-Z\s]", "", line).lower().strip()
    scores = [ratio(title, text), ratio(fold(title), fold(text)), 0.85 if fold(text).startswith(fold(title)[:12]) else 0.0]
    tw, lw = [fold(w) for w in title.split()], {fold(w) for w in text.split()}
    if tw and lw:
        scores.append(0.9 * sum(any(w == x or ratio(w, x) > 0.7 for x in lw) for w in tw) / len(tw))
    return max(scores)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1.0 - row[-1] / max(len(a), len(b), 1)


def test_title_scores_are_those_of_all_measures(spark):
    rnd = random.Random(8)
    words = ["tera", "teraa", "naam", "nam", "karee", "kari", "chan", "channaa", "aaoo", "man", "urasa", "zz"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, n)))
    rows = [(make(4), make(9).title() + rnd.choice(["", " 12.", "!"])) for _ in range(120)]
    rows += [("tera naam", "tera naam"), ("x", "!!"), ("tera naam", "zzz"), ("anything", ""), ("anything", None)]
    df = spark.createDataFrame(rows, "clean STRING, line STRING")
    blocks = lambda a, b: SequenceMatcher(None, a, b).ratio()
    for measure, plain in ((similarity.matching_blocks, blocks), (similarity.edit_ratio, _edits)):
        got = {(r.clean, r.line): r.score for r in similarity.title_scores(df, "clean", "line", measure).collect()}
        want = {(t, x): _plain_score(t, x, plain) for t, x in rows if x}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    bound = df.filter("line <> ''").select("*", similarity.ratio_bound(F.col("clean"), F.lower("line")).alias("b")).collect()
    assert all(r.b >= blocks(r.clean, r.line.lower()) - 1e-9 and r.b >= _edits(r.clean, r.line.lower()) - 1e-9 for r in bound)


def test_library_search_filters(spark):
    rows = [(1, "Alpha", "K", "r1", "r2", "High", "love", "", "x\ny"), (2, "Beta", "K", "r2", "r9", "Low", None, "of ALPHA", None)]
    df = spark.createDataFrame(
        rows, "rec_id BIGINT, title STRING, contributor STRING, category STRING, perf_category STRING, confidence STRING, theme STRING, translation STRING, body STRING"
    )
    for c in ("author", "mood", "status"):
        df = df.withColumn(c, F.lit(""))
    df = df.withColumn("page", F.lit(1)).withColumn("item_id", F.lit(1))
    def ids(**kw):
        return sorted(r.rec_id for r in library.search_library(df, **kw).collect())

    assert ids(q="alpha") == [1, 2]
    assert ids(category="r2") == [1, 2]
    assert ids(q="alpha", confidence="Low") == [2]
    assert library.search_library(df, q="love").first().first_line == "x"


# ---- search ----------------------------------------------------------------------------------


def test_substring_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    def word(n):
        return "".join(rng.choice("abc ") for _ in range(n))

    texts = [(i, word(rng.randint(0, 15))) for i in range(80)]
    needles = sorted({word(rng.randint(1, 5)) for _ in range(40)})
    got = {
        (r.query_id, r.text_id)
        for r in search.substring_pairs(
            spark.createDataFrame([(n, n) for n in needles], "query_id STRING, needle STRING"),
            spark.createDataFrame(texts, "text_id BIGINT, haystack STRING"),
        ).collect()
    }
    assert got == {(n, i) for n in needles for i, t in texts if n in t}


def test_tag_tier_answers_only_without_title_hits(spark):
    meta = spark.createDataFrame(
        [(1, "red ring", ["blue"], "t"), (2, "blue ring", ["x"], "t"), (3, "other", ["green day"], "Blue mood"), (4, None, None, None)],
        "item_id BIGINT, title STRING, tags ARRAY<STRING>, theme STRING",
    )
    q = spark.createDataFrame([(1, "RING blue"), (2, "green d"), (3, "mood"), (4, "zzz")], "query_id INT, q STRING")
    got = sorted((r.query_id, r.item_id, r.tier) for r in search.search_items(q, meta).collect())
    assert got == [(1, 2, "title"), (2, 3, "tag"), (3, 3, "tag")]


def test_initials_modes_and_minimum(spark):
    df = spark.createDataFrame(
        [(1, 0, "x y"), (1, 1, "har ke jan"), (1, 2, "har ke"), (2, 0, "mere har ke jan")], "item_id BIGINT, line_no INT, translit STRING"
    )
    q = spark.createDataFrame([(1, "h k j"), (2, "h")], "query_id INT, q STRING")
    def got(mode):
        return sorted((r.item_id, r.line_no) for r in search.search_initials(q, df, mode).collect())

    assert got("prefix") == [(1, 1)]
    assert got("anywhere") == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        search.search_initials(q, df, "other")


# ---- sets ------------------------------------------------------------------------------------


def test_transitions_use_positions_for_repeated_items(spark):
    rows = [(1, 0, 7, ["a", "b", "c"]), (1, 1, 8, ["c", "b", "a"]), (1, 2, 7, ["a", "b", "c"]), (1, 3, 9, ["z"]), (2, 0, 5, ["q"])]
    df = spark.createDataFrame(rows, "set_id BIGINT, pos INT, item_id BIGINT, tags ARRAY<STRING>")
    got = [(r.pos, r.item_id, r.next_id, r.shared_tags, r.strength) for r in sets.transitions(df).orderBy("pos").collect()]
    assert got == [(0, 7, 8, ["a", "b", "c"], "STRONG"), (1, 8, 7, ["a", "b", "c"], "STRONG"), (2, 7, 9, [], "WEAK")]
    names = {r.set_id: r.name for r in sets.name_sets(df.withColumn("tags", F.when(F.col("set_id") == 1, F.col("tags")))).collect()}
    assert names == {1: "a & b", 2: "Set (1 items)"}


def test_add_to_set_skips_known_items(spark):
    s = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "set_id BIGINT, pos INT, item_id BIGINT")
    adds = spark.createDataFrame([(1, 0, 8), (1, 1, 9), (1, 2, 9), (2, 0, 7)], "set_id BIGINT, seq INT, item_id BIGINT")
    got = sorted((r.set_id, r.pos, r.item_id) for r in sets.add_to_set(s, adds).collect())
    assert got == [(1, 0, 7), (1, 1, 8), (1, 2, 9), (2, 0, 7)]
    tagged = sets.add_to_set(s, adds).withColumn("tags", F.array(F.lit("t")))
    pairs = sorted((r.set_id, r.item_id, r.next_id) for r in sets.transitions(tagged).collect())
    assert pairs == [(1, 7, 8), (1, 8, 9)]


def test_synonyms_of_a_long_list_keep_their_order(spark):
    import json

    from tagweave.sources.tables import parse_synonyms

    names = {f"c{i}": ["v"] if i in (3, 49_999) else [f"v{i}", "w"] for i in range(50_000)}
    rows = parse_synonyms(spark.createDataFrame([(json.dumps(names),)], "value STRING"))
    last = rows.filter("variant = 'v'").orderBy(F.desc("ordinal")).first()
    assert rows.count() == 99_998 and last["canonical"] == "c49999"
    assert rows.select("ordinal").distinct().count() == 99_998
    long = parse_synonyms(spark.createDataFrame([(json.dumps({"a": ["x"] * 150_000, "b": ["y"]}),)], "value STRING"))
    assert long.filter("canonical = 'a'").agg(F.max("ordinal")).first()[0] < long.filter("canonical = 'b'").first()["ordinal"]


def test_vector_answers_stay_in_the_category(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, ["a"])], "src BIGINT, dst BIGINT, score DOUBLE, shared_tags ARRAY<STRING>")
    seeds = spark.createDataFrame([(1, 1)], "req_id BIGINT, item_id BIGINT")
    rows = [(2, [1.0, 0.0], "x"), (3, [0.9, 0.1], "z"), (4, [0.0, 1.0], "y")]
    corpus = spark.createDataFrame(rows, "item_id BIGINT, vec ARRAY<DOUBLE>, category STRING")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "req_id BIGINT, vec ARRAY<DOUBLE>")
    lib = spark.createDataFrame([], "rec_id BIGINT, item_id BIGINT, vec ARRAY<DOUBLE>")
    meta = corpus.select("item_id", "category")
    for category, want in (("z", [3]), ("q", [])):
        out = suggest.seed_suggestions(seeds, edges, lib, meta, asked, corpus, "corpus", category)
        assert [r.item_id for r in out.collect()] == want


def test_strip_takes_all_white_space(spark):
    from tagweave.functions import text as X

    rows = spark.createDataFrame([("\tLove\r",), ("\u00a0a b\x0b",), ("\r\n\t",), (None,)], "v STRING")
    assert [r[0] for r in rows.select(X.strip("v")).collect()] == ["Love", "a b", "", None]


def test_nothing_is_broadcast_on_an_estimate(spark):
    lines = spark.createDataFrame([(1, "a\nb")], "item_id BIGINT, text STRING")
    lines = lines.select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    plan = lines.join(lines.withColumnRenamed("line", "other"), "item_id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


# ---- suggestions -----------------------------------------------------------------------------


def test_seed_merge_and_fallback(spark):
    edges = spark.createDataFrame([(1, 3, 0.5, ["a"]), (2, 3, 0.7, ["b"]), (1, 2, 0.9, ["a"])], "src BIGINT, dst BIGINT, score DOUBLE, shared_tags ARRAY<STRING>")
    seeds = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "req_id BIGINT, item_id BIGINT")
    vecs = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [1.0, 0.1])], "item_id BIGINT, vec ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "req_id BIGINT, vec ARRAY<DOUBLE>")
    lib = spark.createDataFrame([(50, 3, [1.0, 0.0])], "rec_id BIGINT, item_id BIGINT, vec ARRAY<DOUBLE>")
    meta = spark.createDataFrame([(3, "x")], "item_id BIGINT, category STRING")
    out = suggest.seed_suggestions(seeds, edges, lib, meta, asked, vecs, "corpus")
    got = [(r.req_id, r.item_id, r.connection_score, r.method) for r in out.orderBy("req_id", "rank").collect()]
    assert got == [(1, 3, 6.9, "graph"), (2, 3, 10.0, "vector"), (2, 4, 1.0, "vector")]
    own = suggest.filter_source(suggest.merge_seeds(edges, seeds), "library", lib, meta, "x").collect()
    assert [(r.dst, r.rec_id) for r in own] == [(3, 50)]


@pytest.mark.parametrize("part", [3, 4096])
def test_seeds_merge_in_parts_and_only_what_can_answer(spark, monkeypatch, part):
    """Also for a request of many seeds, one without an id and seeds without neighbours or an id."""
    monkeypatch.setattr(suggest, "PART_SEEDS", part)
    rng = random.Random(4)
    near = {(s, d): (rng.randint(1, 30) / 30, rng.sample("abcde", rng.randint(1, 3))) for s in range(40) for d in rng.sample(range(60), 12)}
    edges = spark.createDataFrame(
        [(s, d, *e) for (s, d), e in near.items()], "src BIGINT, dst BIGINT, score DOUBLE, shared_tags ARRAY<STRING>"
    )
    asked = [(r, rng.randrange(45)) for r in [0] * 30 + [*range(1, 9)] * 3 + [None] * 3] + [(9, 44), (1, None)]
    seeds = spark.createDataFrame(asked, "req_id BIGINT, item_id BIGINT")
    want = {}
    for r, s in set(asked):
        for (src, d), (score, tags) in near.items():
            if src == s and (r is None or (r, d) not in asked):
                old = want.setdefault((r, d), (0, set()))
                want[r, d] = max(old[0], score), old[1] | set(tags)
    got = suggest.merge_seeds(edges, seeds, without_seeds=True)
    assert {(x.req_id, x.dst): (x.score, set(x.shared_tags)) for x in got.collect()} == want
    assert suggest.exclude(suggest.merge_seeds(edges, seeds), seeds).exceptAll(got).isEmpty()
    best = [(x.req_id, x["rank"], x.dst, x.score, set(x.shared_tags)) for x in suggest.top_from_seeds(edges, seeds, 4).collect()]
    ranked = {r: sorted((-s, d, t) for (q, d), (s, t) in want.items() if q == r)[:4] for r, _ in want if r is not None}
    assert sorted(best) == [(r, i, d, -s, t) for r in sorted(ranked) for i, (s, d, t) in enumerate(ranked[r], 1)]
    kept = suggest.answering(edges, "library", spark.createDataFrame([(5, 7)], "rec_id BIGINT, item_id BIGINT"), edges)
    assert {(x.src, x.dst) for x in kept.collect()} == {e for e in near if e[1] == 7}


def test_query_text_falls_back_to_translations(spark):
    schema = "req_id INT, pos INT, seed_line STRING, theme STRING, secondary_themes ARRAY<STRING>, mood STRING, summary STRING, translation STRING"
    rows = [(1, 1, None, "T2", None, None, "s2", "x"), (1, 0, "line", "T1", ["u"], "m", None, "x"), (2, 0, "", None, None, None, None, "y" * 400)]
    got = {r.req_id: r.query_text for r in suggest.query_text(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "line | T1 | u | m | T2 | s2", 2: "y" * 300}


# ---- passes ----------------------------------------------------------------------------------


def test_pass_retries_errors_and_orders_flagged_first(spark):
    items = spark.createDataFrame(
        [(1, 9, "x"), (2, 1, "x"), (3, 2, " "), (4, 3, "x"), (5, 4, "x")], "item_id BIGINT, page INT, translation STRING"
    ).withColumn("refrain", F.lit(None).cast("struct<translation: string>"))
    done = spark.createDataFrame([(4, ["t"], None), (2, ["t"], "late error"), (5, None, None)], "item_id BIGINT, tags ARRAY<STRING>, error STRING")
    flags = spark.createDataFrame([(1, True)], "item_id BIGINT, flagged BOOLEAN")
    order = passes.work_order(passes.pending(items, done, flags), flags)
    assert [r.item_id for r in order.collect()] == [1, 2, 5]
    assert [r.item_id for r in passes.pending(items, done, flags, "unflagged").orderBy("item_id").collect()] == [2, 5]
    def flaky(text):
        if "x" not in text:
            raise RuntimeError("down")
        return '```json\n{"primary_theme": "th", "tags": "no list"}\n```'

    out = passes.annotator_pass(items, done, flags, flaky, "stub", limit=1).first()
    assert (out.item_id, out.theme, out.tags, out.error, out.constrained) == (1, "th", [], None, False)


def test_stored_pass_asks_only_once(spark, tmp_path):
    items = spark.createDataFrame([(1, 9, "x"), (2, 1, "x")], "item_id BIGINT, page INT, translation STRING")
    items = items.withColumn("refrain", F.lit(None).cast("struct<translation: string>"))
    flags = spark.createDataFrame([(1, True)], "item_id BIGINT, flagged BOOLEAN")
    path, calls = str(tmp_path / "shards"), spark.sparkContext.accumulator(0)

    def answer(text):
        calls.add(1)
        return '{"primary_theme": "th", "tags": ["t"]}'

    first = passes.run_pass(items, flags, answer, "stub", path)
    assert sorted(r.item_id for r in first.collect()) == [1, 2] and first.count() == 2 and calls.value == 2
    more = items.union(spark.createDataFrame([(3, 1, "x")], "item_id BIGINT, page INT, translation STRING").withColumn("refrain", F.lit(None).cast("struct<translation: string>")))
    second = passes.run_pass(more, flags, answer, "stub", path, done=tables.read_annotations(spark, path))
    assert sorted(r.item_id for r in second.collect()) == [1, 2, 3] and calls.value == 3


def test_answers_realign_by_index_and_position(spark):
    members = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20), (2, 2, 21)], "batch_id BIGINT, place INT, item_id BIGINT")
    answers = spark.createDataFrame(
        [(1, json.dumps({"results": [{"index": 2, "primary_theme": "b"}, {"index": 1, "primary_theme": "a", "tags": ["t"]}]})),
         (2, json.dumps({"results": [{"index": 2, "primary_theme": "d"}]}))],
        "batch_id BIGINT, answer STRING",
    )
    good, redo = passes.realign(answers, members, "index")
    assert {r.item_id: (r.theme, r.tags) for r in good.collect()} == {10: ("a", ["t"]), 11: ("b", []), 21: ("d", [])}
    assert [r.item_id for r in redo.collect()] == [20]
    good, redo = passes.realign(answers, members, "position")
    assert {r.item_id: r.theme for r in good.collect()} == {10: "b", 11: "a"}
    assert sorted(r.item_id for r in redo.collect()) == [20, 21]


def test_hashed_vectors_count_words(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "item_id BIGINT, text STRING")
    got = {r.item_id: r.vec for r in passes.hashed_vectors(df, "text", 16).collect()}
    assert sum(got[1]) == 3 and len(got[1]) == 16 and 2 not in got


def test_full_batches_after_an_anti_join(spark):
    items = spark.createDataFrame([(i * 97,) for i in range(100) if i % 3], "item_id BIGINT").repartition(9)
    got = passes.full_batches(items, 12).collect()
    order = {r.item_id: (r.batch_id, r.place) for r in got}
    assert [order[i] for i in sorted(order)] == [(k // 12, k % 12 + 1) for k in range(len(order))]
    assert passes.full_batches(items.limit(0), 12).collect() == []


def test_short_batches_are_asked_again(spark, tmp_path):
    """A stub that answers only two of a batch, and never item 13."""

    def annotate(requests):
        if len(requests) > 4:
            raise TimeoutError("too many")
        if len(requests) == 1 and "text 13;" in requests[0]:
            raise ValueError("cannot read")
        keep = requests[:2] if len(requests) > 1 else requests
        return json.dumps({"results": [{"primary_theme": r.split(";")[0][-2:], "tags": ["t"]} for r in keep]})

    rows = [(i, f"text {i};", None) for i in range(20)]
    items = spark.createDataFrame(rows, "item_id BIGINT, translation STRING, refrain STRUCT<translation: STRING>")
    path = str(tmp_path / "shards")
    first = {r.item_id: r for r in passes.run_in_batches(items, annotate, "stub", path).collect()}
    assert len(first) == 20 and {i for i, r in first.items() if r.error} == {13}
    assert all(r.tags == ["t"] for i, r in first.items() if i != 13)
    # A later run asks for the failed item alone, and its answer takes the place of the error row.
    asked = lambda requests: json.dumps({"results": [{"primary_theme": "x", "tags": ["late"]}] * len(requests)})
    again = passes.run_in_batches(items, asked, "stub", path).collect()
    assert len(again) == 20 and [r.item_id for r in again if r.tags == ["late"]] == [13]
    assert not any(r.error for r in again)
