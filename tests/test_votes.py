from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.operators import audit, consensus, taxonomy, validate

ANN = "item_id BIGINT, annotator STRING, tags ARRAY<STRING>, theme STRING, mood STRING, summary STRING, error STRING"
SYN = [(0, "Prem", "Devotional Love"), (1, "Prem", "Love"), (2, "Bhakti", "Devotional Love"), (3, "Naam", None), (4, "_comment", "Love")]


def ann(spark, *rows):
    return spark.createDataFrame([(i, a, t, th, None, None, e) for i, a, t, th, e in rows], ANN)


def syn(spark):
    return spark.createDataFrame(SYN, schemas.SYNONYMS)


def test_last_listed_canonical_wins(spark):
    got = {r.raw_key: (r.key, r.surface) for r in consensus.synonym_map(syn(spark)).collect()}
    assert got["devotionallove"] == ("bhakti", "Bhakti")
    assert got["love"] == ("prem", "Prem")
    assert got["naam"] == ("naam", "Naam")
    assert "comment" not in got
    conflicts = consensus.synonym_conflicts(syn(spark).filter("ordinal < 4")).collect()
    assert [(c.raw_key, c.canonicals) for c in conflicts] == [("devotionallove", ["Bhakti", "Prem"])]


def test_each_annotator_counts_once_per_folded_key(spark):
    rows = ann(
        spark,
        (1, "a", ["Love", "LOVE!", "prem"], None, None),
        (1, "b", ["love", "Joy", "॥"], None, None),
        (1, "c", ["joy-", " "], None, None),
    )
    got = {r.key: r for r in consensus.votes(rows, syn(spark)).collect()}
    assert got["prem"].votes == 2 and got["prem"].tag == "Prem" and got["prem"].voters == ["a", "b"]
    assert got["joy"].votes == 2 and got["joy"].tag == "Joy"  # first form seen in annotator order
    assert set(got) == {"prem", "joy"}
    by_lineup = {r.key: r for r in consensus.votes(rows, syn(spark), ["c", "b"]).collect()}
    assert by_lineup["joy"].tag == "joy-" and by_lineup["prem"].votes == 1


def test_gate_counts_empty_answers_and_passing_items_may_end_empty(spark):
    rows = ann(spark, (1, "a", ["x"], None, None), (1, "b", [], None, None), (2, "a", ["x"], None, None), (3, "a", None, None, "e"), (3, "b", ["x"], None, None))
    got = {r.item_id: r.tags for r in consensus.consensus(rows, syn(spark)).collect()}
    assert got == {1: []}


def test_consensus_is_monotone_in_min_votes_and_ordered(spark):
    rows = ann(spark, *[(1, a, t, None, None) for a, t in (("a", ["x", "y", "z"]), ("b", ["y", "x"]), ("c", ["y"]))])
    by_votes = {n: consensus.consensus(rows, syn(spark), n).first().tags for n in (1, 2, 3)}
    assert by_votes == {1: ["y", "x", "z"], 2: ["y", "x"], 3: ["y"]}


def test_preferred_fields_come_from_one_annotator(spark):
    rows = spark.createDataFrame(
        [(1, "a", [], "", "m-a", "s-a", None), (1, "b", [], "t-b", None, "s-b", None), (1, "z", [], "t-z", "m", "s", None)], ANN
    )
    row = consensus.preferred_annotation(rows, ("a", "b")).first()
    assert (row.annotator, row.theme, row.mood, row.summary) == ("b", "t-b", None, "s-b")


def test_run_keeps_items_below_the_gate(spark):
    items = spark.createDataFrame(
        [(1, ["old"], "src", "t", "m", "s"), (2, ["old"], "src", "t", "m", "s")],
        "item_id BIGINT, tags ARRAY<STRING>, tags_source STRING, theme STRING, mood STRING, summary STRING",
    )
    rows = ann(spark, (1, "a", ["x"], "new", None), (1, "b", ["x"], None, None), (2, "a", ["x"], "new", None))
    got = {r.item_id: r for r in consensus.run_consensus(items, rows, syn(spark), ("a",)).collect()}
    assert got[1].tags == ["x"] and got[1].theme == "new" and got[1].mood is None
    assert got[2].tags == ["old"] and got[2].theme == "t" and got[2].tags_source == "src"


def test_coverage_and_singletons(spark):
    rows = ann(spark, (1, "a", ["Joy"], None, None), (2, "a", [" joy"], None, None), (1, "b", ["Sorrow", "JOY"], None, None), (2, "b", ["Sorrow"], None, "half"), (3, "b", None, None, "x"))
    cov = {r.annotator: (r.with_tags, r.ok, r.errors) for r in consensus.annotator_coverage(rows).collect()}
    assert cov == {"a": (2, 2, 0), "b": (2, 1, 2)}
    assert [(r.tag, r.n_items) for r in consensus.singleton_tags(rows).collect()] == [("sorrow", 2)]


# ---- validation ------------------------------------------------------------------------------

ITEMS = "item_id BIGINT, tags ARRAY<STRING>, theme STRING"


def scores(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.TAG_SCORES)


def test_bad_scores_reset_alone_or_together(spark):
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "item_id BIGINT, tag STRING")
    s = scores(spark, (1, "a", {"x": "bad", "y": "2"}, []), (1, "b", {"x": "1", "y": "1"}, []))
    def got(reset):
        return {(r.item_id, r.tag): (r.score_a, r.score_b) for r in validate.align_scores(tags, s, "a", "b", reset).collect()}

    assert got(False) == {(1, "x"): (3, 1), (1, "y"): (2, 1), (2, "x"): (3, 3)}
    assert got(True) == {(1, "x"): (3, 3), (1, "y"): (2, 1), (2, "x"): (3, 3)}


def test_removed_tag_can_return_and_counters_add_up(spark):
    items = spark.createDataFrame([(1, ["weak", "fine", "odd"], "t"), (2, [], "t")], ITEMS)
    s = scores(
        spark,
        (1, "a", {"weak": "1", "odd": "5"}, ["weak", "new", "alien", "fine"]), (1, "b", {"weak": "2", "odd": "1"}, ["weak", "new", "alien", "fine"]),
        (2, "a", {}, ["new"]), (2, "b", {}, ["new"]),
    )
    vocab = spark.createDataFrame([("weak",), ("new",), ("fine",)], "tag STRING")
    changes = validate.validate(items, s, vocab, "a", "b")
    got = sorted((r.item_id, r.tag, r.action) for r in changes.collect())
    assert got == [(1, "fine", "kept"), (1, "new", "added"), (1, "odd", "flagged"), (1, "weak", "added"), (1, "weak", "removed")]
    stats = {r.metric: r.value for r in validate.change_stats(changes).collect()}
    assert stats["total"] == stats["kept"] + stats["removed"] + stats["flagged"] == 3
    assert validate.tags_after(changes).first().tags == ["fine", "new", "odd", "weak"]


def test_sampled_rules(spark):
    items = spark.createDataFrame([(i, ["w", "k"], "about w" if i == 9 else "t") for i in range(1, 10)], ITEMS)
    sample = items.filter("item_id <= 4")
    rows = []
    for i in range(1, 5):
        weak = {"w": "1" if i < 4 else "5", "k": "4"}
        rows += [(i, "a", weak, ["extra"]), (i, "b", weak, ["extra"])]
    out = validate.validate_sampled(items, sample, scores(spark, *rows), "a", "b")
    got = {(r.item_id, r.tag): (r.action, r.rule) for r in out.collect()}
    assert got[(1, "w")] == ("removed", "own_scores")
    assert got[(4, "w")] == ("kept", None)  # own scores beat the global rule
    assert got[(6, "w")] == ("removed", "global_weak")
    assert got[(9, "w")] == ("kept", None)  # the tag is part of the theme
    assert got[(6, "extra")] == ("added", "suggested")  # not checked against a vocabulary
    assert (9, "extra") not in got


# ---- taxonomy and audit ----------------------------------------------------------------------


def test_alias_tagging(spark):
    vocab = spark.createDataFrame(
        [("A", "theme", 1, ["Love ", "joy"]), ("B", "theme", 2, ["love"]), ("M", "mood", 1, ["calm"]), ("N", "mood", 2, ["Calm"])],
        "tag STRING, kind STRING, ordinal INT, raw_values ARRAY<STRING>",
    )
    items = spark.createDataFrame(
        [(1, " LOVE", "calm", None, None), (2, "nothing", None, [], None), (3, None, "calm", ["kept"], "x"), (4, "x", "y", ["own"], "x")],
        "item_id BIGINT, theme STRING, mood STRING, tags ARRAY<STRING>, tags_source STRING",
    )
    tagged, unmatched = taxonomy.tag_by_alias(items, vocab)
    assert {r.item_id: (r.tags, r.tags_source) for r in tagged.collect()} == {
        1: (["A", "B", "N"], "alias"), 3: (["kept"], "x"), 4: (["own"], "x"),
    }
    assert [r.item_id for r in unmatched.collect()] == [2]
    over, _ = taxonomy.tag_by_alias(items, vocab, overwrite=True)
    assert {r.item_id: r.tags for r in over.collect()}[3] == ["N"]


def test_clusters_merge_and_disagree(spark):
    batches = spark.createDataFrame(
        [(2, "T", "late", "", ["b", "c"]), (1, "T", "early", "", ["a", "b"])],
        "batch INT, tag STRING, description STRING, native_term STRING, raw_values ARRAY<STRING>",
    )
    tags, mapping = taxonomy.merge_clusters(batches)
    assert tags.first().description == "early"
    assert sorted(r.value for r in mapping.collect()) == ["a", "b", "c"]
    a = spark.createDataFrame([("v", "T"), ("w", "T"), ("x", "")], "value STRING, tag STRING")
    b = spark.createDataFrame([("v", "U"), ("w", "T"), ("x", "U")], "value STRING, tag STRING")
    dis = taxonomy.mapping_disagreements(a, b)
    assert [(r.value, r.tag_a, r.tag_b) for r in dis.collect()] == [("v", "T", "U")]
    rate = {r.metric: r.value for r in taxonomy.disagreement_rate(dis, a.select("value")).collect()}
    assert rate == {"disagreements": 1, "sampled": 3, "percent": 33}


def test_sample_is_stable_under_repartitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "item_id")
    def ids(d):
        return [r.item_id for r in audit.sample_n(d, 25).collect()]

    assert ids(df.repartition(7)) == ids(df.coalesce(1))


def test_family_flips_and_diff(spark):
    schema = "item_id BIGINT, tags ARRAY<STRING>, theme STRING"
    pre = spark.createDataFrame([(1, ["Hukam"], "t"), (2, ["a"], "t")], schema)
    post = spark.createDataFrame([(1, ["b"], "t"), (2, ["Divine Will"], "t"), (3, ["the hukam of"], "t"), (4, None, "t")], schema)
    assert sorted(r.item_id for r in audit.family_flips(pre, post).collect()) == [1, 2, 3]
    diff = {(r.tag, r.change) for r in audit.taxonomy_diff(pre, post).collect()}
    assert diff == {("Hukam", "dropped"), ("a", "dropped"), ("b", "added"), ("Divine Will", "added"), ("the hukam of", "added")}


def test_votes_use_one_layout_of_the_annotations(spark):
    rows = [(i, a, ["Peace", f"tag {i % 3}"]) for i in range(30) for a in "abc"]
    annotations = spark.createDataFrame(rows, "item_id BIGINT, annotator STRING, tags ARRAY<STRING>")
    synonyms = spark.createDataFrame([(0, "Calm", "Peace")], schemas.SYNONYMS)
    agreed = consensus.consensus(annotations, synonyms)
    assert all(r.tags == ["Calm", f"tag {r.item_id % 3}"] for r in agreed.collect())
    plan = agreed._jdf.queryExecution().sparkPlan().toString() + agreed._jdf.queryExecution().executedPlan().toString()
    by_item = [line for line in plan.splitlines() if "Exchange hashpartitioning(item_id" in line or "REPARTITION" in line]
    assert len({line.split("plan_id")[0].strip() for line in by_item}) <= 2, by_item


def test_many_synonyms_are_not_broadcast(spark, monkeypatch):
    rows = [(1, "a", ["x", "!"]), (1, "b", ["X"]), (2, "a", ["x"]), (3, "a", []), (3, "b", ["..."]), (4, "a", None)]
    annotations = spark.createDataFrame(rows, "item_id BIGINT, annotator STRING, tags ARRAY<STRING>")
    synonyms = spark.createDataFrame([(0, "Sum", "x")], schemas.SYNONYMS)
    want = {1: ["Sum"], 3: []}
    assert {r.item_id: r.tags for r in consensus.consensus(annotations, synonyms).collect()} == want
    monkeypatch.setattr(consensus, "SYNONYM_ROWS", 0)
    assert {r.item_id: r.tags for r in consensus.consensus(annotations, synonyms).collect()} == want
