from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from tagweave.llm import mixing, private_data, quality_rules
from tagweave.llm.queries import QUERIES
from tests.llm.conftest import ODD
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_queries_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = C.keep_good(spark, docs, SF)
    kept = {r["doc_id"] for r in quality_rules.judged(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == columns

    single = C.drop_near_copies(spark, docs, SF)
    heads = {c for _, n, c in brute(sorted(rows.items()), 5, 80, 100)}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(heads) and single.columns == columns

    hidden = C.hide_private_data(spark, docs, SF)
    potentials = private_data.learn(docs)
    assert hidden.schema == docs.schema
    for r in hidden.collect():
        assert r["text"] == private_data.redacted_text(rows[r["doc_id"]], potentials)
        assert r["n_chars"] == len(r["text"]) and not private_data.base_spans(r["text"])

    taken = Counter(r["doc_id"] for r in C.mix_sources(spark, docs, SF).collect())
    report = mixing.mix_report(docs).collect()
    assert taken == Counter({r["doc_id"]: r["taken"] // r["size"] for r in report if r["taken"]})

    pieces = C.encode(spark, docs, SF)
    assert pieces.where("NOT round_trip").count() == 0 and pieces.select("doc_id").distinct().count() == len(rows)


def test_stages_take_odd_rows(spark, documents):
    for rows in ([], ODD):
        docs = documents(rows)
        for _, stage in C.STAGES:
            stage(spark, docs, SF).collect()
    assert {r["doc_id"] for r in C.drop_near_copies(spark, documents(ODD), SF).collect()} == {1, 2, 3, 4, 5, 6, None}


def test_near_copies_keep_unlike_texts_of_one_id(spark, documents):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(7, t) for t in words] + [(7, words[0]), (8, words[1] + " x"), (6, words[2] + " x")]
    rows += [(None, words[3]), (None, "no id " + words[0][:40]), (None, "no id " + words[0][:40]), (None, None), (None, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in C.drop_near_copies(spark, documents(rows), SF).collect()), key=str)
    want = [(7, t) for i, t in enumerate(words) if i != 2] + [(6, words[2] + " x")]
    assert got == sorted([*want, (None, "no id " + words[0][:40]), (None, None), (None, None)], key=str)


def test_columns_of_clashing_names_stay(spark, documents):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y"), (None, "x y")]
    names = ["key", "_key", "_unnamed", "_id", "id", "hash1", "no_id", "times", "best", "grp", "node", "h1", "n_words"]
    docs = documents(rows).withColumns({c: F.lit("mine") for c in names})
    out = C.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["1", "None"]
    assert all(r[c] == "mine" for r in out.collect() for c in names)
    assert C.keep_good(spark, docs, SF).columns == docs.columns


def test_whole_run(spark):
    out = C.run(spark, SF)
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0
