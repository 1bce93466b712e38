import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tagweave import scale, schemas
from tagweave.functions import text as X
from tagweave.operators import corpus


def lines(spark, *rows):
    """Rows (item, line_no, translit, body, translation)."""
    full = [(i, 1, n, "cat", "auth", b, t, e) for i, n, t, b, e in rows]
    return spark.createDataFrame(full, schemas.LINES)


def test_refrain_starts_after_the_last_boundary_or_title(spark):
    df = lines(
        spark,
        (1, 0, "aasaa mahalaa 5", "T", ""), (1, 1, "first line", "one", "e1"), (1, 2, "second ||1||", "two", "e2"),
        (1, 3, "third line", "three", ""), (1, 4, "fourth ||1|| rahaau ||", "four", "e4"), (1, 5, "fifth ||2|| rahaau ||", "five", "e5"),
        (2, 0, "only line", "a", "x"), (2, 1, "end || rahaau ||", "", "y"),
        (3, 0, "no marker at all", "a", "x"),
        (4, 0, "end || rahaau ||", "", "y"),
    )
    got = {r.item_id: (r.body, r.translation, r.start, r.end) for r in corpus.refrain_spans(df).collect()}
    assert got == {1: ("three\nfour", "e4", 3, 4), 2: ("a", "x y", 0, 1)}


def test_marker_word_and_pattern_differ(spark):
    df = lines(spark, (1, 0, "plain Rahaau", "a", "t0"), (1, 1, "x || rahaau ||", "b", "t1"))
    marked = corpus.mark_lines(df).orderBy("line_no").collect()
    assert [(r.is_marker, r.marker_index) for r in marked] == [(True, 0), (True, 0)]
    assert corpus.pick_seed_line(corpus.mark_lines(df)).first().seed_line == "t0"
    assert corpus.refrain_spans(df).first().end == 1


def test_items_without_marker_get_minus_one(spark):
    df = lines(spark, (1, 0, "a", "a", ""))
    assert corpus.mark_lines(df).first().marker_index == -1


def test_assembly_takes_first_line_and_skips_empty_parts(spark):
    df = spark.createDataFrame(
        [(1, 2, 1, "late", "x", "b1", "", "e1"), (1, 1, 0, "first", "y", "b0", "t0", ""), (1, 2, 2, "late", "x", "", "t2", "e2")], schemas.LINES
    )
    r = corpus.assemble_items(df).first()
    assert (r.page, r.category, r.author) == (1, "first", "y")
    assert (r.translit, r.translation, r.body) == ("t0 t2", "e1 e2", "b0\nb1")


def test_very_long_item_is_joined_in_order_and_spread(spark):
    n = 3 * scale.CHUNK_LINES
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("item_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("line_no"),
        F.lit("c").alias("category"), F.lit("a").alias("author"), F.col("id").cast("string").alias("body"),
        F.when(F.col("id") == n - 1, "|| rahaau ||").otherwise("some line").alias("translit"), F.lit("").alias("translation"),
    ).repartition(5)
    assert corpus.assemble_items(df).first().body.split("\n") == [str(i) for i in range(n)]
    span = corpus.refrain_spans(df).first()
    assert (span.start, span.end) == (0, n - 1) and span.body.count("\n") == n - 1
    assert corpus.mark_lines(df).filter(f"marker_index <> {n - 1}").count() == 0


def test_pages_flatten_tolerantly(spark):
    payload = {
        "page": [
            {"shabadId": 7, "verse": {"unicode": "v"}, "transliteration": {"en": "t"}, "translation": {"en": {"bdb": "", "ms": "m", "ssk": "s"}}, "raag": {"english": "r"}},
            {"shabadId": None, "verse": {"unicode": "dropped"}},
            {"shabadId": 7, "verse": "odd", "translation": {"en": "odd"}},
        ]
    }
    pages = spark.createDataFrame([(2, json.dumps(payload)), (1, json.dumps({"page": [{"shabadId": 7}]})), (3, "{}")], "page INT, payload STRING")
    got = [(r.line_no, r.page, r.body, r.translit, r.translation, r.category) for r in corpus.flatten_pages(pages).orderBy("line_no").collect()]
    assert got == [(0, 1, "", "", "", ""), (1, 2, "v", "t", "m", "r"), (2, 2, "", "", "", "")]


def test_content_lines_and_display_repair(spark):
    content = "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ ॥੧॥"
    df = lines(spark, (1, 0, "", "ੴ ਸਤਿਗੁਰ ਪ੍ਰਸਾਦਿ ॥", ""), (1, 1, "", "ਰਾਗੁ ਗੂਜਰੀ", ""), (1, 2, "", "", ""), (1, 3, "", content, ""))
    firsts = corpus.first_content_line(df)
    assert firsts.first().line == "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ"
    items = spark.createDataFrame(
        [(1, "ੴ ਸਤਿਗੁਰ ਪ੍ਰਸਾਦਿ ॥"), (2, "ਕੇਵਡੁ ਚੀਰਾ ੧"), (3, "ਕੇਵਡੁ ਚੀਰਾ")], "item_id BIGINT, display STRING"
    )
    fixed = corpus.repair_generic_display(items, firsts)
    assert {r.item_id: r.display for r in fixed.collect()} == {1: "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ", 2: "ਕੇਵਡੁ ਚੀਰਾ", 3: "ਕੇਵਡੁ ਚੀਰਾ"}
    counts = {r.metric: r.value for r in corpus.repair_counts(items, fixed).collect()}
    assert counts == {"changed": 2, "unchanged": 1}  # item 1 was fixed twice, counted once


def test_numbers_of_prose_stay_in_content_lines(spark):
    from tagweave.plans import corpora

    lines_of = {1: "Licensed under CC BY-NC 4.0.", 2: "Et.\nGNU General Public License, version 3.", 3: "A line of prose 12 "}
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in lines_of.items()], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    with tempfile.TemporaryDirectory() as sf:
        docs.write.parquet(f"{sf}/documents.parquet")
        got = {r.item_id: r.line for r in corpora.first_content_line(spark, sf).collect()}
    assert got == {i: t.split("\n")[-1].strip() for i, t in lines_of.items()}


def test_title_display_prefers_the_refrain(spark):
    items = spark.createDataFrame([(1, "ਆਸਾ ਮਹਲਾ ੫"), (2, "ਆਸਾ ਮਹਲਾ ੫"), (3, "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ")], "item_id BIGINT, display STRING")
    spans = spark.createDataFrame([(1, "ਮਨ ਮੇਰੇ ਸੁਖ ਸਹਜ ਸੇਤੀ\nx"), (2, "ਆਸਾ\ny")], "item_id BIGINT, body STRING")
    untitled = spark.createDataFrame([(1, "unused line"), (2, "ਜਿਸੁ ਸਿਮਰਤ ਦੁਖੁ ਜਾਇ ਸਭ")], "item_id BIGINT, line STRING")
    got = {r.item_id: r.display for r in corpus.repair_title_display(items, spans, untitled).collect()}
    assert got == {1: "ਮਨ ਮੇਰੇ ਸੁਖ ਸਹਜ ਸੇਤੀ", 2: "ਜਿਸੁ ਸਿਮਰਤ ਦੁਖੁ ਜਾਇ ਸਭ", 3: "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ"}


def test_positions_do_not_depend_on_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    def numbered(bucket):
        return {(r.k, r.v): r.pos for r in scale.positions(df, ["k"], bucket, [F.asc("v")]).collect()}

    assert numbered(F.floor(F.col("v") / 50)) == numbered(F.lit(0))


@pytest.mark.parametrize("text,expected", [("Tera Naam  karee", "tnk"), ("  x", "x"), ("", "")])
def test_initials(value, text, expected):
    assert value(X.initials(F.col("x")), row=(text,)) == expected
