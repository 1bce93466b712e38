import pytest
from pyspark.sql import functions as F

from tagweave.functions import scores as S
from tagweave.functions import text as X


@pytest.mark.parametrize(
    "raw,key",
    [("Naam Simran", "naamsimran"), ("naam-simran", "naamsimran"), ("  God's  Name ", "godsname"), ("॥", "")],
)
def test_normalize_tag(value, raw, key):
    assert value(X.normalize_tag(F.col("x")), row=(raw,)) == key


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("ਕੇਵਡੁ ਚੀਰਾ ੧", "ਕੇਵਡੁ ਚੀਰਾ"),
        ("ਬਲਿ ਜਾਉ ਜੀਉ ॥੧॥", "ਬਲਿ ਜਾਉ ਜੀਉ"),
        ("ਬਲਿ ਜਾਉ ਜੀਉ ॥੨੮॥ ", "ਬਲਿ ਜਾਉ ਜੀਉ"),
        ("ਮਃ ੫ ॥", "ਮਃ ੫ ॥"),
        ("ਅਅ ॥੧॥", "ਅਅ ॥੧॥"),
        ("ਕੇਵਡੁ ਚੀਰਾ ੧ ॥", "ਕੇਵਡੁ ਚੀਰਾ"),
        ("plain text", "plain text"),
    ],
)
def test_strip_trailing_number(value, raw, expected):
    assert value(X.strip_trailing_number(F.col("x")), row=(raw,)) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [("Naam (live) Simran 2", "naam  simran"), ("(x) Only", "only"), ("123", "")],
)
def test_clean_title(value, raw, expected):
    assert value(X.clean_title(F.col("x")), row=(raw,)) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [("Teraa Naam", "tera nam"), ("meeraa", "mira"), ("hukam  paae", "hukam pae"), ("gaunn", "gon"), ("satt", "sat")],
)
def test_normalize_translit(value, raw, expected):
    assert value(X.normalize_translit(F.col("x")), row=(raw,)) == expected


def test_title_and_heading_predicates(value):
    def check(f, text):
        return value(f(F.col("x")), row=(text,))

    assert check(X.is_title_line, " Aasaa Mahalaa 5 ")
    assert check(X.is_title_line, "abc")
    assert not check(X.is_title_line, "tera naam")
    assert check(X.is_native_title_line, "ਆਸਾ ਮਹਲਾ ੫ ਘਰੁ")
    assert check(X.is_native_title_line, "ਅਬ ਤਬ ਕਬ ॥")
    assert not check(X.is_native_title_line, "ਤੇਰਾ ਨਾਮੁ ਕਰੀ ਚਨਣਾਠੀਆ ਜੇ ਮਨੁ")
    assert check(X.is_heading, "ਸਲੋਕੁ ॥")  # the delimiter is stripped on both sides
    assert check(X.is_heading, "ਰਾਗੁ ਗੂਜਰੀ ੫")
    assert not check(X.is_heading, "ਤੇਰਾ ਨਾਮੁ ਕਰੀ")
    assert check(X.is_boundary, "sukh paavai ||2|| ")
    assert not check(X.is_boundary, "||2|| then more")
    assert check(X.is_marker, "man mere ||1|| Rahaau ||")
    assert not check(X.is_marker, "rahaau alone")


def test_theme_bucket_takes_first_rule(value):
    assert value(X.theme_bucket(F.col("x")), row=("Divine Love and separation",)) == "devotion"
    assert value(X.theme_bucket(F.col("x")), row=("Nothing",)) == "other"


def test_keyboard_maps_one_key_to_two_characters(value):
    out = value(X.map_keyboard(F.col("x")), row=("hR kW1",))
    assert out == X.KEYBOARD_MAP["h"] + X.KEYBOARD_MAP["R"] + " " + X.KEYBOARD_MAP["k"] + X.KEYBOARD_MAP["W"] + "1"


def test_embed_texts_leave_out_missing_parts(value):
    none = F.lit(None).cast("string")
    text = X.embed_text_corpus(none, F.lit(" "), F.col("x"), none, F.lit("t" * 500))
    assert value(text, row=("sum",)) == "sum | " + "t" * 400
    assert value(X.embed_text_corpus(none, none, none, none, none)) == "Unknown item"
    themes = F.array(F.lit("a"), F.lit("b"))
    lib = X.embed_text_library(F.lit("T"), F.lit("x" * 600), F.lit("th"), themes, none, none)
    assert value(lib) == "T | " + "x" * 500 + " | Theme: th | Themes: a, b"


def test_keywords_use_two_stop_lists(value):
    out = value(X.seed_keywords(F.col("x"), F.lit("into the light")), row=("Into upon joy Grace",))
    assert sorted(out) == ["grace", "into", "light"]


def test_scores(value):
    three = "a ARRAY<STRING>, b ARRAY<STRING>"
    row = (["x", "y"], ["y", "z", "w"])
    assert value(S.jaccard(F.col("a"), F.col("b")), three, row) == pytest.approx(0.25)
    assert value(S.jaccard(F.col("a"), F.array().cast("array<string>")), three, row) == 0
    vecs = "a ARRAY<FLOAT>, b ARRAY<FLOAT>"
    assert value(S.cosine(F.col("a"), F.col("b")), vecs, ([3.0, 4.0], [6.0, 8.0])) == pytest.approx(1.0)
    assert value(S.cosine(F.col("a"), F.col("b")), vecs, ([3.0, 4.0], [0.0, 0.0])) == 0
    assert value(S.boost(F.lit(0.9), F.lit(True), F.lit(True))) == 1.0
    assert value(S.boost(F.lit(0.5), F.lit(None).cast("boolean"), F.lit(True))) == 0.5
    assert value(S.boost(F.lit(0.5), F.lit(True), F.lit(False))) == 0.5


def test_only_a_missing_distance_takes_the_default(value):
    none = F.lit(None).cast("double")
    assert value(S.distance_to_score(F.lit(0.0))) == 1.0
    assert value(S.distance_to_score(none)) == 0.5
    assert value(S.distance_to_score(F.lit(1.7))) == 0.0
    assert value(S.vector_connection_score(F.lit(0.0))) == 10.0
    assert value(S.vector_connection_score(F.lit(1.5))) == 1.0
    assert value(S.relevance(F.lit(1.5))) == -5.0
    assert value(S.relevance(none)) == 5.0


def test_display_scores_round_as_the_sql_does(value):
    # 0.345 * 10 and 0.335 * 10 lie a hair below 3.45 and 3.35 as doubles; SQL rounds ten times as much.
    assert value(S.vector_connection_score(F.lit(0.655))) == 3.5
    assert value(S.vector_connection_score(F.lit(0.665))) == 3.4
    assert value(S.relevance(F.lit(0.655))) == 3.5


def test_graph_connection_score(value):
    tags = F.array(F.lit("a"), F.lit("a"), F.lit("b"))
    assert value(S.graph_connection_score(F.lit(0.5), tags)) == 5.1
    assert value(S.graph_connection_score(F.lit(1.0), F.array(*[F.lit(c) for c in "abcde"]))) == 10.0
    assert value(S.connection_text(F.array(*[F.lit(c) for c in "abcde"]))) == "Connected through: a, b, c, d"


@pytest.mark.parametrize(
    "a,b,action", [(1, 2, "removed"), (2, 5, "flagged"), (3, 3, "kept"), (2, 3, "kept"), (1, 4, "flagged")]
)
def test_score_action(value, a, b, action):
    assert value(S.score_action(F.lit(a), F.lit(b))) == action
