"""String, tag-array and line-predicate column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------
# Word lists, patterns and maps that must equal the published behaviour for equal results.

MARKER_TAG = "Repertoire"

DELIMITER = "॥"
NATIVE_DIGITS = "੦੧੨੩੪੫੬੭੮੯"

BOUNDARY_PATTERN = r"\|\|\d+\|\|\s*$"
MARKER_PATTERN = r"\|\|.*rahaau.*\|\|"
MARKER_WORD = "rahaau"

TITLE_PREFIXES = (
    "raag", "siree", "aasaa", "soohee", "bilaaval", "gauree", "dhanaasaree", "todee",
    "bairaaree", "tilang", "sorath", "maajh", "vaddhans", "jaitsaree", "kedhaaraa", "bhairo",
    "basant", "maaroo", "malaar", "kaanarre", "prabhaatee", "salok", "mahalaa", "goojaree",
    "raamkalee", "nat", "maalee gaurraa", "gond", "tukhaari", "suhi", "devagadharee",
    "devagandharee", "wadhahas", "wadhahans", "saarang", "nut", "aasaavaree", "kaliyaan",
    "bihaagraa", "jap", "so dhar", "so purakh",
)

NATIVE_TITLE_PREFIXES = (
    "ਸਿਰੀਰਾਗ", "ਆਸਾ", "ਗਉੜੀ", "ਸੂਹੀ", "ਬਿਲਾਵਲ", "ਧਨਾਸਰੀ", "ਟੋਡੀ", "ਬੈਰਾੜੀ", "ਤਿਲੰਗ",
    "ਸੋਰਠਿ", "ਮਾਝ", "ਵਡਹੰਸ", "ਜੈਤਸਰੀ", "ਕੇਦਾਰਾ", "ਭੈਰਉ", "ਬਸੰਤ", "ਮਾਰੂ", "ਮਲਾਰ",
    "ਕਾਨੜਾ", "ਪ੍ਰਭਾਤੀ", "ਸਲੋਕ", "ਮਹਲਾ", "ਗੂਜਰੀ", "ਰਾਮਕਲੀ", "ਨਟ", "ਮਾਲੀ ਗਉੜਾ",
    "ਗੋਂਡ", "ਟੁਖਾਰੀ", "ਦੇਵਗੰਧਾਰੀ", "ਸਾਰੰਗ", "ਨੁਟ", "ਆਸਾਵਰੀ", "ਕਲਿਆਣ", "ਬਿਹਾਗੜਾ",
    "ਰਾਗੁ", "ਵਾਰ", "ਛੰਤ", "ਪਉੜੀ", "ਅਸਟਪਦੀ", "ਚਉਪਦੇ", "ਘਰੁ", "ਇਕੋਅੰਕਾਰ",
    "॥ ਜਪੁ ॥", "ਸੋ ਦਰੁ ਰਾਗੁ", "ਸੋ ਪੁਰਖੁ ਰਾਗੁ", "ਡਖਣਾ", "ਪਵੜੀ", "ਦੋਹਰਾ", "ਸਵੱਯੇ", "ਕਬਿੱਤ",
)
NATIVE_NUMBERED_TITLE = r"^(ਮਹਲਾ|ਮਃ)\s*[੧੨੩੪੫੬੭੮੯]"

SKIP_LINES = (
    "ੴ ਸਤਿਗੁਰ ਪ੍ਰਸਾਦਿ ॥", "ੴ ਸਤਿਗੁਰ ਪ੍ਰਸਾਦਿ ।।", "॥", "ਸਲੋਕੁ ॥", "ਸਲੋਕ ॥", "ਪਉੜੀ ॥",
    "ਡਖਣਾ ॥", "ਡਖਣੇ ॥", "ਛੰਤ ॥",
)
INVOCATION_PREFIX = "ੴ "
HEADING_WORDS = ("ਰਾਗੁ", "ਰਾਗ", "ਮਹਲਾ", "ਮਃ", "ਘਰੁ", "ਵਾਰ", "ਕੀ", "ਕੇ")

THEME_STOP_WORDS = ("with", "from", "that", "this", "than", "into", "upon")
MOOD_STOP_WORDS = ("with", "from", "that", "this")

THEME_GROUPS = (
    ("devotion", ("devotion", "prem", "love")),
    ("longing", ("birha", "longing", "separation")),
    ("wonder", ("vismad", "awe", "wonder")),
    ("peace", ("shanti", "peace", "calm")),
    ("grace", ("grace", "kirpa", "nadar")),
    ("world", ("maya", "attachment", "world")),
    ("joy", ("anand", "joy", "celeb")),
    ("will", ("hukam", "will", "command")),
    ("surrender", ("surrender", "humility")),
)

KEYBOARD_MAP = {
    "a": "ੳ", "A": "ਅ", "e": "ੲ", "s": "ਸ", "h": "ਹ", "k": "ਕ", "K": "ਖ", "g": "ਗ", "G": "ਘ",
    "|": "ਙ", "c": "ਚ", "C": "ਛ", "j": "ਜ", "J": "ਝ", "\\": "ਞ", "t": "ਟ", "T": "ਠ", "f": "ਡ",
    "F": "ਢ", "x": "ਣ", "q": "ਤ", "Q": "ਥ", "d": "ਦ", "D": "ਧ", "n": "ਨ", "p": "ਪ", "P": "ਫ",
    "b": "ਬ", "B": "ਭ", "m": "ਮ", "X": "ਯ", "r": "ਰ", "l": "ਲ", "v": "ਵ", "V": "ੜ", "S": "ਸ਼",
    "^": "ਖ਼", "Z": "ਗ਼", "z": "ਜ਼", "&": "ਫ਼", "L": "ਲ਼", "w": "ਾ", "W": "ਾਂ", "i": "ਿ", "I": "ੀ",
    "u": "ੁ", "U": "ੂ", "y": "ੇ", "Y": "ੈ", "o": "ੋ", "O": "ੌ", "M": "ੰ", "N": "ਂ", "~": "ੱ",
    "`": "ੱ", "R": "੍ਰ", "H": "੍ਹ", "E": "ਓ",
}
# ---- end of fixed values ------------------------------------------------------------------


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end; Spark's trim removes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Empty and whitespace-only strings count as missing."""
    return F.nullif(strip(c), F.lit(""))


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_tag(c: Column) -> Column:
    """Comparison key of a tag: lowercase, letters a–z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def value_key(c: Column) -> Column:
    """Lower-trim key used for raw theme and mood strings."""
    return strip(F.lower(c))


def connector_tags(tags: Column, marker: str = MARKER_TAG) -> Column:
    """Distinct tags without the marker tag."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    return F.array_except(tags, F.array(F.lit(marker)))


def shared_tags(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def new_tags(mine: Column, theirs: Column) -> Column:
    return F.sort_array(F.array_except(theirs, mine))


def combined_tags(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def display_title(name: Column, translit: Column) -> Column:
    """Display name, else the first 80 characters of the transliteration."""
    return F.coalesce(blank_to_null(name), F.substring(F.coalesce(translit, F.lit("")), 1, 80))


def first_body_line(body: Column) -> Column:
    return strip(F.split(F.coalesce(body, F.lit("")), "\n").getItem(0))


def clean_title(c: Column) -> Column:
    """Drop parenthesised parts, keep letters and whitespace, trim, lowercase."""
    no_parens = F.regexp_replace(c, r"\(.*?\)", "")
    return F.lower(strip(F.regexp_replace(no_parens, r"[^a-zA-Z\s]", "")))


def normalize_translit(c: Column) -> Column:
    """Fold long vowels, diphthongs and doubled letters; the order of the steps matters."""
    t = strip(F.lower(F.regexp_replace(c, r"[^a-zA-Z\s]", "")))
    for pattern, repl in (
        ("aa+", "a"), ("ee+", "i"), ("oo+", "u"), ("ai", "e"), ("au", "o"),
        (r"(.)\1+", "$1"), (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, repl)
    return strip(t)


def strip_trailing_number(c: Column, delimiter: str = DELIMITER, digits: str = NATIVE_DIGITS) -> Column:
    """Drop a delimiter-wrapped, then a bare, trailing line number.

    Each step applies only when more than five characters stay in front of it.
    """
    d, n = re.escape(delimiter), f"[{digits}]+"
    text = strip(c)
    text = F.regexp_replace(text, rf"(?s)^(.{{5,}}\S)\s*{d}{n}{d}\s*$", "$1")
    bare = rf"(?s)^(.{{5,}}\S)\s+{n}\s*[ {d}]*$"
    body = F.regexp_replace(F.regexp_replace(text, bare, "$1"), rf"\s*[ {d}]*$", "")
    return F.when(text.rlike(bare), body).otherwise(text)


def _starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    return c.rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")")


def is_title_line(c: Column, prefixes: Sequence[str] = TITLE_PREFIXES) -> Column:
    """Section titles (Latin script) and lines shorter than five characters."""
    clean = F.lower(strip(c))
    return _starts_with_any(clean, prefixes) | (F.length(clean) < 5)


def is_native_title_line(c: Column, prefixes: Sequence[str] = NATIVE_TITLE_PREFIXES) -> Column:
    """Section titles in the native script, and short delimiter-marked lines."""
    clean = strip(c)
    return (
        (F.length(clean) < 5)
        | _starts_with_any(clean, prefixes)
        | clean.rlike(NATIVE_NUMBERED_TITLE)
        | ((F.length(clean) < 15) & clean.contains(DELIMITER))
    )


def _bare(text: str, delimiter: str) -> str:
    return text.rstrip(" " + delimiter).rstrip()


def is_heading(
    c: Column,
    skip_lines: Sequence[str] = SKIP_LINES,
    heading_words: Sequence[str] = HEADING_WORDS,
    delimiter: str = DELIMITER,
) -> Column:
    """Form headings: a skip-list line, or a short line with a heading word among its first six.

    Both sides of the skip-list test lose their trailing delimiter before they are compared.
    """
    d = re.escape(delimiter)
    clean = F.regexp_replace(strip(c), rf"\s*[ {d}]*$", "")
    bare_skips = sorted({_bare(s, delimiter) for s in skip_lines})
    first_words = F.slice(F.split(clean, r"\s+"), 1, 6)
    listed = F.array(*[F.lit(w) for w in heading_words])
    return clean.isin(bare_skips) | (
        (F.length(clean) < 50) & F.arrays_overlap(first_words, listed)
    )


def is_boundary(c: Column, pattern: str = BOUNDARY_PATTERN) -> Column:
    """The line closes a numbered section."""
    return c.rlike(pattern)


def is_marker(c: Column, pattern: str = MARKER_PATTERN) -> Column:
    """The line carries the refrain marker between delimiters."""
    return F.lower(c).rlike(pattern)


def contains_marker(c: Column, word: str = MARKER_WORD) -> Column:
    """The looser marker test of the line view: plain substring."""
    return F.lower(c).contains(word)


def theme_bucket(theme: Column, default: str = "other") -> Column:
    """Theme group by ordered substring rules; the first matching rule wins."""
    t = F.lower(theme)
    rule = None
    for group, needles in THEME_GROUPS:
        hit = reduce(lambda a, b: a | b, [t.contains(n) for n in needles])
        rule = F.when(hit, group) if rule is None else rule.when(hit, group)
    return rule.otherwise(default)


def map_keyboard(c: Column, table: dict[str, str] | None = None) -> Column:
    """Keyboard keys to native script, key by key; unmapped characters stay."""
    table = KEYBOARD_MAP if table is None else table
    for key, value in table.items():
        if len(value) != 1:
            c = F.replace(c, F.lit(key), F.lit(value))
    single = {k: v for k, v in table.items() if len(v) == 1}
    return F.translate(c, "".join(single), "".join(single.values()))


def initials(c: Column) -> Column:
    """First letters of the words of a line, lowercase, without spaces."""
    words = F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def word_array(c: Column) -> Column:
    """Lowercase words of a text, split on anything that is not a letter or digit."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def embed_text_library(
    title: Column, translation: Column, theme: Column, themes: Column, mood: Column, summary: Column
) -> Column:
    """Embedding text of a library record; missing parts are left out."""
    joined = F.array_join(themes, ", ")
    return F.concat_ws(
        " | ",
        title,
        F.substring(blank_to_null(translation), 1, 500),
        F.concat(F.lit("Theme: "), blank_to_null(theme)),
        F.concat(F.lit("Themes: "), blank_to_null(joined)),
        F.concat(F.lit("Mood: "), blank_to_null(mood)),
        blank_to_null(summary),
    )


def embed_text_corpus(
    theme: Column, mood: Column, summary: Column, refrain: Column, translation: Column,
    empty: str = "Unknown item",
) -> Column:
    """Embedding text of a corpus item.

    Leaves out transliteration, category and author on purpose: they would make vectors cluster
    by form instead of by theme.
    """
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Theme: "), blank_to_null(theme)),
        F.concat(F.lit("Mood: "), blank_to_null(mood)),
        blank_to_null(summary),
        F.concat(F.lit("Core verse: "), blank_to_null(refrain)),
        F.substring(blank_to_null(translation), 1, 400),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def keyword_array(text: Column, stop_words: Sequence[str]) -> Column:
    """Distinct lowercase words longer than three characters, without stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 3), stops)


def seed_keywords(theme: Column, mood: Column) -> Column:
    """Search keywords of a seed from its theme and mood, each with its own stop list."""
    return F.array_union(
        keyword_array(theme, THEME_STOP_WORDS), keyword_array(mood, MOOD_STOP_WORDS)
    )

