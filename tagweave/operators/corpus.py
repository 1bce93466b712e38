"""Items assembled from lines, their refrains, and repaired display lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.functions import text as X
from tagweave.scale import attach_to_lines, chunk_of, metric_rows, positions

# Lengths used when a display line is repaired.
GENERIC_DISPLAY_MAX = 30
MIN_CONTENT_LENGTH = 8


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Line rows from page payloads (page INT, payload STRING with nested JSON).

    Missing or odd sub-objects become nulls; lines without an item id are dropped. ``line_no``
    counts the lines of an item in page order.
    """
    parsed = pages.select("page", F.from_json("payload", schemas.PAGE_PAYLOAD).alias("p"))
    rows = parsed.select("page", F.posexplode("p.page").alias("at", "v"))
    en = F.col("v.translation.en")
    flat = rows.select(
        F.col("v.shabadId").alias("item_id"),
        "page",
        "at",
        F.coalesce("v.raag.english", F.lit("")).alias("category"),
        F.coalesce("v.writer.english", F.lit("")).alias("author"),
        F.coalesce("v.verse.unicode", F.lit("")).alias("body"),
        F.coalesce("v.transliteration.en", F.lit("")).alias("translit"),
        pick_translation(en["bdb"], en["ms"], en["ssk"]).alias("translation"),
    ).filter(F.coalesce("item_id", F.lit(0)) != 0)
    return positions(flat, ["item_id"], F.col("page"), [F.asc("at")], "line_no").drop("at")


def pick_translation(*translators: Column) -> Column:
    """First non-empty translation, else an empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in translators], F.lit(""))


def join_lines(lines: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Join text columns of each item in line order; ``texts`` maps column to separator.

    Empty lines are skipped. Lines are first joined per chunk of line numbers, so one very long
    item is mostly joined in parallel before its chunks meet.
    """
    def ordered(c: str, by: str) -> Column:
        pairs = F.collect_list(F.when(F.col(c) != "", F.struct(F.col(by), F.col(c).alias("t"))))
        return F.transform(F.sort_array(pairs), lambda s: s["t"])

    parts = lines.groupBy("item_id", chunk_of(F.col("line_no")).alias("_chunk")).agg(
        *[F.array_join(ordered(c, "line_no"), sep).alias(c) for c, sep in texts.items()]
    )
    return parts.groupBy("item_id").agg(
        *[F.array_join(ordered(c, "_chunk"), sep).alias(c) for c, sep in texts.items()]
    )


def assemble_items(lines: DataFrame) -> DataFrame:
    """Items with the page, category and author of their first line and their joined texts."""
    first = F.min_by(F.struct("page", "category", "author"), "line_no")
    heads = lines.groupBy("item_id").agg(first.alias("f")).select("item_id", "f.*")
    texts = join_lines(lines, {"translit": " ", "translation": " ", "body": "\n"})
    return heads.join(texts, "item_id")


def first_marker(lines: DataFrame, marked: Column) -> DataFrame:
    """First marked line per item (null when there is none) and the item's last line."""
    return lines.groupBy("item_id").agg(
        F.min(F.when(marked, F.col("line_no"))).alias("marker"), F.max("line_no").alias("last_line")
    )


def mark_lines(lines: DataFrame, word: str = X.MARKER_WORD) -> DataFrame:
    """Line table with the plain marker test and the item's first marked line (−1 if none)."""
    marked = X.contains_marker(F.coalesce("translit", F.lit("")), word)
    joined = attach_to_lines(lines, first_marker(lines, marked), "last_line")
    return joined.withColumn("is_marker", marked).withColumn(
        "marker_index", F.coalesce("marker", F.lit(-1))
    ).drop("marker")


def pick_seed_line(marked: DataFrame) -> DataFrame:
    """Translation of each item's first marked line: the query text of a seed."""
    rows = marked.filter(F.col("line_no") == F.col("marker_index"))
    return rows.select("item_id", F.col("translation").alias("seed_line"))


def refrain_spans(
    lines: DataFrame,
    marker_pattern: str = X.MARKER_PATTERN,
    boundary_pattern: str = X.BOUNDARY_PATTERN,
    title_prefixes: Sequence[str] = X.TITLE_PREFIXES,
) -> DataFrame:
    """Refrain of each item: from after the last boundary or title before the marker, through it.

    Without a boundary the refrain starts at the first line. Items without a marker, or whose span
    has no body text, are left out.
    """
    text = F.coalesce("translit", F.lit(""))
    ends = first_marker(lines, X.is_marker(text, marker_pattern)).filter(F.col("marker").isNotNull())
    stop = X.is_boundary(text, boundary_pattern) | X.is_title_line(text, title_prefixes)
    before = attach_to_lines(lines, ends.select("item_id", "marker", F.col("marker").alias("upto")), "upto")
    spans = (
        before.filter(F.col("line_no") <= F.col("marker"))
        .groupBy("item_id", "marker")
        .agg(F.max(F.when(stop & (F.col("line_no") < F.col("marker")), F.col("line_no"))).alias("stop"))
        .select("item_id", F.col("marker").alias("end"), F.coalesce(F.col("stop") + 1, F.lit(0)).alias("start"))
    )
    inside = attach_to_lines(lines, spans.withColumn("upto", F.col("end")), "upto").filter(
        F.col("line_no").between(F.col("start"), F.col("end"))
    )
    texts = join_lines(inside, {"body": "\n", "translation": " "})
    return spans.join(texts, "item_id").filter(F.col("body") != "").select(
        "item_id", "body", "translation", "start", "end"
    )


def refrain_stats(spans: DataFrame, items: DataFrame) -> DataFrame:
    """Refrain coverage: found, several lines, one line, none."""
    joined = items.select("item_id").join(spans.select("item_id", "start", "end"), "item_id", "left")
    found = F.col("start").isNotNull()
    return metric_rows(
        joined,
        {
            "found": F.count_if(found),
            "multi_line": F.count_if(F.col("start") != F.col("end")),
            "single_line": F.count_if(F.col("start") == F.col("end")),
            "without": F.count_if(~found),
        },
    )


def first_content_line(
    lines: DataFrame,
    skip_lines: Sequence[str] = X.SKIP_LINES,
    invocation: str = X.INVOCATION_PREFIX,
    heading_words: Sequence[str] = X.HEADING_WORDS,
    delimiter: str = X.DELIMITER,
    digits: str = X.NATIVE_DIGITS,
    numbers: bool = False,
) -> DataFrame:
    """First line per item that is no blank, skip line, invocation or heading.

    Its trailing line number goes, unless ``numbers`` are to stay: in prose "version 3." is no line number.
    """
    clean = X.strip("body")
    skipped = (
        (clean == "")
        | clean.isin(list(skip_lines))
        | clean.startswith(invocation)
        | X.is_heading(clean, skip_lines, heading_words, delimiter)
    )
    line = F.min_by(clean, F.col("line_no")).alias("line")
    firsts = lines.filter(~skipped).groupBy("item_id").agg(line)
    return firsts if numbers else firsts.withColumn("line", X.strip_trailing_number(F.col("line"), delimiter, digits))


def first_untitled_line(
    lines: DataFrame, is_title: Column | None = None, min_length: int = MIN_CONTENT_LENGTH
) -> DataFrame:
    """First line per item that is no section title and longer than ``min_length``."""
    clean = X.strip("body")
    title = X.is_native_title_line(F.col("body")) if is_title is None else is_title
    rows = lines.filter(~title & (F.length(clean) > min_length))
    return rows.groupBy("item_id").agg(F.min_by(clean, F.col("line_no")).alias("line"))


def repair_generic_display(items: DataFrame, content: DataFrame) -> DataFrame:
    """Replace skip-line and invocation displays by the content line, then strip line numbers."""
    shown = X.strip(F.coalesce("display", F.lit("")))
    generic = shown.isin(list(X.SKIP_LINES)) | (
        shown.startswith(X.INVOCATION_PREFIX) & (F.length(shown) < GENERIC_DISPLAY_MAX)
    )
    joined = items.join(content.select("item_id", F.col("line").alias("_line")), "item_id", "left")
    replaced = F.when(generic, F.coalesce(F.nullif("_line", F.lit("")), "display")).otherwise(F.col("display"))
    return joined.withColumn("display", X.strip_trailing_number(replaced)).drop("_line")


def repair_title_display(items: DataFrame, spans: DataFrame, untitled: DataFrame) -> DataFrame:
    """Replace section-title displays by the refrain's first line, else the first untitled line."""
    refrain = X.first_body_line(F.col("body"))
    usable = spans.select("item_id", refrain.alias("_refrain")).filter(
        (F.col("_refrain") != "") & ~X.is_native_title_line(F.col("_refrain"))
    )
    joined = items.join(usable, "item_id", "left").join(
        untitled.select("item_id", F.col("line").alias("_line")), "item_id", "left"
    )
    titled = (F.coalesce("display", F.lit("")) != "") & X.is_native_title_line(F.col("display"))
    display = F.when(titled, F.coalesce("_refrain", "_line", "display")).otherwise(F.col("display"))
    return joined.withColumn("display", display).drop("_refrain", "_line")


def repair_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Displays changed and unchanged; an item repaired twice counts once."""
    joined = before.select("item_id", F.col("display").alias("old")).join(
        after.select("item_id", F.col("display").alias("new")), "item_id"
    )
    changed = ~F.equal_null("old", "new")
    return metric_rows(joined, {"changed": F.count_if(changed), "unchanged": F.count_if(~changed)})
