"""Annotator passes: pick the pending items, render requests, call, parse and realign answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave import schemas
from tagweave.functions import text as X
from tagweave.operators.collection import by_flag
from tagweave.scale import metric_rows, staged

# Text limits of a request and the share of items that makes a pass reusable.
TRANSLATION_CHARS = 1200
REFRAIN_CHARS = 400
REUSE_SHARE = 0.9
ERROR_CHARS = 200

TEMPLATE = (
    "Translation: {translation}\nCore line: {refrain}\nVocabulary: {vocabulary}\n"
    "Answer in JSON with primary_theme, mood, brief_meaning, tags and reasoning."
)


def _succeeded() -> Column:
    return F.col("tags").isNotNull() & X.blank_to_null(F.col("error")).isNull()


def pending(
    items: DataFrame, done: DataFrame, flags: DataFrame | None = None, mode: str = "all"
) -> DataFrame:
    """Items with a translation that no successful row answers; error rows are tried again."""
    rows = items.filter(X.blank_to_null(F.col("translation")).isNotNull())
    if flags is not None:
        rows = by_flag(rows, flags, mode)
    return rows.join(done.filter(_succeeded()).select("item_id").distinct(), "item_id", "left_anti")


def work_order(rows: DataFrame, flags: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged items first, then by page and id; optionally only the first ``limit`` rows."""
    marked = rows.join(flags.select("item_id", "flagged"), "item_id", "left")
    first = F.when(F.coalesce("flagged", F.lit(False)), 0).otherwise(1)
    ordered = marked.withColumn("turn", first).orderBy("turn", F.coalesce("page", F.lit(0)), "item_id")
    return (ordered if limit is None else ordered.limit(limit)).drop("flagged")


def pass_coverage(items: DataFrame, done: DataFrame, share: float = REUSE_SHARE) -> DataFrame:
    """Answered share of the items and whether the pass is complete enough to be reused."""
    answered = done.filter(_succeeded()).select("item_id", F.lit(1).alias("_done")).distinct()
    joined = items.select("item_id").join(answered, "item_id", "left")
    ratio = F.count("_done") / F.greatest(F.lit(1), F.count(F.lit(1)))
    return metric_rows(
        joined,
        {"items": F.count(F.lit(1)), "answered": F.count("_done"), "reusable": (ratio >= share).cast("int")},
    )


def vocabulary_text(vocabulary: DataFrame, first: int) -> Column:
    """The first ``first`` tags in name order as one text, as a scalar subquery.

    A prompt holds a bounded vocabulary by design; the bound is part of the plan.
    """
    head = vocabulary.select("tag").distinct().orderBy("tag").limit(first)
    return head.agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("t")).scalar()


def render_request(
    items: DataFrame, vocabulary: Column | None = None, template: str = TEMPLATE, no_refrain: str = "(no refrain)"
) -> DataFrame:
    """Items with a ``request`` text: truncated fields and the vocabulary filled into a template."""
    refrain = F.coalesce(X.blank_to_null(F.col("refrain.translation")), F.lit(no_refrain))
    fields = {
        "translation": F.substring(F.coalesce("translation", F.lit("")), 1, TRANSLATION_CHARS),
        "refrain": F.substring(refrain, 1, REFRAIN_CHARS),
        "vocabulary": F.lit("any") if vocabulary is None else vocabulary,
    }
    pieces = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field:
            pieces.append(fields[field])
    return items.withColumn("request", F.concat(*pieces)).withColumn(
        "constrained", F.lit(vocabulary is not None)
    )


def batched(items: DataFrame, size: int) -> DataFrame:
    """Add batch_id and the 1-based place in the batch.

    A batch is a range of ``size`` ids, so it never holds more rows than that and needs no global
    numbering.
    """
    w = Window.partitionBy("batch_id").orderBy("item_id")
    return items.withColumn("batch_id", F.floor(F.col("item_id") / F.lit(size)).cast("bigint")).withColumn(
        "place", F.row_number().over(w)
    )


def full_batches(items: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """Add batch_id and the 1-based place in the batch; every batch but the last is full.

    Rows are cut into ranges of ids and numbered inside them; the ranges' sizes, one number each, are
    summed into offsets. Ids must be unique. ``parts`` is the number of ranges (default: that of
    shuffle partitions).
    """
    spark = items.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = items.repartitionByRange(parts, "item_id").withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "batch-ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("item_id")) - 1
    numbered = ranged.withColumn("_at", inside).join(F.broadcast(offsets), "_part")
    place = F.col("_at") + F.col("_offset")
    return numbered.select(
        *items.columns, F.floor(place / F.lit(size)).cast("bigint").alias("batch_id"),
        (place % F.lit(size) + 1).cast("bigint").alias("place"),
    )


def strip_fence(c: Column) -> Column:
    """Drop a Markdown code fence around an answer."""
    text = X.strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n", ""), r"(?s)```\s*$", "")
    return F.when(text.startswith("```"), X.strip(inner)).otherwise(text)


def _tag_list(c: Column) -> Column:
    """JSON list to array; anything that is not a list becomes an empty one."""
    parsed = F.from_json(c, "array<string>")
    return F.when(F.startswith(X.strip(c), F.lit("[")), parsed).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def parse_annotation(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Annotation columns from an answer text; unreadable answers get an ``error``.

    Keys that are missing become empty strings, tags that are no list an empty list.
    """
    text = strip_fence(F.col(column))
    readable = F.coalesce(F.startswith(text, F.lit("{")), F.lit(False)) & F.coalesce(
        F.json_object_keys(text).isNotNull(), F.lit(False)
    )
    parsed = answers.withColumn("_p", F.from_json(text, schemas.ANNOTATION_JSON)).withColumn("_ok", readable)
    blank = F.lit("")
    failure = F.lit("unreadable answer")
    given = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    return parsed.select(
        *[c for c in answers.columns if c not in (column, "error")],
        F.coalesce("_p.primary_theme", blank).alias("theme"),
        F.coalesce("_p.mood", blank).alias("mood"),
        F.coalesce("_p.brief_meaning", blank).alias("summary"),
        F.when(F.col("_ok"), F.coalesce(_tag_list(F.col("_p.tags")), F.expr("cast(array() as array<string>)"))).alias("tags"),
        F.coalesce("_p.reasoning", blank).alias("reasoning"),
        F.coalesce(given, F.when(~F.col("_ok"), failure)).alias("error"),
    )


def realign(answers: DataFrame, members: DataFrame, by: str = "position") -> tuple[DataFrame, DataFrame]:
    """Give batched answers back to their items: (aligned rows, items to redo one by one).

    ``answers``: batch_id, answer (a JSON object with ``results``). ``members``: batch_id, place,
    item_id. Results are matched by ``position``, by their 1-based ``index`` or by ``id``. By
    position, a batch with too few results is redone as a whole.
    """
    parsed = answers.select("batch_id", F.from_json(strip_fence(F.col("answer")), schemas.BATCH_JSON).alias("p"))
    rows = parsed.select("batch_id", F.posexplode("p.results").alias("at", "r"))
    keyed = rows.select(
        "batch_id", (F.col("at") + 1).alias("position"), F.col("r.index").alias("index"),
        F.col("r.id").alias("id"),
        F.coalesce("r.primary_theme", F.lit("")).alias("theme"),
        F.coalesce("r.mood", F.lit("")).alias("mood"),
        F.coalesce("r.brief_meaning", F.lit("")).alias("summary"),
        _tag_list(F.coalesce("r.tags", F.lit(""))).alias("tags"),
        F.col("r").isNotNull().alias("given"),
    )
    place = {"position": F.col("place"), "index": F.col("place"), "id": F.col("item_id").cast("string")}[by]
    matched = members.withColumn(by, place).join(
        keyed.drop(*[c for c in ("position", "index", "id") if c != by]), ["batch_id", by], "left"
    )
    usable = F.coalesce("given", F.lit(False))
    if by == "position":
        got = keyed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("got"))
        size = members.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
        full = size.join(got, "batch_id").filter(F.col("got") >= F.col("size")).select(
            "batch_id", F.lit(True).alias("full")
        )
        matched = matched.join(full, "batch_id", "left")
        redo = matched.filter(F.col("full").isNull()).select("batch_id", "item_id")
        usable = usable & F.col("full").isNotNull()
    else:
        redo = matched.filter(~usable).select("batch_id", "item_id")
    aligned = matched.filter(usable).select("batch_id", "item_id", "theme", "mood", "summary", "tags")
    return aligned, redo


def call_annotator(
    requests: DataFrame, annotate: Callable[[str], str], annotator: str, error_chars: int = ERROR_CHARS
) -> DataFrame:
    """Answers of an annotator function, one per request; a failing call fills ``error`` only.

    Every evaluation calls the function again; ``run_pass`` writes the answers down first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item_id, request, constrained in zip(frame["item_id"], frame["request"], frame["constrained"]):
                started = time.time()
                answer = error = None
                try:
                    answer = annotate(request)
                except Exception as problem:  # one bad call must not fail the partition
                    error = str(problem)[:error_chars]
                out.append((item_id, annotator, answer, error, round(time.time() - started, 2), constrained))
            yield pd.DataFrame(
                out, columns=["item_id", "annotator", "answer", "error", "elapsed_s", "constrained"]
            )

    return requests.select("item_id", "request", "constrained").mapInPandas(
        run,
        "item_id long, annotator string, answer string, error string, elapsed_s double, constrained boolean",
    )


def annotator_pass(
    items: DataFrame,
    done: DataFrame,
    flags: DataFrame,
    annotate: Callable[[str], str],
    annotator: str,
    mode: str = "all",
    vocabulary: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One pass of one annotator over everything still open, as annotation rows, not yet stored."""
    todo = work_order(pending(items, done, flags, mode), flags, limit)
    return parse_annotation(call_annotator(render_request(todo, vocabulary), annotate, annotator))


def run_pass(
    items: DataFrame,
    flags: DataFrame,
    annotate: Callable[[str], str],
    annotator: str,
    path: str,
    done: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Run a pass, append its answers to the annotator's shard under ``path`` and return the shard.

    ``done`` are the rows stored before (none on the first run); what they answer is not asked again.
    The answers are read back from the files, so using the result never calls the annotator. A task
    that is tried again asks again for its own requests; only the last try's files are kept.
    """
    spark = items.sparkSession
    if done is None:
        done = spark.createDataFrame([], schemas.ANNOTATIONS)
    own = done.filter(F.col("annotator") == annotator)
    found = annotator_pass(items, own, flags, annotate, annotator, **options)
    found.write.mode("append").partitionBy("annotator").parquet(path)
    stored = spark.read.schema(schemas.ANNOTATIONS).parquet(path)
    return stored.filter(F.col("annotator") == annotator)


def call_in_batches(
    members: DataFrame, annotate: Callable[[Sequence[str]], str]
) -> DataFrame:
    """(batch_id, answer) from one call per batch; a failing call gives an ``error`` instead."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        answer = error = None
        try:
            answer = annotate(group.sort_values("place")["request"].tolist())
        except Exception as problem:  # one bad call must not fail the other batches
            error = str(problem)[:ERROR_CHARS]
        return pd.DataFrame({"batch_id": group["batch_id"].iloc[:1], "answer": [answer], "error": [error]})

    schema = "batch_id long, answer string, error string"
    return members.select("batch_id", "place", "request").groupBy("batch_id").applyInPandas(run, schema)


def run_in_batches(
    items: DataFrame,
    annotate: Callable[[Sequence[str]], str],
    annotator: str,
    path: str,
    size: int = 12,
    by: str = "position",
    vocabulary: Column | None = None,
) -> DataFrame:
    """Annotate all open items in batches, asking again for what came back short, and return the shard.

    Every round numbers what no stored row answers into full batches, asks once per batch, realigns the
    answers and appends them to the annotator's shard under ``path``. The next round takes the items that
    are still open in batches of a third of the size, the last round one by one. Rounds are bounded by
    the logarithm of ``size``; what even a call of its own does not answer is stored as one error row,
    which a later run replaces by asking again. ``items`` need item_id, translation and refrain.
    """
    spark = items.sparkSession
    shard = f"{path.rstrip('/')}/annotator={annotator}"
    folders = spark._jvm.org.apache.hadoop.fs.Path(shard)
    there = folders.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folders)
    empty = spark.createDataFrame([], schemas.ANNOTATIONS)

    def stored() -> DataFrame:
        return spark.read.schema(schemas.ANNOTATIONS).parquet(path).filter(F.col("annotator") == annotator)

    done = staged(stored().filter(_succeeded()) if there else empty, "answered")
    while True:
        members = full_batches(render_request(pending(items, done), vocabulary), size)
        members = staged(members.select("item_id", "batch_id", "place", "request", "constrained"), "batches")
        if members.isEmpty():
            break
        answers = staged(call_in_batches(members, annotate), "answers")
        good, _ = realign(answers.select("batch_id", "answer"), members, by)
        got = good.join(members.select("item_id", "constrained"), "item_id").select(
            "item_id", F.lit(annotator).alias("annotator"), "theme", "mood", "summary", "tags",
            F.lit("").alias("reasoning"), F.lit(None).cast("double").alias("elapsed_s"), "constrained",
            F.lit(None).cast("string").alias("error"),
        )
        got = got.filter(F.col("tags").isNotNull())
        if size == 1:
            lost = members.join(got.select("item_id"), "item_id", "left_anti").join(answers.select("batch_id", "error"), "batch_id")
            failed = lost.select("item_id", F.lit(annotator).alias("annotator"), "constrained", F.coalesce("error", F.lit("unreadable answer")).alias("error"))
            got = got.unionByName(failed, allowMissingColumns=True)
        done = staged(done.unionByName(got.select(*done.columns)), "answered")
        if size == 1:
            break
        size = max(1, size // 3)
    # Answers and what is still open; error rows of earlier rounds or runs do not stay beside them.
    done.select(*[c for c in done.columns if c != "annotator"]).write.mode("overwrite").parquet(shard)
    return stored()


def embed_texts(
    df: DataFrame, text: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]
) -> DataFrame:
    """(item_id, vec) from a text column through an embedding function, one Arrow batch per call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed(frame[text].tolist())
            yield pd.DataFrame({"item_id": frame["item_id"], "vec": [list(map(float, v)) for v in vectors]})

    return df.select("item_id", text).mapInPandas(run, "item_id long, vec array<float>")


def hashed_vectors(df: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Default embedding without a model: counts of hashed words, in built-in expressions."""
    slot = F.pmod(F.xxhash64("word"), F.lit(dim)).cast("int")
    words = df.select("item_id", F.explode(X.word_array(F.col(text))).alias("word"))
    counts = words.groupBy("item_id", slot.alias("slot")).agg(F.count(F.lit(1)).cast("float").alias("x"))
    filled = counts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    zero = F.lit(0.0).cast("float")
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero))
    return filled.select("item_id", vec.alias("vec"))
