"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Fixed base rules reject short and self-repeating texts. Further rules reject a text whose rate of
symbols, capitals, exclamation marks, duplicate lines or repeated words lies above a cutoff; cutoffs
are learned per stratum (language) from labelled documents. A cutoff may be used only if an exact
binomial test shows that it rejects less than ``risk`` / rules of the good documents: the chance of
so few false rejections at that rate must be below ``alpha`` / (strata x rules) (Bonferroni).
Cutoffs of one rule are tested from lenient to strict and testing stops at the first failure (fixed
sequence), so they need no further correction: with confidence 1 - alpha, all rules together reject
less than ``risk`` of the good documents of every stratum. Among the proven cutoffs the one with the
most low-quality documents less ``cost`` times the good ones it rejects is taken, the lenient one of
equals; a stratum with too few labels gets no cutoff and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagweave.llm.jobs import prepare, unused
from tagweave.scale import staged

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
RISK, ALPHA, COST = 0.05, 0.05, 5
#: Limits of at most this many strata are broadcast; more are joined by shuffle.
BROADCAST_STRATA = 10_000
#: Rate of each rule: (count column, size column), and the cutoffs tried, lenient first.
RULES = {
    "symbol": ("n_symbols", "n_words", (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "capital": ("n_capitals", "word_chars", (0.9, 0.7, 0.5, 0.35, 0.25, 0.2)),
    "shout": ("n_shouts", "n_words", (1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "line": ("n_dup_lines", "n_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "repeat": ("n_repeat_words", "n_words", (0.25, 0.2, 0.15, 0.1)),
}


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, also if the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _doubled(windows: Column, half: int) -> Column:
    """Hashes of windows twice as long as the given ones of ``half`` words."""
    firsts = F.slice(windows, F.lit(1), F.greatest(F.size(windows) - half, F.lit(0)))
    return F.transform(firsts, lambda h, i: F.xxhash64(h, F.get(windows, i + half)))


def _covered(windows: Column) -> Column:
    """Words lying in windows that occur twice or more, from the windows' hashes."""
    numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        found = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                         | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(found, lambda e: e["i"]))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, x: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).cast("bigint").alias("n"), x.alias("last")
    )
    return bind(numbered, lambda s: F.aggregate(twins(s), start, step)["n"])


def _repeated(words: Column) -> Column:
    """Words in windows that come twice or more. Windows of 2, 4 and 8 words are hashed from two of the
    half; a text without equal windows of 4 words has none of 8."""

    def by_four(four: Column) -> Column:
        plain = F.size(F.array_distinct(four)) == F.size(four)
        none = F.lit(0).cast("bigint")
        return F.when(plain, none).otherwise(bind(_doubled(four, 4), _covered))

    one = F.transform(words, lambda w: F.xxhash64(w))
    return bind(one, lambda h: bind(_doubled(h, 1), lambda h2: bind(_doubled(h2, 2), by_four)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, text_key and all counts of every whole text; a null text counts as empty.

    Other columns are ignored; rows that repeat are measured alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select("doc_id", stratum.alias("stratum"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    words = F.array_remove(F.split("text", SPACE), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"words": words, "lines": lines})
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    return rows.select(
        "doc_id",
        "stratum",
        "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"!").alias("n_shouts"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def rate(rule: str) -> Column:
    count, of, _ = RULES[rule]
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(at most k of n) for a binomial with rate p; null where k is above the mean."""
    first = n.cast("double") * F.lit(math.log1p(-p))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    odds = F.lit(p / (1 - p))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k <= n * F.lit(p), F.aggregate(steps, start, step)["sum"])


def cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA, cost: int = COST
) -> DataFrame:
    """Proven cutoffs: stratum, rule, cutoff, good, rejected_good, rejected_bad.

    ``labels`` has doc_id and quality (0 or 1; null is no label). A document with several labels is
    good only if all of them say so. Documents that the base rules reject are left out.
    """
    marks = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("mark"))
    known = measured.where(~base_failed()).join(marks, "doc_id")
    tries = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"),
                 (rate(rule) > c).alias("above"))
        for rule, (_, _, grid) in RULES.items() for i, c in enumerate(grid)
    ]
    tried = known.select("stratum", "mark", F.explode(F.array(*tries)).alias("t"))
    good, above = F.col("mark") == 1, F.col("t.above")
    found = tried.groupBy("stratum", F.col("t.rule").alias("rule"), F.col("t.step").alias("step"), F.col("t.cutoff").alias("cutoff")).agg(
        F.count(F.when(good, 1)).alias("good"),
        F.count(F.when(good & above, 1)).alias("rejected_good"),
        F.count(F.when(~good & above, 1)).alias("rejected_bad"),
    )
    found = staged(found, "cutoffs")
    strata = found.agg(F.count_distinct("stratum").alias("strata"))
    level = F.lit(alpha) / (F.col("strata") * len(RULES))
    chance = tail(F.col("good"), F.col("rejected_good"), risk / len(RULES))
    one = found.withColumn("strata", strata.scalar())
    passed = F.coalesce(chance <= level, F.lit(False))
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    proven = one.withColumn("proven", F.min(passed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    proven = proven.where(F.col("proven") & (F.col("rejected_bad") > cost * F.col("rejected_good")))
    gain = F.col("rejected_bad") - cost * F.col("rejected_good")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc(gain), "step")
    kept = proven.withColumn("_nr", F.row_number().over(best)).where("_nr = 1")
    return kept.select("stratum", "rule", "cutoff", "good", "rejected_good", "rejected_bad")


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts and verdict of every document: base_failed, and kept by all rules.

    Empty tables and empty or null texts are fine (the latter fail the base rules). Without labels
    only the base rules hold.
    """
    prepare(docs.sparkSession)
    measured = staged(measures(docs), "measures")
    found = cutoffs(measured, labels, **options)
    wide = found.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES]
    )
    wide = staged(wide, "limits")
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    rows = measured.join(wide, "stratum", "left").withColumn("base_failed", base_failed())
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | F.coalesce(rate(rule) > F.col(f"max_{rule}"), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~broken)


def kept_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rows meet their verdict by id and text hash, so rows that share an id are judged one by one.
    """
    verdicts = judged(docs, labels, **options).where("kept")
    own_id, own_key = unused(docs.columns, "id", "key")
    keys = verdicts.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_key == F.col(own_key))
    return docs.join(keys, same, "left_semi")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) - 6)) AS i FROM d),
h AS (SELECT doc_id, i, n, list_aggregate(words[i : i + 7], 'string_agg', ' ') AS win FROM w),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM t, range(8) AS s(j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, stratum, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals,
         (length(text) - length(regexp_replace(text, '!', '', 'g')))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < @min OR 100 * n_repeat_words > @repeat * n_words AS base_failed FROM m),
g(rule, step, cutoff) AS (VALUES @grid),
v AS (
  SELECT b.*, g.*, CASE rule @rate END > cutoff AS above FROM b, g),
k AS (SELECT doc_id, min(quality) AS mark FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (mark = 1) AS good,
         count(*) FILTER (mark = 1 AND above) AS bad_good, count(*) FILTER (mark <> 1 AND above) AS bad
  FROM v JOIN k USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
p AS (
  SELECT *, bad_good <= good * @p AND
    list_sum(list_transform(range(bad_good + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1)
      + i * ln(@p) + (good - i) * ln(1 - @p)))) <= @alpha / ((SELECT count(DISTINCT stratum) FROM f) * @rules) AS passed
  FROM f),
q AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS proven FROM p),
c AS (SELECT * FROM q WHERE proven AND bad > @cost * bad_good
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - @cost * bad_good DESC, step) = 1),
x AS (SELECT DISTINCT v.doc_id FROM v JOIN c USING (stratum, rule, step) WHERE above)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept
FROM b
"""
for _mark, _value in {
    "@min": MIN_WORDS,
    "@repeat": MAX_REPEAT_PERCENT,
    "@grid": ", ".join(f"('{r}', {i}, {c})" for r, (_, _, g) in RULES.items() for i, c in enumerate(g)),
    "@rate": " ".join(f"WHEN '{r}' THEN {n} / greatest({of}, 1)" for r, (n, of, _) in RULES.items()),
    "@alpha": ALPHA,
    "@rules": len(RULES),
    "@cost": COST,
    "@p": RISK / len(RULES),
}.items():
    ORACLE = ORACLE.replace(_mark, str(_value))
