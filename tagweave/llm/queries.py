"""Queries of the training-data operators over their whole tables, with comparison SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import (
    conversation_repair,
    html_main,
    importance,
    jaccard_join,
    minhash_dedup,
    mixing,
    order_minhash,
    piece_samples,
    private_data,
    quality_model,
    quality_rules,
    token_counts,
    url_filter,
)
from tagweave.llm.jobs import prepare, table

#: Folder of the public tokenizers' files.
TOKENIZERS = str(Path(public_tokenizers.path("byte_bpe_50k.json")).parent)
URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(prepare(spark), sf)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def near_oracle(words: int, kept: str = "") -> str:
    """Comparison SQL of near_groups at a similarity of 0.85."""
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(words[i : i + least({words}, len(words)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {words} + 2, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(list(g ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM k),
r AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = rep),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
  SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(w.root, c.rep, d.doc_id) AS component_id{kept}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN w ON w.a = c.rep
"""


@query(
    r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC, length(rpath) DESC) AS nr
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE nr = 1
"""
)
def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"), URL_RULES)


@query()
def op2_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_main.extract(table(spark, sf, "pages"))


@query()
def op3_piece_samples(spark: SparkSession, sf: str) -> DataFrame:
    return piece_samples.sampled(table(spark, sf, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query()
def op4_private_data(spark: SparkSession, sf: str) -> DataFrame:
    return private_data.find(table(spark, sf, "documents"))


@query(mixing.ORACLE)
def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


@query(quality_rules.ORACLE)
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op7_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf, "documents"))


@query()
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


@query(near_oracle(4))
def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf, "documents"), n=4, num=85, den=100)


@query()
def op10_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(importance.oracle())
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return importance.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(near_oracle(3, ", coalesce(w.root, c.rep, d.doc_id) = d.doc_id AS kept"))
def op12_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf, "documents"), n=3, num=85, den=100)


@query(conversation_repair.oracle())
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf, "conversations")))
