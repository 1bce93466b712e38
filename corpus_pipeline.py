"""A corpus pipeline of the library's training-data operators; every stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import jaccard_join, linking, mixing, piece_samples, private_data, quality_rules
from tagweave.llm.jobs import prepare, table
from tagweave.llm.queries import TOKENIZERS
from tagweave.scale import STAGED, remove_staged, staged, unstaged

#: Near copies share at least this part of their five-word shingles.
WORDS, SIMILAR = 5, (80, 100)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage run last has staged.
_scratch: list[str] = []


def stage(fn: Stage) -> Stage:
    """A stage that first removes what the stage before it has staged.

    By the contract of stages that one's result is written by now and has come back as ``docs``.
    """

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_staged(spark, _scratch)
        before = set(STAGED)
        out = fn(spark, docs, sf_dir)
        _scratch[:] = [p for p in STAGED if p not in before]
        return out

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; cutoffs are learned from the labels of sf_dir."""
    return quality_rules.kept_rows(docs, table(prepare(spark), sf_dir, "labels"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id, then with the least text hash.

    Ids are not names: rows with one id and unlike texts are in different groups. Rows without an id take
    part and come last in their group. Texts without words are linked with nothing and stay.
    """
    prepare(spark)
    return linking.one_of_each(docs, jaccard_join.grouped(docs, WORDS, *SIMILAR))


@stage
def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data in their texts replaced by its kind; n_chars follows."""
    hidden = docs.withColumn("text", private_data.redact(prepare(spark), docs))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, as piece ids."""
    return piece_samples.sampled(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("near copies", drop_near_copies),
    ("private data", hide_private_data),
    ("source mix", mix_sources),
    ("piece samples", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = table(prepare(spark), sf_dir, "documents"), ()
    for name, run_stage in STAGES:
        docs = staged(run_stage(spark, docs, sf_dir), name.replace(" ", "-"))
        unstaged(*last)
        last = (docs,)
    return docs
