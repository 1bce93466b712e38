"""Session settings and small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.scale import tune

BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
BROADCAST_FILES = "256k"


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings, and Arrow batches small enough for long documents.

    Joins here read staged tables of a few numbers a row, so their file sizes are a fair measure and
    small ones are broadcast without a shuffle first.
    """
    tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", BROADCAST_FILES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to clash with a column."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
