"""Keyed tables that are written again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagweave.scale import staged, unstaged

#: Column of the folders of a bucketed table.
BUCKET = "key_bucket"


def latest_wins(df: DataFrame, keys: list[str], ts: str, tie: str | None = None) -> DataFrame:
    """Insert-or-replace: the latest row of each key.

    An aggregation, so a key written very often shrinks to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_of_each(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, and without it the one with the greatest hash of its columns."""
    place = F.xxhash64(*df.columns) if order is None else F.struct(order, F.xxhash64(*df.columns))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_r")).select(key, "_r.*")


def upsert_vectors(
    existing: DataFrame, new: DataFrame, key: str = "item_id", order: str | None = None
) -> DataFrame:
    """Replace rows of known ids, add new ones; of ids repeated in ``new`` the last one counts."""
    last = last_of_each(new, key, order)
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_bucketed(df: DataFrame, path: str, key: str = "item_id", buckets: int = 256) -> None:
    """Write a keyed table cut by a hash of its key into folders, for ``upsert_bucketed``."""
    rows = last_of_each(df, key).withColumn(BUCKET, bucket_of(key, buckets))
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def upsert_bucketed(
    spark: SparkSession, path: str, new: DataFrame, key: str = "item_id", buckets: int = 256, order: str | None = None
) -> list[int]:
    """Replace and add rows of a table made by ``create_bucketed``; only buckets with new rows are read and
    written again. Returns these buckets.

    The merged buckets are staged in the shared folder before their folders are replaced, so a lost
    executor never finds them half written. ``buckets`` must be the number the table was created with;
    at most so many numbers come to the driver.
    """
    own = {k: v.dataType for k, v in zip(new.columns, new.schema)}
    last = last_of_each(new, key, order).withColumn(BUCKET, bucket_of(key, buckets))
    last = staged(last, "upsert-new")
    touched = sorted(r[BUCKET] for r in last.select(BUCKET).distinct().collect())
    if not touched:
        unstaged(last)
        return touched
    schema = StructType([*[StructField(k, t) for k, t in own.items()], StructField(BUCKET, IntegerType())])
    stored = spark.read.schema(schema).parquet(path).filter(F.col(BUCKET).isin(touched))
    kept = stored.join(last.select(key), key, "left_anti")
    merged = staged(kept.unionByName(last), "upsert-merged")
    writer = merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET).parquet(path)
    unstaged(last, merged)
    return touched


def complete_records(library: DataFrame, status: str = "complete") -> DataFrame:
    """Only finished library records go into the vector table."""
    return library.filter(F.col("status") == status)
