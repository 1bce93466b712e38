"""Helpers that keep jobs whole and balanced on large, skewed data."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_LINES = 4096
BROADCAST_BYTES = "10m"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; all of them are session-level SQL settings.

    Nothing is broadcast on an estimate: files compress well and ``explode`` multiplies rows. Adaptive
    execution broadcasts a side once its shuffled size is measured below BROADCAST_BYTES, and splits
    skewed join partitions, also where that costs one more shuffle.
    """
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST_BYTES,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the functions run in Python."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, from ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves a local session, whose executors all see it, and is
    removed at exit; on a cluster the setting is required.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            configured = own
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint a table that several later steps read, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that comes in fewer files than there are cores.

    Large tables have more splits than that and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table several later steps read to the shared folder and go on from the files.

    Cuts the lineage like a checkpoint; the file sizes also let Spark choose joins well.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    STAGED.append(path)
    return table


#: Staged tables that are still there, oldest first.
STAGED: list[str] = []


def unstaged(*tables: DataFrame) -> None:
    """Remove staged tables whose successors are written; nothing lazy may still read them."""
    for table in tables:
        remove_staged(table.sparkSession, [table.staged_at])


def remove_staged(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in STAGED:
            STAGED.remove(path)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Remove the tables staged since ``before`` (a copy of STAGED) except those to keep."""
    kept = {*before, *(t.staged_at for t in keep)}
    remove_staged(spark, [p for p in STAGED if p not in kept])


def chunk_of(position: Column, size: int = CHUNK_LINES) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def attach_to_lines(
    lines: DataFrame, per_item: DataFrame, last_line: str, size: int = CHUNK_LINES
) -> DataFrame:
    """Left join a one-row-per-item table to its lines without one task per item.

    The item row is repeated once per ``size`` lines (``last_line`` names its highest line number),
    so an item that owns a large share of all lines is spread over many join keys.
    """
    spread = per_item.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunk_of(F.col(last_line), size)))
    ).drop(last_line)
    keyed = lines.withColumn("_chunk", chunk_of(F.col("line_no"), size))
    return keyed.join(spread, ["item_id", "_chunk"], "left").drop("_chunk")


#: Places over which the rows of one key meet what is known of the key.
SALTS = 64


def attach_to_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], id_col: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join a narrow one-row-per-key table to its rows without one task per key.

    The key's row is repeated ``salts`` times and rows go by their ids' hashes, so a key of a third of all
    rows is spread. An aggregated side cannot be left to the skew rule: it splits only sides that are
    shuffled for the join itself.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(23), id_col), F.lit(salts)).cast("int"))
    return salted.join(per_key.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")


def positions(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "pos"
) -> DataFrame:
    """Zero-based position of each row inside its key, ranked bucket by bucket.

    ``bucket`` must grow with the order (a year for dates, a range for ids). Rows are numbered in
    (key, bucket) groups; the groups' sizes are then summed into offsets, so a key that holds a
    large share of all rows never sits in one window.
    """
    rows = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inner) - 1)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_rank", "_offset")
    )


def next_in_sequence(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str]) -> DataFrame:
    """Attach columns of the following position; an equi-join on dense positions.

    Unlike ``lead`` over a window this spreads one long sequence over all tasks.
    """
    following = df.select(
        *keys, (F.col(pos) - 1).alias(pos), *[F.col(c).alias(out) for c, out in cols.items()]
    )
    return df.join(following, [*keys, pos], "left")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark trims each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Global aggregates as (metric, value) rows, in one pass and without joining single rows."""
    one = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    pairs = F.array(
        *[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics]
    )
    return one.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")
