"""Readers and writers of the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave import schemas
from tagweave.functions.text import MARKER_TAG, strip
from tagweave.operators.graph import GraphBundle


def read_json_table(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON documents with an explicit schema.

    Line-delimited files split over tasks; ``multiline`` reads files that are one JSON array, each
    in one task, and suits only small tables or many files.
    """
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_items(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return read_json_table(spark, path, schemas.ITEMS, multiline)


def write_annotations(df: DataFrame, path: str) -> None:
    """One directory per annotator; a pass replaces only its own annotators' rows."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("annotator")
        .parquet(path)
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All annotators' shards as one table."""
    return spark.read.schema(schemas.ANNOTATIONS).parquet(path)


def write_graph(bundle: GraphBundle, path: str) -> None:
    """Save a graph; edges sorted by source and postings by tag, so lookups skip row groups."""
    tables = {
        "edges": bundle.edges.repartitionByRange("src", "rank").sortWithinPartitions("src", "rank"),
        "tag_index": bundle.index.repartitionByRange("tag", "item_id").sortWithinPartitions("tag", "item_id"),
        "item_meta": bundle.meta,
        "graph_stats": bundle.stats,
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> GraphBundle:
    return GraphBundle(
        *[spark.read.parquet(f"{path}/{n}") for n in ("edges", "tag_index", "item_meta", "graph_stats")]
    )


def parse_vocabulary(documents: DataFrame) -> DataFrame:
    """Vocabulary rows (tag, kind, ordinal, description, native_term, raw_values, n) from JSON texts.

    Accepts an object with ``theme_tags`` and ``mood_tags``, or a plain list of tag names.
    """
    doc = F.from_json("value", schemas.VOCABULARY_JSON)
    parts = []
    for kind, field in (("theme", "theme_tags"), ("mood", "mood_tags")):
        entries = documents.select(doc.alias("d")).select(F.posexplode(F.map_entries(f"d.{field}")).alias("ordinal", "e"))
        parts.append(
            entries.select(
                F.col("e.key").alias("tag"), F.lit(kind).alias("kind"), "ordinal",
                F.coalesce("e.value.description", F.lit("")).alias("description"),
                F.coalesce("e.value.gurbani_term", F.lit("")).alias("native_term"),
                F.coalesce("e.value.raw_themes", F.expr("cast(array() as array<string>)")).alias("raw_values"),
                F.col("e.value.count").alias("n"),
            )
        )
    names = documents.filter(F.startswith(strip("value"), F.lit("["))).select(
        F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "tag")
    )
    plain = names.select(
        "tag", F.lit("theme").alias("kind"), "ordinal", F.lit("").alias("description"),
        F.lit("").alias("native_term"), F.expr("cast(array() as array<string>)").alias("raw_values"),
        F.lit(None).cast("bigint").alias("n"),
    )
    rows = parts[0].unionByName(parts[1]).unionByName(plain).filter(F.col("tag").isNotNull())
    first = F.min_by(F.struct("ordinal", "description", "native_term", "raw_values", "n"), "ordinal")
    return rows.groupBy("kind", "tag").agg(first.alias("f")).select("tag", "kind", "f.*").orderBy("tag", "kind")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_vocabulary(spark.read.option("wholetext", True).text(path))


def derive_vocabulary(items: DataFrame, marker: str = MARKER_TAG) -> DataFrame:
    """Vocabulary without a file: the sorted distinct tags in use, without the marker."""
    tags = items.select(F.explode("tags").alias("tag")).filter(F.col("tag") != marker)
    return tags.distinct().orderBy("tag")


def parse_synonyms(documents: DataFrame) -> DataFrame:
    """Synonym rows (ordinal, canonical, variant) from a JSON object canonical → [variants].

    Keys that start with an underscore are comments. ``ordinal`` follows the order of the file: the
    canonical's place in the upper, the variant's in the lower 31 bits, as many as an array can hold.
    """
    entries = documents.select(F.from_json("value", "map<string, string>").alias("m")).select(
        F.posexplode(F.map_entries("m")).alias("at", "e")
    ).filter(~F.startswith("e.key", F.lit("_")))
    variants = F.from_json("e.value", "array<string>")
    rows = entries.select("at", F.col("e.key").alias("canonical"), F.posexplode_outer(variants).alias("pos", "variant"))
    place = F.col("at").cast("bigint") * F.lit(1 << 31) + F.coalesce("pos", F.lit(0))
    return rows.select(place.alias("ordinal"), "canonical", "variant")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    return parse_synonyms(spark.read.option("wholetext", True).text(path))
