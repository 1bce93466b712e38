"""Consensus, validation and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.operators import audit, consensus, taxonomy, validate
from tagweave.plans import bindings as B
from tagweave.plans.bindings import sql
from tagweave.plans.registry import query
from tagweave.scale import staged_path
from tagweave.sources import tables

LINEUP = ("m0", "m1", "m2", "m3")


# ---- consensus -------------------------------------------------------------------------------


@query(sql("votes", "SELECT item_id, key, tag, votes, voters, forms AS surface_forms FROM votes"))
def vote_detail(spark, sf):
    """Votes, voters and spellings per item and folded tag."""
    return consensus.votes(B.annotations(spark, sf), B.synonyms(spark))


@query(sql("cons", "SELECT item_id, array_to_string(tags, ',') AS tags FROM cons"))
def consensus_tags(spark, sf):
    return consensus.consensus(B.annotations(spark, sf), B.synonyms(spark))


@query(sql("cons", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cons) GROUP BY 1"))
def consensus_vocabulary(spark, sf):
    return consensus.consensus_vocabulary(consensus.consensus(B.annotations(spark, sf), B.synonyms(spark)))


@query(sql("cons", "flags", """SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM cons
    WHERE item_id IN (SELECT item_id FROM flags)) GROUP BY 1"""))
def flagged_vocabulary(spark, sf):
    """Vocabulary of the flagged items only."""
    flagged = B.annotations(spark, sf).join(B.item_flags(spark, sf).filter("flagged"), "item_id", "left_semi")
    return consensus.consensus_vocabulary(consensus.consensus(flagged, B.synonyms(spark)))


PREFERRED = "pref AS (SELECT item_id, arg_min({'annotator': annotator, 'theme': theme, 'mood': mood, 'summary': summary}, list_position(['m2', 'm0', 'm3'], annotator)) AS f FROM ann WHERE theme IS NOT NULL AND annotator IN ('m2', 'm0', 'm3') GROUP BY 1)"


@query(sql("ann", f"+{PREFERRED} SELECT item_id, f.annotator AS annotator, f.theme AS theme, f.mood AS mood, f.summary AS summary FROM pref"))
def preferred_annotation(spark, sf):
    """Fields of the first trusted annotator that has a theme."""
    return consensus.preferred_annotation(B.annotations(spark, sf), ("m2", "m0", "m3"))


@query(sql("ann", "cons", f"""+{PREFERRED}
    SELECT o_orderkey AS item_id, array_to_string(coalesce(c.tags, ['old']), ',') AS tags,
      CASE WHEN c.item_id IS NOT NULL THEN 'multi_llm_consensus_v1' ELSE 'before' END AS tags_source,
      CASE WHEN c.item_id IS NOT NULL AND p.item_id IS NOT NULL THEN f.theme ELSE o_orderpriority END AS theme,
      CASE WHEN c.item_id IS NOT NULL AND p.item_id IS NOT NULL THEN f.mood ELSE o_orderstatus END AS mood,
      CASE WHEN c.item_id IS NOT NULL AND p.item_id IS NOT NULL THEN f.summary END AS summary
    FROM orders LEFT JOIN cons c ON c.item_id = o_orderkey LEFT JOIN pref p ON p.item_id = o_orderkey"""))
def consensus_run(spark, sf):
    """All orders with agreed tags and preferred fields, or what they had before."""
    items = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.array(F.lit("old")).alias("tags"), F.lit("before").alias("tags_source"),
        F.col("o_orderpriority").alias("theme"), F.col("o_orderstatus").alias("mood"), F.lit(None).cast("string").alias("summary"),
    )
    return consensus.run_consensus(items, B.annotations(spark, sf), B.synonyms(spark), priority=("m2", "m0", "m3"))


LISTED = """WITH syn AS (SELECT p_type AS canonical, split_part(p_name, ' ', 2) AS variant, min(p_partkey) AS ordinal FROM part GROUP BY 1, 2),
    k AS (SELECT *, regexp_replace(lower(canonical), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(lower(variant), '[^a-z0-9]+', '', 'g') AS vkey FROM syn),
    m AS (SELECT key AS raw_key, key, min(ordinal) * 2 AS o FROM k GROUP BY 1 UNION ALL SELECT vkey, key, ordinal * 2 + 1 FROM k)"""


def _listed_synonyms(spark, sf):
    """Synonym rows from part names: the type as canonical, the second word as variant."""
    listed = F.col("p_type").alias("canonical"), F.split("p_name", " ").getItem(1).alias("variant")
    return B.table(spark, sf, "part").groupBy(*listed).agg(F.min("p_partkey").alias("ordinal"))


@query(LISTED + """ SELECT raw_key, arg_max(key, o) AS key, upper(arg_max(key, o)) AS surface FROM m GROUP BY 1""")
def synonym_map(spark, sf):
    """Variant to canonical map where many canonicals claim the same variant."""
    return consensus.synonym_map(_listed_synonyms(spark, sf))


@query(sql("vrows", "SELECT DISTINCT tag, raw_key, key, surface FROM vrows"))
def folded_tags(spark, sf):
    """Every spelling in use with its folded key."""
    tags = B.annotations(spark, sf).select(F.explode("tags").alias("tag")).distinct()
    return consensus.fold_synonyms(tags, B.synonyms(spark)).select("tag", "raw_key", "key", "surface")


@query("""WITH pairs AS (SELECT DISTINCT regexp_replace(lower(split_part(p_name, ' ', 2)), '[^a-z0-9]+', '', 'g') AS raw_key, p_type AS canonical FROM part)
    SELECT raw_key, array_to_string(list_sort(list(canonical)), ',') AS canonicals FROM pairs GROUP BY 1 HAVING count(*) > 1""")
def synonym_conflicts(spark, sf):
    """Words listed under several canonicals, with part types as canonicals."""
    return consensus.synonym_conflicts(_listed_synonyms(spark, sf))


@query(sql("ann", """SELECT annotator, count(*) FILTER (WHERE tags IS NOT NULL) AS with_tags,
    count(*) FILTER (WHERE tags IS NOT NULL AND error IS NULL) AS ok, count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM ann GROUP BY 1"""))
def annotator_coverage(spark, sf):
    return consensus.annotator_coverage(B.annotations(spark, sf))


@query(sql("ann", """+ p AS (SELECT item_id, count(DISTINCT annotator) AS n FROM ann WHERE tags IS NOT NULL GROUP BY 1)
    SELECT 'full_lineup' AS metric, count(*) FILTER (WHERE n = 4)::DOUBLE AS value FROM p UNION ALL SELECT 'answered', count(*)::DOUBLE FROM p"""))
def full_lineup(spark, sf):
    return consensus.full_lineup_items(B.annotations(spark, sf), LINEUP)


@query("""WITH t AS (SELECT o_orderpriority AS annotator, o_custkey AS item_id, 'c' || (o_custkey % 700) || o_orderstatus AS surface FROM orders)
    SELECT lower(trim(surface)) AS tag, min(surface) AS surface, count(DISTINCT item_id) AS n_items FROM t GROUP BY 1 HAVING count(DISTINCT annotator) = 1""")
def singleton_tags(spark, sf):
    """Tags of one annotator only; order priorities stand in for annotators."""
    o = B.table(spark, sf, "orders")
    tag = F.concat(F.lit("c"), (F.col("o_custkey") % 700).cast("string"), F.col("o_orderstatus"))
    ann = o.select(
        F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("annotator"), F.array(tag).alias("tags")
    )
    return consensus.singleton_tags(ann)


@query(sql("ann", "SELECT annotator, count(*) AS n, count(tags) AS n_tags FROM ann GROUP BY 1"))
def annotation_shards(spark, sf):
    """Write one shard per annotator, replace one of them, read all back."""
    path = staged_path(spark, "annotations")
    rows = B.annotations(spark, sf)
    tables.write_annotations(rows, path)
    tables.write_annotations(rows.filter(F.col("annotator") == "m1"), path)
    saved = tables.read_annotations(spark, path)
    return saved.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count("tags").alias("n_tags"))


# ---- dual-scorer validation ------------------------------------------------------------------


def _vocabulary(spark, sf):
    """Every event type but one."""
    ev = B.table(spark, sf, "events").select(F.col("event_type").alias("tag")).distinct()
    return ev.filter(F.col("tag") != "error")


def _changes(spark, sf):
    return validate.validate(B.event_items(spark, sf), B.tag_scores(spark, sf), _vocabulary(spark, sf), "s0", "s1")


@query(sql("al", "SELECT item_id, tag, score_a, score_b FROM al"))
def aligned_scores(spark, sf):
    tags = validate.exploded_tags(B.event_items(spark, sf))
    return validate.align_scores(tags, B.tag_scores(spark, sf), "s0", "s1")


@query(sql("changes", "SELECT item_id, tag, score_a, score_b, action FROM changes"))
def tag_validation(spark, sf):
    """Decision of two scorers on every tag of every item."""
    return _changes(spark, sf)


@query(sql("changes", "SELECT item_id, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM changes WHERE action <> 'removed' GROUP BY 1"))
def validated_tags(spark, sf):
    return validate.tags_after(_changes(spark, sf))


@query(sql("changes", """SELECT 'total' AS metric, count(*) FILTER (WHERE action <> 'added')::DOUBLE AS value FROM changes
    UNION ALL SELECT a, (SELECT count(*) FROM changes WHERE action = a)::DOUBLE FROM (VALUES ('kept'), ('removed'), ('added'), ('flagged')) v(a)"""))
def change_stats(spark, sf):
    return validate.change_stats(_changes(spark, sf))


@query(sql("agreed", "SELECT item_id, tag FROM agreed"))
def suggested_by_both(spark, sf):
    return validate.suggested_by_both(B.tag_scores(spark, sf), "s0", "s1")


WEAK = "wk AS (SELECT tag, avg(CASE WHEN score_a <= 2 AND score_b <= 2 THEN 1 ELSE 0 END) AS rate, count(*) AS uses FROM al WHERE item_id IN (SELECT item_id FROM sample) GROUP BY 1)"


@query(sql("al", "sample", f"+{WEAK} SELECT tag, CAST(round(CAST(rate AS DECIMAL(20, 12)), 2) AS DOUBLE) AS rate, uses FROM wk WHERE rate > 0.05"))
def weak_tags(spark, sf):
    """Weak rate per tag over a seeded sample of items."""
    sample = audit.sample_n(B.event_items(spark, sf), 500)
    aligned = validate.align_scores(
        validate.exploded_tags(sample), B.tag_scores(spark, sf), "s0", "s1", reset_both=True
    )
    return validate.weak_tags(aligned, 0.05)


RULES = "rl AS (SELECT theme, tag, count(*) AS n FROM agreed JOIN sample USING (item_id) GROUP BY 1, 2)"


@query(sql("agreed", "sample", f"+{RULES} SELECT theme, tag, n FROM rl"))
def suggestion_rules(spark, sf):
    sample = audit.sample_n(B.event_items(spark, sf), 500)
    return validate.suggestion_rules(sample, B.tag_scores(spark, sf), "s0", "s1")


@query(sql("al", "agreed", "sample", f"""+{RULES}, {WEAK},
    gw AS (SELECT tag FROM wk WHERE rate > 0.3 AND round(CAST(rate AS DECIMAL(20, 12)), 2) > 0.5),
    d AS (SELECT a.item_id, a.tag, CASE
        WHEN a.item_id IN (SELECT item_id FROM sample) AND raw_a IS NOT NULL AND raw_b IS NOT NULL THEN CASE WHEN raw_a <= 2 AND raw_b <= 2 THEN 'own_scores' END
        WHEN a.tag IN (SELECT tag FROM gw) AND NOT contains(lower(e.theme), lower(a.tag)) THEN 'global_weak' END AS rule
      FROM al a JOIN eitems e USING (item_id))
    SELECT item_id, tag, rule, CASE WHEN rule IS NULL THEN 'kept' ELSE 'removed' END AS action FROM d
    UNION ALL SELECT e.item_id, rl.tag, 'suggested', 'added' FROM eitems e JOIN rl ON rl.theme = e.theme AND rl.n >= 3
      WHERE (e.item_id, rl.tag) NOT IN (SELECT (item_id, tag) FROM d WHERE rule IS NULL)"""))
def rule_changes(spark, sf):
    """Decisions for all items from rules learned on the scored sample."""
    items = B.event_items(spark, sf)
    return validate.validate_sampled(items, audit.sample_n(items, 500), B.tag_scores(spark, sf), "s0", "s1")


# ---- taxonomy --------------------------------------------------------------------------------


@query(sql("themed", "SELECT 'theme' AS kind, theme AS value, count(*) AS n FROM themed GROUP BY 2 UNION ALL SELECT 'mood', mood, count(*) FROM themed GROUP BY 2"))
def value_counts(spark, sf):
    items = B.themed_items(spark, sf)
    themes = taxonomy.value_counts(items, "theme").withColumn("kind", F.lit("theme"))
    return themes.unionByName(taxonomy.value_counts(items, "mood").withColumn("kind", F.lit("mood")))


def _batches(spark, sf):
    """Clusters per batch of parts: brands as batches, types as tags."""
    p = B.table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("batch"), F.col("p_type").alias("tag")).agg(
        F.concat(F.lit("of "), F.first("p_brand")).alias("description"), F.lit("").alias("native_term"),
        F.sort_array(F.collect_set("p_name")).alias("raw_values"),
    )


@query("SELECT DISTINCT p_type AS tag, p_name AS value FROM part")
def merged_clusters(spark, sf):
    """Union of the raw values of a tag over all batches."""
    return taxonomy.merge_clusters(_batches(spark, sf))[1]


@query("SELECT p_type AS tag, 'of ' || min(p_brand) AS description, '' AS native_term FROM part GROUP BY 1")
def merged_cluster_tags(spark, sf):
    """Tags with the description of their first batch."""
    return taxonomy.merge_clusters(_batches(spark, sf))[0]


@query(sql("map", "themed", """SELECT tag, coalesce(sum(n), 0)::BIGINT AS n_items, count(*) AS n_values
    FROM map LEFT JOIN (SELECT theme AS value, count(*) AS n FROM themed GROUP BY 1) USING (value) GROUP BY 1"""))
def vocab_coverage(spark, sf):
    return taxonomy.vocab_coverage(B.raw_mapping(spark, sf), taxonomy.value_counts(B.themed_items(spark, sf), "theme"))


DIS = """a AS (SELECT value, max(tag) AS tag FROM map GROUP BY 1),
    b AS (SELECT value, CASE WHEN length(value) % 3 = 0 THEN 'other' WHEN length(value) % 3 = 1 THEN '' ELSE tag END AS tag FROM a),
    dis AS (SELECT value, a.tag AS tag_a, b.tag AS tag_b FROM a JOIN b USING (value) WHERE b.tag <> '' AND a.tag <> b.tag)"""


def _mappings(spark, sf):
    a = B.raw_mapping(spark, sf).groupBy("value").agg(F.max("tag").alias("tag"))
    k = F.length("value") % 3
    return a, a.select("value", F.when(k == 0, "other").when(k == 1, "").otherwise(F.col("tag")).alias("tag"))


@query(sql("map", f"+{DIS} SELECT value, tag_a, tag_b FROM dis"))
def mapping_disagreements(spark, sf):
    return taxonomy.mapping_disagreements(*_mappings(spark, sf))


@query(sql("map", f"""+{DIS}, smp AS (SELECT value FROM a ORDER BY md5(value || '-42'), value LIMIT 200)
    SELECT 'sampled' AS metric, count(*)::DOUBLE AS value FROM smp
    UNION ALL SELECT 'disagreements', count(*)::DOUBLE FROM smp JOIN dis USING (value)
    UNION ALL SELECT 'percent', floor((SELECT count(*) FROM smp JOIN dis USING (value)) * 100 / (SELECT count(*) FROM smp)::DOUBLE)"""))
def disagreement_rate(spark, sf):
    """Disagreements among 200 sampled raw values."""
    a, b = _mappings(spark, sf)
    return taxonomy.disagreement_rate(
        taxonomy.mapping_disagreements(a, b), audit.sample_n(a.select("value"), 200, key="value")
    )


@query(sql("pre", "post", """SELECT item_id, array_to_string(pre.tags, ',') AS tags_a, array_to_string(post.tags, ',') AS tags_b
    FROM pre JOIN post USING (item_id) WHERE len(list_intersect(pre.tags, post.tags)) = 0"""))
def no_overlap(spark, sf):
    """Items whose two tag sets share nothing."""
    return taxonomy.no_overlap(*B.snapshots(spark, sf))


ALIAS = """al2 AS (SELECT item_id, theme, tags, list_sort(list_distinct(list_concat(
      coalesce(m.alias_tags, CAST([] AS VARCHAR[])), CASE WHEN moods.tag IS NOT NULL THEN [moods.tag] ELSE CAST([] AS VARCHAR[]) END))) AS alias_tags
    FROM themed LEFT JOIN (SELECT lower(trim(value)) AS a, list(DISTINCT tag) AS alias_tags FROM map GROUP BY 1) m ON m.a = lower(trim(theme))
    LEFT JOIN moods ON moods.value = mood AND mood IN ('PROMO', 'ECONOMY'))"""


def _alias_vocabulary(spark, sf):
    """Vocabulary whose moods list only two of the raw moods, so that some items stay unmatched."""
    v = B.vocabulary(spark, sf)
    listed = F.filter("raw_values", lambda m: m.isin("PROMO", "ECONOMY"))
    return v.withColumn("raw_values", F.when(F.col("kind") == "mood", listed).otherwise(F.col("raw_values")))


@query(sql("themed", "map", "moods", f"""+{ALIAS}
    SELECT item_id, array_to_string(CASE WHEN len(tags) > 0 THEN tags ELSE alias_tags END, ',') AS tags,
      CASE WHEN len(tags) > 0 THEN NULL ELSE 'alias' END AS tags_source FROM al2 WHERE len(tags) > 0 OR len(alias_tags) > 0"""))
def alias_tags(spark, sf):
    """Items tagged by the vocabulary's aliases; existing tags stay."""
    tagged, _ = taxonomy.tag_by_alias(B.themed_items(spark, sf), _alias_vocabulary(spark, sf))
    return tagged.select("item_id", "tags", "tags_source")


@query(sql("themed", "map", "moods", f"""+{ALIAS} SELECT item_id, array_to_string(alias_tags, ',') AS tags, 'alias' AS tags_source FROM al2 WHERE len(alias_tags) > 0
    UNION ALL SELECT item_id, array_to_string(tags, ','), NULL FROM al2 WHERE len(alias_tags) = 0 AND len(tags) > 0"""))
def library_alias_tags(spark, sf):
    """The overwriting variant used for library records."""
    tagged, _ = taxonomy.tag_by_alias(B.themed_items(spark, sf), _alias_vocabulary(spark, sf), overwrite=True)
    return tagged.select("item_id", "tags", "tags_source")


@query(sql("themed", "map", "moods", f"+{ALIAS} SELECT item_id, theme FROM al2 WHERE len(tags) = 0 AND len(alias_tags) = 0"))
def alias_unmatched(spark, sf):
    """Items no alias matches, left for an annotator."""
    _, unmatched = taxonomy.tag_by_alias(B.themed_items(spark, sf), _alias_vocabulary(spark, sf))
    return unmatched.select("item_id", "theme")


@query(sql("map", "moods", """+ v AS (SELECT tag FROM map UNION SELECT 'mood_' || lower(p_type[1:1]) FROM part UNION SELECT tag FROM moods)
    SELECT p_partkey AS item_id, t.tag FROM part, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'mood_' || lower(p_type[1:1])]) t(tag)
    WHERE t.tag IN (SELECT tag FROM v)"""))
def valid_tags(spark, sf):
    """Tag rows that the vocabulary holds."""
    p = B.table(spark, sf, "part")
    word = F.split("p_name", " ")
    tags = F.array(word.getItem(0), word.getItem(1), F.concat(F.lit("mood_"), F.lower(F.substring("p_type", 1, 1))))
    rows = p.select(F.col("p_partkey").alias("item_id"), F.explode(tags).alias("tag"))
    return taxonomy.valid_tags(rows, B.vocabulary(spark, sf))


@query(sql("f1", """SELECT 'tagged' AS metric, count(*) FILTER (WHERE len(tags) > 0)::DOUBLE AS value FROM f1 UNION ALL SELECT 'total', count(*)::DOUBLE FROM f1
    UNION ALL SELECT 'percent', floor(count(*) FILTER (WHERE len(tags) > 0) * 100 / count(*)::DOUBLE) FROM f1
    UNION ALL SELECT 'mean_tags', round(sum(len(tags)) / count(*) FILTER (WHERE len(tags) > 0)::DOUBLE, 4) FROM f1"""))
def tag_coverage(spark, sf):
    return taxonomy.tag_coverage(B.tagged_items(spark, sf))


@query(sql("it", "SELECT DISTINCT tag FROM it"))
def derived_vocabulary(spark, sf):
    """Vocabulary from the tags in use."""
    return tables.derive_vocabulary(B.tagged_items(spark, sf))


@query(sql("map", "SELECT 'theme' AS kind, tag, 'about ' || tag AS description, array_to_string(list_sort(list(value)), ',') AS raw_values, count(*) AS n FROM map GROUP BY tag"))
def vocabulary_documents(spark, sf):
    """Vocabulary written as one JSON document, then read back."""
    v = B.vocabulary(spark, sf).filter(F.col("kind") == "theme")
    entry = F.struct("description", F.col("raw_values").alias("raw_themes"), F.size("raw_values").alias("count"))
    doc = v.agg(F.map_from_entries(F.collect_list(F.struct("tag", entry))).alias("theme_tags"))
    docs = doc.select(F.to_json(F.struct("theme_tags")).alias("value"))
    return tables.parse_vocabulary(docs).select("kind", "tag", "description", "raw_values", "n")
