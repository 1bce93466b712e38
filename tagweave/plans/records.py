"""Library, set and audit queries."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import functions as F

from tagweave.functions import text as X
from tagweave.operators import audit, library, search, sets, similarity
from tagweave.plans import bindings as B
from tagweave.plans.bindings import sql
from tagweave.plans.registry import query

# ---- library ---------------------------------------------------------------------------------


@query("""SELECT c_custkey + 1 AS rec_id, c_name AS title, c_mktsegment AS contributor, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS style,
    CASE WHEN c_custkey % 3 = 0 THEN 'Medium' ELSE 'High' END AS confidence, 'pending' AS status FROM customer WHERE c_custkey % 11 NOT IN (0, 1)""")
def clean_tracks(spark, sf):
    """Track list with blanks, the text nan and missing titles cleaned."""
    c, k = B.table(spark, sf, "customer"), F.col("c_custkey")
    raw = c.select(
        k.alias("row_index"),
        F.when(k % 11 == 0, "  ").when(k % 11 == 1, "nan").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("title"),
        F.concat(F.lit(" "), "c_mktsegment").alias("contributor"),
        F.when(k % 4 == 1, "nan").otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("style"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit(" High ")).alias("confidence"),
    )
    return library.clean_tracks(raw)


CARRY = """prior AS (SELECT * FROM lib WHERE category <> 'BUILDING' UNION ALL SELECT * REPLACE (rec_id + 10000000 AS rec_id, upper(title) AS title, ' ' || contributor AS contributor, 'later' AS theme) FROM lib WHERE category = 'MACHINERY')"""


@query(sql("lib", f"""+{CARRY}, last AS (SELECT lower(trim(title)) AS t, lower(trim(contributor)) AS c, arg_max({{'theme': theme, 'mood': mood, 'item_id': item_id, 'status': status}}, rec_id) AS p FROM prior GROUP BY 1, 2)
    SELECT rec_id, title, contributor, coalesce(p.theme, 'fresh') AS theme, p.mood AS mood, p.item_id AS item_id, coalesce(p.status, 'pending') AS status
    FROM lib LEFT JOIN last ON t = lower(trim(title)) AND c = lower(trim(contributor))"""))
def carried_forward(spark, sf):
    """Fresh records with the fields of a prior run; its later duplicates win."""
    lib = B.library(spark, sf)
    later = lib.filter(F.col("category") == "MACHINERY").withColumn("rec_id", F.col("rec_id") + 10000000)
    later = later.withColumn("title", F.upper("title")).withColumn("contributor", F.concat(F.lit(" "), "contributor"))
    prior = lib.filter(F.col("category") != "BUILDING").unionByName(later.withColumn("theme", F.lit("later")))
    fresh = lib.select(
        "rec_id", "title", "contributor", F.lit("fresh").alias("theme"), F.lit(None).cast("string").alias("mood"),
        F.lit(None).cast("bigint").alias("item_id"), F.lit("pending").alias("status"),
    )
    return library.carry_forward(fresh, prior, ("theme", "mood", "item_id", "status"))


@query(sql("lib", """SELECT rec_id, title, title AS first_line, contributor, category, perf_category, page::BIGINT AS page, author, theme, mood, confidence, status, item_id
    FROM lib WHERE (contains(lower(title), 'build') OR contains(lower(coalesce(theme, '')), 'build') OR contains(lower(contributor), 'build') OR contains(lower(translation), 'build'))
    AND contributor IN ('NATION_3', 'NATION_3') AND (category = 'BUILDING' OR perf_category = 'BUILDING') AND confidence = 'Medium'"""))
def library_search(spark, sf):
    """Substring over four fields and all three filters."""
    return library.search_library(B.library(spark, sf), "Build", "NATION_3", "BUILDING", "Medium")


@query(sql("lib", "SELECT rec_id, title FROM lib WHERE contains(lower(title), 'auth') OR contains(lower(contributor), 'auth') OR contains(lower(coalesce(theme, '')), 'auth') OR contains(lower(author), 'auth')"))
def library_view_search(spark, sf):
    """The list view's variant: author instead of translation."""
    return library.search_library(
        B.library(spark, sf), "AUTH", fields=("title", "contributor", "theme", "author")
    ).select("rec_id", "title")


@query(sql("lib", "SELECT DISTINCT 'category' AS facet, category AS value FROM lib UNION SELECT 'perf_category', perf_category FROM lib"))
def facet_values(spark, sf):
    return library.facets(B.library(spark, sf))


@query(sql("lib", """SELECT 'total' AS metric, count(*)::DOUBLE AS value FROM lib UNION ALL SELECT 'matched', count(item_id)::DOUBLE FROM lib
    UNION ALL SELECT 'complete', count(*) FILTER (WHERE status = 'complete')::DOUBLE FROM lib"""))
def enrichment_stats(spark, sf):
    return library.enrichment_stats(B.library(spark, sf))


@query(sql("lib", "SELECT rec_id FROM lib WHERE theme IS NULL AND length(translation) > 14"))
def enrichable_records(spark, sf):
    return library.enrichable(B.library(spark, sf), 14).select("rec_id")


@query(sql("f1", "lib", """+ l AS (SELECT item_id, max(rec_id) AS library_id FROM lib WHERE item_id IS NOT NULL GROUP BY 1)
    SELECT item_id, display, library_id, library_id IS NOT NULL AS in_library FROM f1 LEFT JOIN l USING (item_id)"""))
def marked_in_library(spark, sf):
    """Every item with the library record linked to it."""
    items = B.tagged_items(spark, sf).select("item_id", "display")
    return library.mark_in_library(items, B.library(spark, sf))


AHEAD = """q AS (SELECT DISTINCT lower(q) AS q FROM (SELECT n_name AS q FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT 'omer#' || (c_custkey % 1000) FROM customer)),
    hay AS (SELECT rec_id, q FROM lib JOIN q ON contains(lower(title), q) OR contains(lower(contributor), q) OR contains(lower(coalesce(theme, '')), q)
      WHERE (q, rec_id) NOT IN (SELECT (lower(contributor), rec_id) FROM lib WHERE confidence = 'Low'))"""


@query(sql("lib", f"+{AHEAD} SELECT q AS query_id, rec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rec_id) AS rank FROM hay) WHERE rank <= 8"))
def typeahead(spark, sf):
    """Typed texts against three fields, leaving out records already chosen."""
    c = B.table(spark, sf, "customer")
    typed = B.table(spark, sf, "nation").select(F.col("n_name").alias("q")).union(c.select("c_mktsegment")).union(
        c.select(F.concat(F.lit("omer#"), (F.col("c_custkey") % 1000).cast("string")))
    )
    q = typed.select(F.lower("q").alias("query_id")).distinct().withColumn("q", F.col("query_id"))
    lib = B.library(spark, sf)
    chosen = lib.filter(F.col("confidence") == "Low").select(F.lower("contributor").alias("query_id"), "rec_id")
    return search.typeahead(q, lib, chosen)


def _titles(spark, sf):
    """Titles from the benchmark: its first six words."""
    b = B.table(spark, sf, "benchmark")
    title = F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ")
    return b.select(F.col("item_id").alias("rec_id"), title.alias("title"))


CAND = r"""tt AS (SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(array_to_string(regexp_split_to_array(text, '\s+')[1:6], ' '), '\(.*?\)', '', 'g'), '[^a-zA-Z\s]', '', 'g'))) AS clean FROM benchmark),
    tw AS (SELECT clean, regexp_split_to_array(clean, '\s+') AS w, len(regexp_split_to_array(clean, '\s+')) AS n FROM tt WHERE clean <> ''),
    lw AS (SELECT item_id, line_no, list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(translit, '\(.*?\)', '', 'g'), '[^a-zA-Z\s]', '', 'g'))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM lines),
    h AS (SELECT clean, n, item_id, line_no, CASE WHEN n < 3 OR NOT list_contains(words, w[3]) THEN least(n, 2) WHEN n < 4 OR NOT list_contains(words, w[4]) THEN 3
        WHEN n < 5 OR NOT list_contains(words, w[5]) THEN 4 WHEN n < 6 OR NOT list_contains(words, w[6]) THEN 5 ELSE 6 END AS lead
      FROM tw JOIN lw ON list_contains(words, w[1]) AND (n < 2 OR list_contains(words, w[2]))),
    c AS (SELECT clean, n, count(*) FILTER (WHERE lead >= n) AS c0, count(*) FILTER (WHERE lead >= n - 1) AS c1, count(*) FILTER (WHERE lead >= n - 2) AS c2 FROM h GROUP BY 1, 2),
    u AS (SELECT clean, CASE WHEN n >= 2 AND c0 BETWEEN 1 AND 500 THEN n WHEN n >= 3 AND c1 BETWEEN 1 AND 500 THEN n - 1 WHEN n >= 4 AND c2 BETWEEN 1 AND 500 THEN n - 2 ELSE least(2, n) END AS use FROM c),
    r AS (SELECT clean, item_id, line_no, row_number() OVER (PARTITION BY clean ORDER BY item_id, line_no) AS o FROM h JOIN u USING (clean) WHERE lead >= use)"""


@query(sql("lines", f"+{CAND} SELECT clean, item_id, min(line_no)::BIGINT AS line_no FROM r WHERE o <= 30 GROUP BY 1, 2"))
def title_candidates(spark, sf):
    """Candidate lines of every title from progressively shorter keyword queries."""
    return library.title_candidates(_titles(spark, sf), B.lines(spark, sf))


@query()
def linked_titles(spark, sf):
    """Titles linked to the item of their most similar line."""
    return library.link_titles(_titles(spark, sf), B.lines(spark, sf))


def _folded(e: str) -> str:
    """A text with its vowels and doubled letters folded, in SQL."""
    e = f"trim(lower(regexp_replace({e}, '[^a-zA-Z\\s]', '', 'g')))"
    steps = [("aa+", "a"), ("ee+", "i"), ("oo+", "u"), ("ai", "e"), ("au", "o")]
    for pattern, to in [*steps, *[(f"{c}{c}+", c) for c in ascii_lowercase], ("\\s+", " ")]:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return f"trim({e})"


EDITS = f"""{CAND},
    ca AS (SELECT clean, item_id, min(line_no)::BIGINT AS line_no FROM r WHERE o <= 30 GROUP BY 1, 2),
    cl AS (SELECT clean, item_id, ca.line_no, translit, trim(lower(regexp_replace(translit, '[^a-zA-Z\\s]', '', 'g'))) AS txt FROM ca JOIN lines USING (item_id, line_no)),
    cf AS (SELECT *, {_folded('clean')} AS tn, {_folded('txt')} AS ln,
        list_transform(list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: w <> ''), lambda w: {_folded('w')}) AS tw,
        list_distinct(list_transform(list_filter(regexp_split_to_array(txt, '\\s+'), lambda w: w <> ''), lambda w: {_folded('w')})) AS lw FROM cl),
    wp AS (SELECT DISTINCT w, x FROM (SELECT unnest(tw) AS w, lw FROM cf), unnest(lw) AS u(x)),
    wn AS (SELECT w, list(x) AS xs FROM wp WHERE 1.0::DOUBLE - levenshtein(w, x)::DOUBLE / greatest(length(w), length(x), 1)::DOUBLE > 0.7::DOUBLE GROUP BY w),
    wm AS (SELECT clean, item_id, count(*) AS m FROM (SELECT clean, item_id, unnest(tw) AS w, lw FROM cf) JOIN wn USING (w) WHERE len(list_intersect(xs, lw)) > 0 GROUP BY 1, 2),
    cs AS (SELECT clean, item_id, line_no, CASE WHEN coalesce(translit, '') = '' THEN 0.0 ELSE greatest(
        1.0::DOUBLE - levenshtein(clean, txt)::DOUBLE / greatest(length(clean), length(txt), 1)::DOUBLE,
        1.0::DOUBLE - levenshtein(tn, ln)::DOUBLE / greatest(length(tn), length(ln), 1)::DOUBLE,
        CASE WHEN starts_with(ln, tn[1:12]) THEN 0.85::DOUBLE ELSE 0 END,
        CASE WHEN len(tw) > 0 AND len(lw) > 0 THEN 0.9::DOUBLE * coalesce(m, 0) / len(tw) ELSE 0 END) END AS score
      FROM cf LEFT JOIN wm USING (clean, item_id)),
    cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY score DESC, item_id, line_no) AS nr FROM cs) WHERE nr = 1 AND score >= 0.4::DOUBLE),
    ti AS (SELECT item_id AS rec_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:6], ' ') AS title FROM benchmark),
    tc AS (SELECT *, lower(trim(regexp_replace(regexp_replace(title, '\\(.*?\\)', '', 'g'), '[^a-zA-Z\\s]', '', 'g'))) AS clean FROM ti)"""


@query(sql("lines", f"+{EDITS} SELECT rec_id, title, cb.item_id, round(score, 2) AS match_confidence, CASE WHEN cb.item_id IS NULL THEN 'unmatched' ELSE 'pending' END AS status FROM tc LEFT JOIN cb USING (clean)"))
def linked_titles_by_edits(spark, sf):
    """Titles linked to the item of their most similar line, measured by edit distances."""
    return library.link_titles(_titles(spark, sf), B.lines(spark, sf), measure=similarity.edit_ratio)


# ---- sets ------------------------------------------------------------------------------------


@query(sql("osets", """+ n AS (SELECT *, lead(item_id) OVER w AS next_id, lead(tags) OVER w AS next_tags FROM osets WINDOW w AS (PARTITION BY set_id ORDER BY pos)),
    s AS (SELECT *, list_sort(list_intersect(tags, next_tags)) AS sh FROM n WHERE next_id IS NOT NULL)
    SELECT set_id, pos::BIGINT AS pos, item_id, next_id, array_to_string(sh, ',') AS shared_tags, CASE WHEN len(sh) >= 3 THEN 'STRONG' WHEN len(sh) >= 1 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM s"""))
def transitions(spark, sf):
    """Consecutive orders of each customer with shared tags and strength."""
    return sets.transitions(B.order_sets(spark, sf))


@query("""SELECT conv_id AS set_id, turn AS pos, turn + 1 AS item_id, n AS next_id FROM (SELECT *, lead(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL""")
def conversation_trail(spark, sf):
    """The same over conversations, which come with positions."""
    c = B.table(spark, sf, "conversations")
    rows = c.select(
        F.col("conv_id").alias("set_id"), F.col("turn").alias("pos"), (F.col("turn") + 1).alias("item_id"), F.array("role").alias("tags")
    )
    return sets.transitions(rows).select("set_id", "pos", "item_id", "next_id")


@query(sql("osets", "SELECT DISTINCT set_id, src, dst FROM (SELECT set_id, item_id AS src, lead(item_id) OVER (PARTITION BY set_id ORDER BY pos) AS dst FROM osets) WHERE dst IS NOT NULL"))
def trail_edges(spark, sf):
    return sets.trail_edges(B.order_sets(spark, sf))


@query(sql("osets", """+ c AS (SELECT set_id, tag, count(*) AS n FROM (SELECT set_id, unnest(tags) AS tag FROM osets) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, tag) AS o FROM c)
    SELECT set_id, string_agg(tag, ' & ' ORDER BY o) FILTER (WHERE o <= 2) AS name, max(k) AS n_items FROM r JOIN (SELECT set_id, count(*) AS k FROM osets GROUP BY 1) USING (set_id) GROUP BY 1"""))
def set_names(spark, sf):
    return sets.name_sets(B.order_sets(spark, sf))


@query(sql("osets", """SELECT set_id, 'set ' || set_id AS name, count(*) AS n_items, min(happened) AS created, CASE WHEN set_id % 3 <> 0 THEN max(happened) END AS updated FROM osets GROUP BY 1"""))
def set_list(spark, sf):
    """Saved sets with sizes and times."""
    rows = B.order_sets(spark, sf)
    times = rows.groupBy("set_id").agg(F.min("at").alias("created"), F.max("at").alias("updated"))
    saved = rows.join(times, "set_id").select(
        "set_id", F.concat(F.lit("set "), F.col("set_id").cast("string")).alias("name"), "pos", "item_id", "created",
        F.when(F.col("set_id") % 3 != 0, F.col("updated")).alias("updated"),
    )
    return sets.list_sets(saved)


@query(sql("osets", "f1", """SELECT set_id, pos::BIGINT AS pos, osets.item_id, coalesce(display, '') AS title, coalesce(theme, '') AS theme, array_to_string(coalesce(f1.tags, CAST([] AS VARCHAR[])), ',') AS tags
    FROM osets LEFT JOIN f1 ON f1.item_id = osets.item_id"""))
def set_details(spark, sf):
    """Every listed item with its metadata, in list order; unknown ids stay, empty."""
    from tagweave.operators.graph import item_meta

    items = B.tagged_items(spark, sf)
    none = F.lit(None).cast("string")
    full = items.withColumn("body", none).withColumn("translation", none).withColumn(
        "refrain", F.struct(none.alias("translation"))
    )
    rows = B.order_sets(spark, sf).select("set_id", "pos", "item_id")
    return sets.set_details(rows, item_meta(items), full).select("set_id", "pos", "item_id", "title", "theme", "tags")


GROWN = """old AS (SELECT set_id, pos, item_id FROM osets WHERE year(happened) < 1998),
    fresh AS (SELECT o_custkey AS set_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nr
      FROM orders WHERE (o_custkey, o_orderkey) NOT IN (SELECT (set_id, item_id) FROM old)),
    grown AS (SELECT set_id, pos::BIGINT AS pos, item_id FROM old UNION ALL SELECT set_id, coalesce(b, 0) + nr, item_id
      FROM fresh LEFT JOIN (SELECT set_id, max(pos) + 1 AS b FROM old GROUP BY 1) USING (set_id))"""


def _grown(spark, sf):
    rows = B.order_sets(spark, sf)
    adds = B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("seq")
    )
    return sets.add_to_set(rows.filter(F.year("at") < 1998).select("set_id", "pos", "item_id"), adds)


@query(sql("osets", f"+ {GROWN} SELECT set_id, pos, item_id FROM grown"))
def grown_sets(spark, sf):
    """All orders added to sets that hold the earlier ones; known items are skipped, positions stay dense."""
    return _grown(spark, sf)


@query(sql("osets", f"""+ {GROWN}, n AS (SELECT grown.*, o.tags, lead(grown.item_id) OVER w AS next_id, lead(o.tags) OVER w AS next_tags
      FROM grown JOIN osets o ON o.item_id = grown.item_id WINDOW w AS (PARTITION BY grown.set_id ORDER BY grown.pos))
    SELECT set_id, pos, item_id, next_id, array_to_string(list_sort(list_intersect(tags, next_tags)), ',') AS shared_tags FROM n WHERE next_id IS NOT NULL"""))
def grown_transitions(spark, sf):
    """Transitions of the grown sets: none is lost where additions were skipped."""
    tags = B.order_sets(spark, sf).select("item_id", "tags")
    found = sets.transitions(_grown(spark, sf).join(tags, "item_id"))
    return found.select("set_id", "pos", "item_id", "next_id", "shared_tags")


@query("SELECT p_partkey AS item_id, lower(p_name) AS key, p_name AS first_line, true AS blank FROM part")
def stripped_values(spark, sf):
    """Tabs, line ends and no-break spaces around values count as white space."""
    p = B.table(spark, sf, "part")
    pads = F.array(*[F.lit(x) for x in ("\t", "\r\n", "\u00a0 ", " \x0b", "\u2003")])
    pad = F.element_at(pads, (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("item_id"),
        X.value_key(F.concat(pad, F.upper("p_name"), pad)).alias("key"),
        X.first_body_line(F.concat("p_name", F.lit("\r\nsecond line"))).alias("first_line"),
        X.blank_to_null(pad).isNull().alias("blank"),
    )


# ---- audit -----------------------------------------------------------------------------------

COUNTS = """a AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pre) GROUP BY 1), b AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM post) GROUP BY 1),
    cnt AS (SELECT coalesce(a.tag, b.tag) AS tag, coalesce(a.n, 0) AS n_pre, coalesce(b.n, 0) AS n_post FROM a FULL JOIN b ON a.tag = b.tag)"""


@query(sql("pre", "post", f"+{COUNTS} SELECT tag, n_pre, n_post FROM cnt"))
def snapshot_counts(spark, sf):
    return audit.snapshot_counts(*B.snapshots(spark, sf))


@query(sql("pre", "post", f"+{COUNTS} SELECT tag, n_pre, n_post FROM cnt WHERE n_post > 0 ORDER BY n_post DESC, tag LIMIT 25"))
def top_tags(spark, sf):
    """The twenty-five most used tags of the later snapshot."""
    return audit.top_tags(audit.snapshot_counts(*B.snapshots(spark, sf)))


@query(sql("pre", "post", f"+{COUNTS} SELECT tag, CASE WHEN n_pre = 0 THEN 'added' ELSE 'dropped' END AS change, greatest(n_pre, n_post) AS n FROM cnt WHERE n_pre = 0 OR n_post = 0"))
def taxonomy_diff(spark, sf):
    return audit.taxonomy_diff(*B.snapshots(spark, sf))


def _urgent(tag):
    return F.contains(tag, F.lit("HIGH")) | F.contains(tag, F.lit("URGENT"))


@query(sql("pre", "post", """+ j AS (SELECT post.item_id, coalesce(pre.tags, CAST([] AS VARCHAR[])) AS a, post.tags AS b FROM post LEFT JOIN pre USING (item_id)),
    f AS (SELECT *, len(list_filter(a, lambda t: contains(t, 'HIGH') OR contains(t, 'URGENT'))) > 0 AS before, len(list_filter(b, lambda t: contains(t, 'HIGH') OR contains(t, 'URGENT'))) > 0 AS after FROM j)
    SELECT item_id, array_to_string(a, ',') AS tags_pre, array_to_string(b, ',') AS tags_post, before, after FROM f WHERE before <> after"""))
def family_flips(spark, sf):
    """Customers whose urgent orders appeared or vanished."""
    return audit.family_flips(*B.snapshots(spark, sf), _urgent)


@query(sql("flags", "f1", "SELECT item_id FROM flags WHERE item_id NOT IN (SELECT item_id FROM f1 WHERE vec IS NOT NULL)"))
def missing_refs(spark, sf):
    """Flagged ids that no item with a vector has."""
    return audit.missing_refs(B.item_flags(spark, sf), B.tagged_items(spark, sf).filter(F.col("vec").isNotNull()))


@query(sql("pre", "post", """SELECT s.item_id, s.theme AS theme_post, array_to_string(s.tags, ',') AS tags_post, pre.theme AS theme_pre, array_to_string(pre.tags, ',') AS tags_pre
    FROM (SELECT * FROM post ORDER BY md5(item_id || '-42'), item_id LIMIT 20) s LEFT JOIN pre USING (item_id)"""))
def sample_diff(spark, sf):
    """Twenty sampled customers before and after."""
    return audit.sample_diff(*B.snapshots(spark, sf))


@query(sql("f1", "SELECT item_id, display FROM f1 ORDER BY md5(item_id || '-7'), item_id LIMIT 1"))
def random_item(spark, sf):
    return audit.sample_n(B.tagged_items(spark, sf), 1, 7).select("item_id", "display")
