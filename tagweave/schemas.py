"""Explicit schemas of the tables the jobs read and write."""

ITEMS = (
    "item_id BIGINT, page INT, category STRING, author STRING, display STRING, body STRING, "
    "translation STRING, translit STRING, theme STRING, mood STRING, summary STRING, "
    "tags ARRAY<STRING>, tags_source STRING, "
    "refrain STRUCT<body: STRING, translation: STRING, start: INT, end: INT>"
)
LINES = (
    "item_id BIGINT, page INT, line_no INT, category STRING, author STRING, "
    "body STRING, translit STRING, translation STRING"
)
LIBRARY = (
    "rec_id BIGINT, title STRING, contributor STRING, perf_category STRING, style STRING, "
    "confidence STRING, link STRING, notes STRING, page INT, category STRING, author STRING, "
    "body STRING, translation STRING, translit STRING, item_id BIGINT, theme STRING, "
    "secondary_themes ARRAY<STRING>, occasions ARRAY<STRING>, mood STRING, summary STRING, "
    "match_confidence DOUBLE, status STRING"
)
SYNONYMS = "ordinal BIGINT, canonical STRING, variant STRING"
ANNOTATIONS = (
    "item_id BIGINT, annotator STRING, theme STRING, mood STRING, summary STRING, "
    "tags ARRAY<STRING>, reasoning STRING, elapsed_s DOUBLE, constrained BOOLEAN, error STRING"
)
TAG_SCORES = (
    "item_id BIGINT, scorer STRING, scores MAP<STRING, STRING>, suggested ARRAY<STRING>"
)
COLLECTION_ENTRIES = "item_id BIGINT, header_id BIGINT, source STRING"
EMBEDDINGS = "item_id BIGINT, vec ARRAY<FLOAT>"
EDGES = "src BIGINT, dst BIGINT, score DOUBLE, shared_tags ARRAY<STRING>, rank INT"
SAVED_SETS = (
    "set_id BIGINT, name STRING, pos INT, item_id BIGINT, created TIMESTAMP, updated TIMESTAMP"
)

_LINE = (
    "STRUCT<shabadId: BIGINT, pageNo: INT, verse: STRUCT<unicode: STRING>, "
    "transliteration: STRUCT<en: STRING>, "
    "translation: STRUCT<en: STRUCT<bdb: STRING, ms: STRING, ssk: STRING>>, "
    "raag: STRUCT<english: STRING>, writer: STRUCT<english: STRING>>"
)
# Fixed value: field names of the nested page payload.
PAGE_PAYLOAD = f"page ARRAY<{_LINE}>"
ANNOTATION_JSON = (
    "primary_theme STRING, mood STRING, brief_meaning STRING, tags STRING, reasoning STRING"
)
BATCH_JSON = (
    "results ARRAY<STRUCT<index: INT, id: STRING, primary_theme: STRING, mood: STRING, "
    "brief_meaning: STRING, tags: STRING>>"
)
VOCABULARY_JSON = (
    "theme_tags MAP<STRING, STRUCT<description: STRING, gurbani_term: STRING, "
    "raw_themes: ARRAY<STRING>, count: BIGINT>>, "
    "mood_tags MAP<STRING, STRUCT<description: STRING, gurbani_term: STRING, "
    "raw_themes: ARRAY<STRING>, count: BIGINT>>"
)
