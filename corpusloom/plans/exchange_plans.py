"""Queries over exchanges, capacity and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import exchange as X
from corpusloom.operators import publish as B
from corpusloom.tables import table

from . import sqltext as S
from .recall_plans import sql_variants
from .registry import query
from .selection_plans import _SQL_POOL, selection_pool


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50 AND event_type = 'purchase'")
def json_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a value inside a JSON payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").filter((F.col("event_type") == "purchase") & (k >= 50)).select("event_id", k.alias("k"))


@query("""SELECT id, '{"lang":"zh","scene":' || to_json(sub_scene_key) || ',"text":' || to_json(id) || '}' AS payload FROM sentences WHERE sub_scene_key IS NOT NULL""")
def canonical_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sentences").filter("sub_scene_key IS NOT NULL")
    return rows.select("id", X.canonical_json(text=F.col("id"), scene=F.col("sub_scene_key"), lang=F.lit("zh")).alias("payload"))


@query(
    """WITH c AS (SELECT source_name AS family, id, floor((row_number() OVER w - 1) / 100) AS r, floor((sum(strlen(text) + 1) OVER (PARTITION BY source_name ORDER BY id ROWS UNBOUNDED PRECEDING) - 1) / 4000) AS b FROM raw_items WHERE text IS NOT NULL WINDOW w AS (PARTITION BY source_name ORDER BY id))
SELECT family, id, CAST(dense_rank() OVER (PARTITION BY family ORDER BY r, b) - 1 AS INT) AS chunk FROM c"""
)
def exchange_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Requests in files of at most 100 rows and about 4,000 bytes a family."""
    rows = table(spark, d, "raw_items").filter("text IS NOT NULL").select(F.col("source_name").alias("family"), "id", "text")
    return X.chunks(rows, "family", "id", "text", most_rows=100, most_bytes=4000).select("family", "id", "chunk")


@query(
    """SELECT c.run_id, c.id, CASE WHEN confidence IS NULL OR isnan(confidence) OR NOT confidence BETWEEN 0 AND 1 THEN 'confidence' WHEN (sub_scene IS NULL) <> (top_scene IS NULL) THEN 'half a scene' WHEN sub_scene IS NOT NULL AND s.top_key IS NULL THEN 'unknown scene' WHEN s.top_key <> top_scene THEN 'foreign top scene' END AS problem
FROM candidates c LEFT JOIN sub_scenes s ON s.scene_key = c.sub_scene WHERE problem IS NOT NULL"""
)
def payload_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select(F.struct("run_id", "id").alias("id"), "confidence", "sub_scene", "top_scene")
    return X.payload_problems(rows, table(spark, d, "sub_scenes")).select("id.run_id", "id.id", "problem")


@query(
    f"""WITH {_SQL_POOL}, used AS (SELECT * FROM pool WHERE protected), s AS (SELECT source_name, count(*) AS n FROM used GROUP BY 1), a AS (SELECT source_author, count(*) AS n FROM used WHERE source_author <> '' GROUP BY 1)
SELECT scene, id FROM pool LEFT JOIN s USING (source_name) LEFT JOIN a USING (source_author) WHERE NOT protected AND coalesce(s.n, 0) < 5 AND coalesce(a.n, 0) < 2"""
)
def capacity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose source and author are not used up by the protected ones."""
    pool = selection_pool(spark, d)
    return X.with_capacity(pool.filter("NOT protected"), pool.filter("protected"), source_limit=5, author_limit=2).select("scene", "id")


_MARKERS, _OPENERS, _CONNECTORS = ["listen to", "write down", "you will hear"], ["a)", "section", "did "], ["and", "in"]


@query(
    f"""SELECT id, NOT (len(list_filter({_MARKERS!r}, lambda m: contains(lower(text), m))) > 0 OR len(list_filter({_OPENERS!r}, lambda m: starts_with(lower(text), m))) > 0 OR len(list_filter({_CONNECTORS!r}, lambda m: ends_with(lower(text), ' ' || m))) > 0 OR regexp_matches(text, '[\\x{{4E00}}-\\x{{9FFF}}]|_{{2,}}|[.]{{4,}}')) AS authentic FROM sentences"""
)
def authentic_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").select("id", X.authentic(F.col("text"), _MARKERS, openers=_OPENERS, connectors=_CONNECTORS).alias("authentic"))


@query("SELECT CASE WHEN source_name LIKE '%Bank' OR source_name LIKE '%Pool' THEN 'simulated' ELSE 'authentic' END AS kind, count(*) AS n, count(DISTINCT source_name) AS sources FROM sentences GROUP BY 1")
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("source_name").like("%Bank") | F.col("source_name").like("%Pool"), "simulated").otherwise("authentic")
    return table(spark, d, "sentences").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("sources"))


@query("SELECT doc_id, CASE WHEN regexp_extract(text, '(20[0-9]{2})[^0-9]{0,3}([0-9]{1,2})', 1) <> '' THEN regexp_extract(text, '(20[0-9]{2})[^0-9]{0,3}([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(text, '(20[0-9]{2})[^0-9]{0,3}([0-9]{1,2})', 2), 2, '0') END AS session FROM documents WHERE text IS NOT NULL")
def exam_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.exam_session(F.col("text")).alias("session"))


@query("SELECT id, substr(text, 1, 7) AS before, substr(text, 16) AS after FROM sentences")
def span_context(spark: SparkSession, d: str) -> DataFrame:
    """What stands around the span of code points 7 to 15."""
    before, after = X.around(F.col("text"), F.lit(7), F.lit(15))
    return table(spark, d, "sentences").select("id", before.alias("before"), after.alias("after"))


_SQL_PUBLISH = f"""{_SQL_POOL}, sel AS (SELECT id, min(scene) AS scene FROM pool WHERE confidence >= 0.8 GROUP BY id), tr AS (SELECT r.id, min(s.translation_zh) AS translation_zh FROM raw_items r JOIN sentences s ON s.source_name = r.source_name AND s.source_item_id = r.source_item_id GROUP BY r.id)"""


@query(
    f"""WITH {_SQL_PUBLISH} SELECT r.id, sel.scene, tr.translation_zh IS NOT NULL AS complete FROM raw_items r JOIN sel USING (id) LEFT JOIN tr USING (id) WHERE r.id NOT IN (SELECT item_id FROM rejections)"""
)
def publish_rows(spark: SparkSession, d: str) -> DataFrame:
    """Selected items joined with their translations by source item, without the rejected ones."""
    items, s = table(spark, d, "raw_items"), table(spark, d, "sentences")
    selected = selection_pool(spark, d).filter("confidence >= 0.8").groupBy("id").agg(F.min("scene").alias("scene"))
    translated = items.select("id", "source_name", "source_item_id").join(s.select("source_name", "source_item_id", "translation_zh"), ["source_name", "source_item_id"]).groupBy("id").agg(F.min("translation_zh").alias("translation_zh"))
    return B.rows_to_publish(items.select("id"), selected, translated, table(spark, d, "rejections")).select("id", "scene", "complete")


@query(
    f"""WITH h AS (SELECT id, sha256({S.normalized('text')}) AS h FROM raw_items WHERE text IS NOT NULL), t AS (SELECT h, count(*) OVER (PARTITION BY substr(h, 1, 16)) AS n FROM (SELECT DISTINCT h FROM h))
SELECT id, 's_' || substr(h, 1, CASE WHEN n > 1 THEN 24 ELSE 16 END) AS stable_id, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT) AS random_key FROM h JOIN t USING (h)"""
)
def publish_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_items").filter("text IS NOT NULL").select("id", "text")
    return B.allocate_ids(rows).select("id", "stable_id", "random_key")


_SQL_STORE = f"""SELECT 's_' || substr(h, 1, CASE WHEN count(*) OVER (PARTITION BY substr(h, 1, 16)) > 1 THEN 24 ELSE 16 END) AS id, t FROM (SELECT h, min(c) AS t FROM (SELECT {S.clean('text')} AS c, sha256(lower({S.clean('text')})) AS h FROM sentences) GROUP BY h)"""


@query(f"SELECT id || '-' || difficulty AS id, id AS sentence_id, * EXCLUDE (id, alias) FROM ({sql_variants(_SQL_STORE)})")
def published_variants(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the store that the sentences make; of texts that differ in case alone the least is published."""
    texts = table(spark, d, "sentences").select(T.clean(F.col("text")).alias("text")).groupBy(T.normalized_hash(F.col("text")).alias("h")).agg(F.min("text").alias("text"))
    return B.question_store(B.allocate_ids(texts.select("text")))["question_variants"]


@query()
def curated_items(spark: SparkSession, d: str) -> DataFrame:
    """A balanced curation: ten items of each scene, near-duplicates skipped."""
    rows = table(spark, d, "raw_items").filter("sub_scene IS NOT NULL AND text IS NOT NULL").select(F.col("sub_scene").alias("category"), "id", "text")
    return B.curate(rows, quota=10).select("category", "id", "place")


@query(
    f"""SELECT id, CASE WHEN {S.collapse("coalesce(translation_zh, '')")} = '' THEN 'no translation' WHEN random_key % 3 = 0 AND {S.collapse("coalesce(source_author, '')")} = '' THEN 'no review note' END AS problem FROM sentences WHERE problem IS NOT NULL"""
)
def translation_problems(spark: SparkSession, d: str) -> DataFrame:
    """Translations that may not be published; those with keys divisible by three count as repaired, the author as its note."""
    rows = table(spark, d, "sentences").select("id", "translation_zh", F.array().cast("array<string>").alias("issues"), F.col("source_author").alias("review_note"), (F.col("random_key") % 3 == 0).alias("repaired"))
    return X.translation_problems(rows)
