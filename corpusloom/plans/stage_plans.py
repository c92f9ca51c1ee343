"""Queries over stage tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import stages
from corpusloom.tables import table

from .registry import query


@query("SELECT 'raw' AS stage, count(*) AS n FROM raw_items UNION ALL SELECT 'recalled', count(DISTINCT id) FROM candidates UNION ALL SELECT 'rejected_' || stage, count(DISTINCT item_id) FROM rejections GROUP BY stage")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage_counts(table(spark, d, "raw_items"), table(spark, d, "rejections"), {"recalled": table(spark, d, "candidates")})


@query("SELECT stage, split_part(reason, ':', 1) AS kind, count(DISTINCT item_id) AS n FROM rejections GROUP BY ALL")
def rejection_kinds(spark: SparkSession, d: str) -> DataFrame:
    return stages.reason_counts(table(spark, d, "rejections"))


@query("SELECT item_id, stage, reason FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC NULLS LAST, stage, reason) AS n FROM rejections) WHERE n = 1")
def latest_rejections(spark: SparkSession, d: str) -> DataFrame:
    return stages.latest_rejections(table(spark, d, "rejections")).select("item_id", "stage", "reason")


@query("SELECT r.id FROM raw_items r WHERE r.id IN (SELECT id FROM candidates) AND r.id NOT IN (SELECT item_id FROM rejections) AND r.id NOT IN (SELECT id FROM candidates WHERE confidence >= 0.9) ORDER BY r.id LIMIT 1000")
def pending_claim(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand items that were recalled, are not rejected and have no confident class yet."""
    c = table(spark, d, "candidates")
    return stages.pending(table(spark, d, "raw_items").select("id"), c, c.filter("confidence >= 0.9"), table(spark, d, "rejections"), 1000)


@query("SELECT r.id, c.run_id, c.sub_scene FROM raw_items r JOIN (SELECT DISTINCT id, run_id, sub_scene FROM candidates WHERE confidence >= 0.5) c USING (id) WHERE NOT EXISTS (SELECT 1 FROM rejections x WHERE x.item_id = r.id)")
def selection_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Items with their classification, without the rejected ones."""
    c = table(spark, d, "candidates").filter("confidence >= 0.5").select("id", "run_id", "sub_scene").distinct()
    gone = table(spark, d, "rejections").select(F.col("item_id").alias("id"))
    return table(spark, d, "raw_items").select("id").join(c, "id").join(gone, "id", "left_anti").select("id", "run_id", "sub_scene")


@query(
    """WITH o AS (SELECT source_name, source_item_id, arg_min(text, id) AS text FROM raw_items GROUP BY ALL), n AS (SELECT source_name, source_item_id, arg_max(text, id) AS text FROM raw_items WHERE id % 2 = 0 GROUP BY ALL)
SELECT source_name, source_item_id, CASE WHEN o.source_item_id IS NULL THEN 'insert' WHEN n.source_item_id IS NULL THEN 'keep' WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'update' END AS action,
CASE WHEN n.source_item_id IS NOT NULL THEN n.text ELSE o.text END AS text FROM o FULL JOIN n USING (source_name, source_item_id)"""
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merge of a later delivery (here: the rows with even ids) into the first delivery of every natural key."""
    keys = ["source_name", "source_item_id"]
    items = table(spark, d, "raw_items")
    old = items.groupBy(keys).agg(F.min_by("text", "id").alias("text"))
    new = items.filter("id % 2 = 0").groupBy(keys).agg(F.max_by("text", "id").alias("text"))
    return stages.merge_items(old, new, keys, ["text"])


@query("SELECT item_id, stage, reason FROM rejections WHERE item_id NOT IN (SELECT id FROM raw_items WHERE source_name = 'Quarry Sentence Bank')")
def delete_source_cascade(spark: SparkSession, d: str) -> DataFrame:
    left = stages.without_source({"rejections": table(spark, d, "rejections")}, table(spark, d, "raw_items"), "Quarry Sentence Bank")
    return left["rejections"].select("item_id", "stage", "reason")


@query("SELECT item_id, 'not_eligible' AS problem FROM rejections WHERE item_id NOT IN (SELECT id FROM candidates) UNION ALL SELECT r.item_id, 'accepted_and_rejected' FROM (SELECT DISTINCT id AS item_id FROM candidates) r WHERE r.item_id IN (SELECT item_id FROM rejections)")
def checkpoint_violations(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "candidates").select(F.col("id").alias("item_id")).distinct()
    return stages.checkpoint_violations(results, table(spark, d, "rejections"), results)


@query(
    """WITH rows AS (SELECT id AS k, id // 65536 AS b, sha256(concat_ws(chr(31), CAST(id AS VARCHAR), source_name, coalesce(source_author, chr(0)), text)) AS h FROM raw_items),
g AS (SELECT b, count(*) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM rows GROUP BY b) SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM g"""
)
def dataset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "raw_items").select("id", "source_name", "source_author", "text")
    return stages.fingerprint(items, "id", ["id", "source_name", "source_author", "text"])


@query(
    """SELECT source_name, count(*) AS items, count(DISTINCT license_name) AS licences, count(DISTINCT source_author) AS authors,
count(*) FILTER (WHERE coalesce(trim(source_author), '') IN ('', '\\N') OR coalesce(trim(source_url), '') = '' OR coalesce(trim(license_name), '') = '') AS missing_provenance FROM raw_items GROUP BY source_name"""
)
def source_report(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c, *marks: F.coalesce(F.trim(c), F.lit("")).isin("", *marks)
    missing = blank("source_author", "\\N") | blank("source_url") | blank("license_name")
    return table(spark, d, "raw_items").groupBy("source_name").agg(
        F.count("*").alias("items"), F.countDistinct("license_name").alias("licences"), F.countDistinct("source_author").alias("authors"), F.count_if(missing).alias("missing_provenance")
    )


@query("SELECT source_name, license_name, license_url, source_author, count(*) AS n FROM sentences GROUP BY ALL")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").groupBy("source_name", "license_name", "license_url", "source_author").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT normalized_hash) AS hashes, count(*) = count(DISTINCT id) AS ids_unique FROM sentences")
def uniqueness_check(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "sentences").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.countDistinct("normalized_hash").alias("hashes"))
    return counted.withColumn("ids_unique", F.col("rows") == F.col("ids"))


@query("SELECT id, source_name FROM (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY id) AS n FROM raw_items) WHERE n <= 25")
def first_items_per_source(spark: SparkSession, d: str) -> DataFrame:
    """At most 25 items of each source, a limit that imports set."""
    n = F.row_number().over(Window.partitionBy("source_name").orderBy("id"))
    return table(spark, d, "raw_items").select("id", "source_name", n.alias("n")).filter("n <= 25").select("id", "source_name")


@query("SELECT id FROM raw_items WHERE coalesce(trim(source_name), '') = '' OR coalesce(trim(source_item_id), '') = '' OR coalesce(trim(source_author), '') IN ('', '\\N') OR coalesce(trim(license_name), '') = '' OR NOT coalesce(source_url LIKE 'https://%', false)")
def provenance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Items that lack a part of their provenance."""
    blank = lambda c, *marks: F.coalesce(F.trim(c), F.lit("")).isin("", *marks)
    lacking = blank("source_name") | blank("source_item_id") | blank("source_author", "\\N") | blank("license_name") | ~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))
    return table(spark, d, "raw_items").filter(lacking).select("id")


_SQL_OWN = "own AS (SELECT id, 'v' || (max(run_id) % 3) AS version, CASE WHEN bool_or(coalesce(protected, false)) THEN 'source_explicit' ELSE 'keyword' END AS method FROM candidates GROUP BY id)"


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Results of a classify stage: the version of an item is made of its last run."""
    method = F.when(F.bool_or(F.coalesce("protected", F.lit(False))), "source_explicit").otherwise("keyword")
    return table(spark, d, "candidates").groupBy("id").agg(F.concat(F.lit("v"), F.max("run_id") % 3).alias("version"), method.alias("method"))


@query(f"WITH {_SQL_OWN} SELECT id FROM raw_items WHERE id NOT IN (SELECT id FROM own WHERE version = 'v2' OR method = 'source_explicit') AND id NOT IN (SELECT item_id FROM rejections WHERE item_id IS NOT NULL)")
def pending_versioned(spark: SparkSession, d: str) -> DataFrame:
    """Items to classify by version v2 of the model: those of older versions are stale, unless a source decided them."""
    return stages.pending(table(spark, d, "raw_items").select("id"), None, _own(spark, d), table(spark, d, "rejections"), version="v2", authoritative=("source_explicit",))


@query(
    """WITH o AS (SELECT source_name, source_item_id, arg_min(text, id) AS text, min(id) AS item_id FROM raw_items GROUP BY ALL), n AS (SELECT source_name, source_item_id, arg_max(text, id) AS text FROM raw_items WHERE id % 2 = 0 GROUP BY ALL),
changed AS (SELECT item_id FROM o JOIN n USING (source_name, source_item_id) WHERE o.text IS DISTINCT FROM n.text) SELECT id AS item_id, run_id FROM candidates WHERE id NOT IN (SELECT item_id FROM changed)"""
)
def upsert_invalidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that stay after a later delivery has changed the text of some items."""
    keys = ["source_name", "source_item_id"]
    items = table(spark, d, "raw_items")
    old = items.groupBy(keys).agg(F.min_by("text", "id").alias("text"), F.min("id").alias("item_id"))
    new = items.filter("id % 2 = 0").groupBy(keys).agg(F.max_by("text", "id").alias("text"))
    changed = stages.merge_items(old.drop("item_id"), new, keys, ["text"]).filter("action = 'update'").join(old.select(*keys, "item_id"), keys)
    derived = {"candidates": table(spark, d, "candidates").select(F.col("id").alias("item_id"), "run_id")}
    return stages.invalidated(derived, changed)["candidates"]


@query("SELECT event_id, json_merge_patch(props, json_object('kind', event_type, 'k', value > 50)) AS props FROM events")
def json_fields_set(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with one field replaced and one added, as a migration of stored results does."""
    fields = F.struct(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("k"))
    return table(spark, d, "events").select("event_id", stages.set_json_fields(F.col("props"), fields).alias("props"))
