"""Queries pN_... of the training-data operators, and their SQL twins where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.names import _NARROW, _WIDE, name_key
from corpusloom.tables import broadcast_if_small, table

from . import caps, cutoff, encode, leakage, neardup, pairs, quota, topn
from .candidates import RANK, present_name, rank_columns, scenes, with_scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _sql_key(x: str) -> str:
    folded = f"lower(translate(regexp_replace({x}, '[\\p{{Cf}}]', '', 'g'), '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_NARROW.replace(chr(39), chr(39) * 2)}'))"
    parts = f"list_filter(string_split_regex({folded}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: w <> '')"
    own = f"(CASE WHEN len({parts}) > 1 AND ({parts})[1] = 'by' THEN ({parts})[2:] ELSE {parts} END)"
    return f"nullif(array_to_string(list_sort({own}), ' '), '')"


_SQL_RANK = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN 1 ELSE 0 END, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END DESC, tie_hash ASC NULLS LAST, id"
_SQL_ONE = f"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY recalled_at DESC) AS rn FROM candidates) WHERE rn = 1)"""
_SQL_SCENE = f"dims AS (SELECT {_sql_key('scene_key')} AS k, scene_key, top_key, quota FROM sub_scenes UNION SELECT {_sql_key('label')}, scene_key, top_key, quota FROM sub_scenes)"


# 1. capping records per dominant contributor


def _capped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "candidates").select(
        F.col("run_id").alias("_group"),
        present_name("source_author").alias("_author"),
        F.coalesce(present_name("source_name", missing=()), F.lit("")).alias("_source"),
        *rank_columns(),
        F.coalesce(F.col("recalled_at"), F.timestamp_seconds(F.lit(0))).alias("_seen"),
    )
    return caps.cap_contributors(rows, [("_author", 100), ("_source", 20)])


@query(
    f"""WITH {_SQL_ONE}, keyed AS (
  SELECT *, CASE WHEN trim(source_author) = '\\N' THEN NULL ELSE {_sql_key('source_author')} END AS a, {_sql_key('source_name')} AS s, count(*) OVER (PARTITION BY run_id) AS n FROM one),
by_author AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY run_id, a ORDER BY {_SQL_RANK}) END AS ra FROM keyed),
lefts AS (SELECT *, row_number() OVER (PARTITION BY run_id, s ORDER BY {_SQL_RANK}) AS rs FROM by_author WHERE ra <= greatest(1, n // 100))
SELECT run_id, id FROM one WHERE (run_id, id) NOT IN (SELECT (run_id, id) FROM lefts WHERE rs <= greatest(1, n // 20))"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the author limit (n/100 of a run) or then the source limit (n/20) removes."""
    _, removed = _capped(spark, d)
    return removed.select(F.col("_group").alias("run_id"), F.col("_id").alias("id"))


# 2. top N items within every group


@query(
    f"""WITH {_SQL_ONE}, {_SQL_SCENE}, placed AS (
  SELECT run_id, id, row_number() OVER (PARTITION BY run_id, scene_key ORDER BY {_SQL_RANK}) AS place FROM one JOIN dims ON {_sql_key('sub_scene')} = k)
SELECT run_id, id FROM placed WHERE place <= 3"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best rows of each run and scene."""
    rows = table(spark, d, "candidates").select("run_id", "sub_scene", *rank_columns())
    best = topn.top_n(with_scene(rows, spark, d), ["run_id", "scene_key"], RANK, 3)
    return best.select("run_id", F.col("_id").alias("id"))


# 3. sample matching target category proportions


#: Lower ends of the bands of confidence that cross-classify scenes; rows without a confidence are a band of their own.
BANDS = (0.8, 0.6, 0.4)
STRATA = len(BANDS) + 2


def _quota_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Candidates by scene, if the top scene is that scene's, and band of confidence; and the scenes' quotas."""
    band = F.when(F.isnan("confidence"), STRATA - 1)
    for i, least in enumerate(BANDS):
        band = band.when(F.col("confidence") >= least, i)
    band = band.when(F.col("confidence").isNotNull(), len(BANDS))
    dims = scenes(spark, d).filter(F.col("quota") > 0)
    weights = [(r["scene_key"], r["quota"]) for r in dims.select("scene_key", "quota").distinct().orderBy("scene_key").limit(10_001).collect()]
    sound = dims.select("_scene_name", F.col("scene_key").alias("category"), name_key(F.col("_top")).alias("_top_name"))
    rows = table(spark, d, "candidates").select(
        F.col("run_id").alias("_group"),
        F.col("id").alias("_id"),
        name_key(F.col("sub_scene")).alias("_scene_name"),
        name_key(F.col("top_scene")).alias("_top_name"),
        band.alias("stratum"),
    )
    return rows.join(broadcast_if_small(sound), ["_scene_name", "_top_name"], "left").select("_group", "_id", "category", "stratum"), weights


@query(
    f"""WITH {_SQL_SCENE}, goal AS (SELECT scene_key, {_sql_key('top_key')} AS top, quota, sum(quota) OVER () AS total FROM sub_scenes WHERE quota > 0),
runs AS (SELECT run_id, count(DISTINCT id) AS n FROM candidates GROUP BY run_id),
have AS (SELECT c.run_id, d.scene_key, count(DISTINCT c.id) AS got FROM candidates c JOIN dims d ON {_sql_key('c.sub_scene')} = d.k AND {_sql_key('c.top_scene')} = {_sql_key('d.top_key')} GROUP BY ALL)
SELECT run_id, scene_key FROM runs CROSS JOIN goal LEFT JOIN have USING (run_id, scene_key)
WHERE coalesce(got, 0) < greatest(2, ((n // 5) * quota) // total)"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Scenes whose target cannot be met in a run: those with flow on their slack arc."""
    rows, weights = _quota_rows(spark, d)
    plan = quota.quota_plan(rows, weights, STRATA, share=5, floor=2)
    return plan.filter(F.col("shortfall") > 0).select(F.col("_group").alias("run_id"), F.col("category").alias("scene_key")).distinct()


@query()
def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn sample: rows of each run whose scene shares follow the quotas, and whose bands of confidence those of the run."""
    rows, weights = _quota_rows(spark, d)
    plan = quota.quota_plan(rows, weights, STRATA, share=5, floor=2)
    return quota.draw(rows, plan, STRATA).select(F.col("_group").alias("run_id"), F.col("_id").alias("id"), F.col("category").alias("scene_key"))


# 4. near-duplicate records with small edits


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of sentences that share at least 70 % of their words."""
    links, members = neardup.near_duplicates(table(spark, d, "sentences"), t=0.7)
    return neardup.expand_pairs(links, members)


@query()
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each sentence with the class of near-duplicates it belongs to and its number of similar word sets."""
    links, members = neardup.near_duplicates(table(spark, d, "sentences"), t=0.7)
    return neardup.classes(links, members)


# 5. broken prompt and response pairs


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective translations with their type of defect."""
    return pairs.broken_pairs(table(spark, d, "sentences"))


# 6. encoding of the whole corpus with a public tokenizer


@query()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents"))


# 7. evaluation texts leaking into training text


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least eight consecutive words of a benchmark item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), size=8)


@query()
def p7_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 24 consecutive words of a benchmark item under one renaming of its numbers, units and names."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), size=24, renamed=True)


# 8. text cut off by field limits


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored text ends before its original did."""
    return cutoff.cut_off(table(spark, d, "documents")).select("doc_id")


@query()
def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source's texts are cut off."""
    return cutoff.cut_rates(cutoff.score_texts(table(spark, d, "documents")))
