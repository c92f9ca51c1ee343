"""The candidates table as the ranking operators read it: canonical names, scenes and rank columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.names import name_key
from corpusloom.tables import broadcast_if_small, table

#: Columns that rank a row, best first; nulls come last in each of them.
RANK = ("_worse", "_tie", "_id")


def rank_columns(confidence: str = "confidence", tie: str = "tie_hash", ident: str = "id") -> list[Column]:
    """``_worse`` (negated confidence; null for null and NaN), ``_tie`` and ``_id``: ascending, nulls last, is best first."""
    score = F.col(confidence).cast("double")
    return [
        F.when(~F.isnan(score), -score).alias("_worse"),
        F.col(tie).cast("string").alias("_tie"),
        F.col(ident).cast("bigint").alias("_id"),
    ]


def present_name(name: str, missing: tuple[str, ...] = ("\\N",)) -> Column:
    """The key of a name; null where it is null, blank or one of the marks for a missing value."""
    return name_key(F.when(~F.trim(F.col(name)).isin(*missing), F.col(name)))


def scenes(spark: SparkSession, directory: str) -> DataFrame:
    """Every spelling key (of scene_key and of label) with its scene, that scene's top key and quota."""
    sub = table(spark, directory, "sub_scenes").filter(F.col("scene_key").isNotNull())
    each = sub.select(
        F.explode(F.array("scene_key", "label")).alias("_spelled"), "scene_key", F.col("top_key").alias("_top"), "quota"
    )
    return each.select(name_key(F.col("_spelled")).alias("_scene_name"), "scene_key", "_top", "quota").filter(
        F.col("_scene_name").isNotNull()
    ).dropDuplicates(["_scene_name"])


def with_scene(rows: DataFrame, spark: SparkSession, directory: str, scene: str = "sub_scene") -> DataFrame:
    """Rows whose scene names a known one, with ``scene_key`` and ``_top``; the others are dropped."""
    dims = broadcast_if_small(scenes(spark, directory).select("_scene_name", "scene_key", "_top"))
    return rows.withColumn("_scene_name", name_key(F.col(scene))).join(dims, "_scene_name").drop("_scene_name")
