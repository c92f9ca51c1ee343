"""The question store: scene tree, sampling, lookups, published reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACE
from corpusloom.tables import broadcast_if_small


def scene_tree(tops: DataFrame, subs: DataFrame) -> DataFrame:
    """(top_key, label, scenes): the sub-scenes of each top scene in their order."""
    each = tops.select("top_key", "label", F.col("sort_order").alias("_top")).join(subs.select("top_key", "scene_key", "sort_order"), "top_key")
    lists = each.groupBy("top_key", "label", "_top").agg(F.array_sort(F.collect_list(F.struct("sort_order", "scene_key"))).alias("s"))
    return lists.select("top_key", "label", F.transform("s", lambda x: x["scene_key"]).alias("scenes"))


def circular_sample(sentences: DataFrame, *, seed: int, limit: int, scenes: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``limit`` sentences by random key from ``seed`` upwards, then from zero: a bounded top-k, no full sort.

    Optional predicates are added only where they are given.
    """
    if limit < 1 or seed < 0:
        raise ValueError("limit must be positive and seed not negative")
    rows = sentences
    if scenes is not None:
        rows = rows.filter(F.col("sub_scene_key").isin(scenes))
    if exclude:
        rows = rows.filter(~F.col("id").isin(exclude))
    return rows.orderBy((F.col("random_key") < seed).cast("int"), "random_key", "id").limit(limit)


def ordered_lookup(sentences: DataFrame, ids: list[str]) -> DataFrame:
    """Sentences in the order of the ids asked for: repeated ids repeat, unknown ones are left out.

    The ids are a filter that reaches the scan, so a table sorted or bucketed by id is read in part; only the rows found
    are sorted. At most 10,000 ids, as they stand in the plan.
    """
    if len(ids) > 10_000:
        raise ValueError("ordered_lookup is for at most 10,000 ids; join larger sets")
    places: dict[str, list[int]] = {}
    for i, x in enumerate(ids):
        places.setdefault(x, []).append(i)
    found = sentences.filter(F.col("id").isin(list(places)))
    if not places:
        return found.withColumn("position", F.lit(0))
    at = F.create_map(*[c for x, ps in places.items() for c in (F.lit(x), F.array(*map(F.lit, ps)))])
    return found.withColumn("position", F.explode(F.element_at(at, F.col("id")))).coalesce(1).sortWithinPartitions("position")


def distribution(facts: DataFrame, key: str, dimension: DataFrame, name: str) -> DataFrame:
    """(dimension, key, n) for every key of a dimension, zero included."""
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    dense = broadcast_if_small(dimension.select(key).distinct()).join(n, key, "left")
    return dense.select(F.lit(name).alias("dimension"), F.col(key).alias("key"), F.coalesce("n", F.lit(0)).alias("n"))


def legacy_ids(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """Rows with the identifier that their hash had before, else their own."""
    known = legacy.groupBy("normalized_hash").agg(F.min("id").alias("legacy_id"))
    return rows.join(known, "normalized_hash", "left").withColumn("id", F.coalesce("legacy_id", "id")).drop("legacy_id")


def publish_problems(rows: DataFrame) -> DataFrame:
    """(id, problem): what keeps a row from being published."""
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), SPACE, "") == ""
    problem = F.when(blank("text"), "text").when(blank("translation_zh"), "translation").when(blank("source_name") | blank("license_name"), "provenance").when(~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "url").when(F.col("random_key") < 0, "random_key")
    return rows.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


def duplicate_rate(rows: DataFrame) -> DataFrame:
    """(texts, different, rate): the measured share of texts that repeat another's normalised form."""
    n = rows.agg(F.count("*").alias("texts"), F.countDistinct("hash").alias("different"))
    return n.withColumn("rate", F.round(1 - F.col("different") / F.greatest("texts", F.lit(1)), 6))
