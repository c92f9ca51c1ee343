"""The exchange with reviewers: suggestions out, decisions in, each with a defined outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.stages import invalidated
from corpusloom.tables import with_places


def merge_suggestions(suggestions: DataFrame, *, most: int | None = None) -> DataFrame:
    """(item_id, family, scenes, n): an item's suggestions by falling similarity, then scene; the first is its family.
    The number of scenes bounds an item's list."""
    one = suggestions.groupBy("item_id", "scene").agg(F.max("similarity").alias("similarity"))
    lists = one.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "scene"))).alias("s"))
    scenes = F.transform("s", lambda x: x["scene"])
    scenes = F.slice(scenes, 1, most) if most else scenes
    return lists.select("item_id", F.element_at(scenes, 1).alias("family"), scenes.alias("scenes"), F.size("s").alias("n"))


def batches(requests: DataFrame, size: int) -> DataFrame:
    """Requests with the number of their batch within their family, ``size`` rows each in order of the item."""
    if not 1 <= size <= 1000:
        raise ValueError("a batch holds 1 to 1000 requests")
    placed = with_places(requests, ["family"], [F.col("item_id")])
    return placed.withColumn("batch", F.floor(F.col("_place") / size).cast("int")).drop("_place")


def coverage(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(item_id, problem): requests without a result and results without a request, or given more than once."""
    r = results.groupBy("item_id").agg(F.count("*").alias("n"))
    both = requests.select("item_id").distinct().withColumn("asked", F.lit(True)).join(r, "item_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("item_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def outside_suggestions(results: DataFrame, merged: DataFrame) -> DataFrame:
    """Positive results whose scene was not among the item's suggestions. Must be empty."""
    return results.filter(F.col("scene").isNotNull()).join(merged, "item_id").filter(~F.array_contains("scenes", F.col("scene"))).select("item_id", "scene")


def conflicting_decisions(decisions: DataFrame, identity: list[str]) -> DataFrame:
    """Identities that were decided in more than one way across exchanges."""
    return decisions.groupBy(identity).agg(F.countDistinct(F.coalesce("scene", F.lit("\0"))).alias("ways")).filter("ways > 1")


def replay(decisions: DataFrame, live: DataFrame, current: DataFrame, rejected: DataFrame, identity: list[str]) -> DataFrame:
    """The outcome of earlier decisions on live items, found by content: ``identity`` columns and scene.

    A decision is ``unmatched`` or ``ambiguous`` unless it meets exactly one live item; then ``skipped_rejected``,
    ``noop`` (same scene already), ``conflict`` (another scene already) or ``applied``. ``current`` has id and scene.
    """
    one = live.groupBy(identity).agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    asked = decisions.select(*identity, "scene").distinct()
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}")) for c in identity]
    met = asked.alias("d").join(one.alias("l"), on, "left").select("d.*", "l.matches", F.when(F.col("l.matches") == 1, F.col("l.id")).alias("id"))
    met = met.join(rejected.select(F.col("item_id").alias("id")).distinct().withColumn("gone", F.lit(True)), "id", "left")
    met = met.join(current.select("id", F.col("scene").alias("now")), "id", "left")
    outcome = (
        F.when(F.col("matches").isNull(), "unmatched").when(F.col("matches") > 1, "ambiguous").when(F.col("gone"), "skipped_rejected")
        .when(F.col("now").eqNullSafe(F.col("scene")), "noop").when(F.col("now").isNotNull(), "conflict").otherwise("applied"))
    return met.select(*identity, "scene", "id", outcome.alias("outcome"))


def apply_decisions(classified: DataFrame, outcomes: DataFrame, later: dict[str, DataFrame], *, method: str = "review") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(classified, later stages) after a review: items whose outcome is ``applied`` get the decided scene and the review's
    method, and what later stages made of them falls away; all other outcomes change nothing, so a second run changes nothing.

    ``classified`` has id, scene and method, ``outcomes`` id, scene and outcome, one applied outcome an item at most; ``later``
    has tables by item_id.
    """
    new = outcomes.filter("outcome = 'applied'").select("id", F.col("scene").alias("_scene"), F.lit(True).alias("_new"))
    joined = classified.join(new, "id", "left")
    after = joined.withColumns({"scene": F.when(F.col("_new"), F.col("_scene")).otherwise(F.col("scene")), "method": F.when(F.col("_new"), F.lit(method)).otherwise(F.col("method"))})
    return after.drop("_scene", "_new"), invalidated(later, new.select(F.col("id").alias("item_id")))
