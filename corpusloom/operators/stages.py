"""Stage tables: what is pending, what a stage reads, what it leaves, and how snapshots follow each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order.
STAGES = ("clean", "dedupe", "classify", "select", "translate", "variants")


def pending(
    items: DataFrame, previous: DataFrame | None, own: DataFrame | None, rejected: DataFrame, limit: int | None = None, *, version: str | None = None, authoritative: tuple[str, ...] = ()
) -> DataFrame:
    """Items that a stage has still to do: the stage before is done, this one is not, and they are not rejected.

    ``own`` holds this stage's results. With a ``version``, results of another version (or of none) count as not done, unless
    their ``method`` is an authoritative one, which no new model overrules. With a limit the first by id, as a bounded top-k.
    """
    left = items if previous is None else items.join(previous.select("id").distinct(), "id", "left_semi")
    if own is not None:
        if version is not None:
            own = own.filter(F.coalesce(F.col("version") == version, F.lit(False)) | F.coalesce(F.col("method").isin(*authoritative), F.lit(False)))
        left = left.join(own.select("id").distinct(), "id", "left_anti")
    left = left.join(rejected.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    return left.orderBy("id").limit(limit) if limit else left


def checkpointed(stage: DataFrame, results: DataFrame, rejections: DataFrame, rejected: DataFrame, eligible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage, rejections) after a batch: its results replace those of the same items, its rejections are added. A batch with
    an item that is not eligible, or both accepted and rejected, is an error, and then nothing is written."""
    wrong = checkpoint_violations(results, rejected, eligible).limit(10).collect()
    if wrong:
        raise ValueError(f"a batch may not write {sorted((r['item_id'], r['problem']) for r in wrong)}")
    kept = stage.join(results.select("item_id").unionByName(rejected.select("item_id")), "item_id", "left_anti")
    before = rejections.join(rejected.select("item_id", "stage"), ["item_id", "stage"], "left_anti")
    return kept.unionByName(results), before.unionByName(rejected, allowMissingColumns=True)


def invalidated(derived: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """The derived tables without the rows of changed items (``item_id``), which have to be made again."""
    gone = changed.select("item_id").distinct()
    return {name: t.join(gone, "item_id", "left_anti") for name, t in derived.items()}


def set_json_fields(payload: Column, fields: Column) -> Column:
    """A JSON object with the fields of another, given as a struct, set: equal names are replaced, new ones added. Values of
    the payload keep their types; a null payload stays null."""
    kind = "map<string, variant>"
    new = F.from_json(F.to_json(fields), kind)
    kept = F.map_filter(F.from_json(payload, kind), lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, new))


def stage_inputs(items: DataFrame, previous: DataFrame, own: DataFrame, rejected: DataFrame, *, completed: bool = False, include_rejected: bool = False) -> DataFrame:
    """Items with the payload of the stage before and their own, completed and rejected ones on request."""
    joined = items.join(previous, "id").join(own, "id", "left")
    if not completed:
        joined = joined.join(own.select("id"), "id", "left_anti")
    if not include_rejected:
        joined = joined.join(rejected.select(F.col("item_id").alias("id")), "id", "left_anti")
    return joined


def latest_rejections(rejections: DataFrame) -> DataFrame:
    """One rejection per item: the latest, among equals the least stage and reason."""
    w = Window.partitionBy("item_id").orderBy(F.desc_nulls_last("updated_at"), "stage", "reason")
    return rejections.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def stage_counts(items: DataFrame, rejections: DataFrame, done: dict[str, DataFrame] | None = None) -> DataFrame:
    """(stage, n): all items, accepted items of each stage given in ``done``, and rejected items by stage."""
    out = items.agg(F.count("*").alias("n")).select(F.lit("raw").alias("stage"), "n")
    for stage, results in (done or {}).items():
        out = out.unionByName(results.agg(F.countDistinct("id").alias("n")).select(F.lit(stage).alias("stage"), "n"))
    gone = rejections.groupBy("stage").agg(F.countDistinct("item_id").alias("n"))
    return out.unionByName(gone.select(F.concat(F.lit("rejected_"), F.col("stage")).alias("stage"), "n"))


def reason_counts(rejections: DataFrame) -> DataFrame:
    """(stage, kind, n): rejections by the kind of their reason, the part before its colon."""
    kind = F.substring_index("reason", ":", 1)
    return rejections.groupBy("stage", kind.alias("kind")).agg(F.countDistinct("item_id").alias("n"))


def merge_items(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Upsert by natural key: each key with its ``action`` (insert, update, keep, unchanged) and the payload that stays."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in payload], F.lit(True).alias("_new"))
    o = old.select(*keys, *payload, F.lit(True).alias("_old"))
    both = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(same, "unchanged").otherwise("update")
    kept = [F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in payload]
    return both.select(*keys, action.alias("action"), *kept)


def without_source(tables: dict[str, DataFrame], items: DataFrame, source: str) -> dict[str, DataFrame]:
    """Every table without the items of a source: deletion that cascades by ``item_id``."""
    gone = items.filter(F.col("source_name") == source).select(F.col("id").alias("item_id"))
    return {name: t.join(gone, "item_id", "left_anti") for name, t in tables.items()}


def checkpoint_violations(results: DataFrame, rejected: DataFrame, eligible: DataFrame) -> DataFrame:
    """Identifiers that a batch may not write: not eligible, or both accepted and rejected. Must be empty."""
    stray = results.select("item_id").unionByName(rejected.select("item_id")).join(eligible.select("item_id"), "item_id", "left_anti")
    twice = results.select("item_id").join(rejected.select("item_id"), "item_id", "left_semi")
    return stray.select("item_id", F.lit("not_eligible").alias("problem")).unionByName(twice.select("item_id", F.lit("accepted_and_rejected").alias("problem")))


def fingerprint(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(n, digest): a digest of a whole table. Rows are hashed on their own and combined per bucket of identifiers,
    buckets in order, so no task reads more than a bucket's 64-character hashes."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(F.col(order).alias("k"), row.alias("h"), F.floor(F.col(order) / 65_536).alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))
