"""Publishing: selected, translated items become the question store and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.operators import store, variants
from corpusloom.tables import cut_lineage


def rows_to_publish(items: DataFrame, selected: DataFrame, translated: DataFrame, rejected: DataFrame) -> DataFrame:
    """Selected items with their translation, without the rejected ones; ``complete`` tells whether both are there."""
    live = items.join(selected.select("id", "scene"), "id").join(rejected.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    return live.join(translated.select("id", "translation_zh"), "id", "left").withColumn("complete", F.col("translation_zh").isNotNull())


def allocate_ids(rows: DataFrame) -> DataFrame:
    """``stable_id`` and ``random_key`` of every row: by its text's hash, 16 digits, 24 where two texts share those."""
    h = rows.withColumn("normalized_hash", T.normalized_hash(F.col("text")))
    texts = h.select("normalized_hash").distinct().withColumn("_p", F.substring("normalized_hash", 1, 16))
    n = texts.withColumn("_n", F.count("*").over(Window.partitionBy("_p"))).select("normalized_hash", "_n")
    short = F.concat(F.lit("s_"), F.substring("normalized_hash", 1, 16))
    long = F.concat(F.lit("s_"), F.substring("normalized_hash", 1, 24))
    return h.join(n, "normalized_hash").withColumn("stable_id", F.when(F.col("_n") > 1, long).otherwise(short)).withColumn("random_key", T.random_key(F.col("normalized_hash"))).drop("_n")


def question_store(rows: DataFrame) -> dict[str, DataFrame]:
    """The published tables: ``sentences``, ``question_variants`` and ``aliases``."""
    made = variants.with_variants(rows.select("stable_id", "text"), ident="stable_id").filter("variants IS NOT NULL")
    v = made.select(F.col("stable_id").alias("sentence_id"), F.explode("variants").alias("v")).select(F.concat_ws("-", "sentence_id", "v.difficulty").alias("id"), "sentence_id", "v.*")
    return {"sentences": rows.join(made.select("stable_id"), "stable_id", "left_semi"), "question_variants": v.drop("aliases"), "aliases": v.select(F.col("id").alias("question_variant_id"), F.explode("aliases").alias("alias"))}


def lookup(tables: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """Questions by variant id, in the order asked for, each with its sentence and its sorted aliases."""
    a = tables["aliases"].groupBy("question_variant_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    v = store.ordered_lookup(tables["question_variants"], ids)
    q = v.join(tables["sentences"].select(F.col("stable_id").alias("sentence_id"), "text"), "sentence_id").join(a, F.col("id") == F.col("question_variant_id"), "left")
    return q.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("question_variant_id").orderBy("position")


def extend(base: DataFrame, extension: DataFrame, *, most: int) -> DataFrame:
    """Items of an extension that repeat nothing of the base nor each other, the first ``most`` by hash."""
    fresh = extension.withColumn("hash", T.normalized_hash(F.col("text"))).join(base.select(T.normalized_hash(F.col("text")).alias("hash")), "hash", "left_anti")
    kept = D.dedupe(fresh).filter("decision = 'accepted'").select("id")
    return fresh.join(kept, "id").orderBy("hash", "id").limit(most)


def curate(rows: DataFrame, *, quota: int, categories: list[str] | None = None) -> DataFrame:
    """Per category ``quota`` items by hash, in the order of the categories: texts that pass the quality gate and have
    variants, none near one taken before, from a reservoir of bounded size. ``rows``: category, id, text.

    The categories are a small dimension; each is decided at once, with what earlier ones took as given.
    """
    from corpusloom.operators.gate import with_rejection_reason
    from corpusloom.operators.select import balanced_reservoir

    sound = with_rejection_reason(rows).filter(F.col("reason").isNull() & F.col("text").isNotNull())
    sound = sound.select("category", "id", F.col("clean_text").alias("text")).withColumn("hash", T.normalized_hash(F.col("text")))
    one = Window.partitionBy("category", "hash").orderBy("id")
    once = sound.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    pool = balanced_reservoir(once, quota=quota).drop("place")
    ready = cut_lineage(pool.join(variants.with_variants(pool.groupBy("id").agg(F.max("text").alias("text"))).select("id"), "id", "left_semi"))
    names = categories or [r["category"] for r in ready.select("category").distinct().orderBy("category").limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("curate is for a small dimension of categories")
    # items go by category, then hash: numbered so, the greedy decision is that of the duplicates stage
    order = F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair])
    place = F.row_number().over(Window.partitionBy("category").orderBy("hash", "id"))
    numbered = ready.filter(F.col("category").isin(names)).withColumn("_at", F.element_at(order, F.col("category")).cast("bigint") * (1 << 32) + place)
    texts = numbered.select(F.col("_at").alias("id"), "text", F.lit(False).alias("protected"))
    kept = D.dedupe(texts).filter("decision = 'accepted'").select(F.col("id").alias("_at"))
    left = numbered.join(kept, "_at").withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("_at")))
    return left.filter(F.col("place") <= quota).select("category", "id", "text", "hash", "place")
