"""Exact and near duplicates: fingerprints in four bands, verified by word similarity, decided greedily in id order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import broadcast_if_small, cut_lineage

THRESHOLD = 0.76
HASHES: dict[str, Callable[[bytes], bytes]] = {
    "blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(),
    "sha256": lambda b: hashlib.sha256(b).digest()[:8],
}


def simhash64(parts: Column, hash_name: str = "blake2b") -> Column:
    """64-bit fingerprint of an array of strings: a bit is set where at least half of the parts' hashes set it; 0 for none."""
    digest = HASHES[hash_name]

    @F.pandas_udf("bigint")
    def fingerprint(arrays: pd.Series) -> pd.Series:
        bits = np.arange(64, dtype=np.uint64)
        out = np.zeros(len(arrays), dtype=np.uint64)
        for i, shingles in enumerate(arrays):
            if shingles is not None and len(shingles):
                values = np.frombuffer(b"".join(digest(s.encode()) for s in shingles), dtype=">u8").astype(np.uint64)
                ones = ((values[:, None] >> bits) & np.uint64(1)).sum(axis=0)
                out[i] = np.bitwise_or.reduce((2 * ones >= len(values)).astype(np.uint64) << bits)
        return pd.Series(out.view(np.int64))

    return fingerprint(parts)


def bands(fingerprint: Column) -> Column:
    """The four 16-bit bands of a fingerprint, lowest first."""
    return F.array(*[F.shiftrightunsigned(fingerprint, 16 * b).bitwiseAND(65_535).cast("int") for b in range(4)])


def fingerprints(items: DataFrame, *, text: str = "text", hash_name: str = "blake2b") -> DataFrame:
    """``id``, normalised hash, distinct content words and bands of every item."""
    words = items.select("id", T.normalized_hash(F.col(text)).alias("hash"), T.content_words(F.col(text)).alias("words"))
    marked = words.withColumn("bands", bands(simhash64(T.shingles(F.col("words")), hash_name)))
    return marked.withColumn("words", F.array_distinct("words"))


def rare_first(texts: DataFrame, keep: Column) -> DataFrame:
    """(id, word): of each text the ``keep`` words that are rarest in all texts; ``keep`` may use ``n``, the number of its
    words. Words of at least 1/65,536 of all occurrences are counted, at most that many; the others are rarer than these."""
    each = texts.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    total = texts.agg(F.sum(F.size("words"))).first()[0] or 0
    frequent = each.groupBy("word").agg(F.count("*").alias("seen")).filter(F.col("seen") > max(1, total // 65_536))
    known = each.join(broadcast_if_small(frequent), "word", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("seen", F.lit(0)), "word"))
    return known.withColumn("_place", place).filter(F.col("_place") <= keep).select("id", "word")


def near_edges(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id_l, id_r), id_l < id_r: texts that share a band and are similar enough. ``texts`` has distinct texts only.

    Candidates share one of their rarest ``n - ceil(threshold * n) + 1`` words, as similar sets must, so their number
    follows the rarity of words and not, as with bands alone, the square of the number of texts over 65,536; of the
    candidates those with a common band are then compared by all words. Texts without content words are similar to nothing.
    """
    some = texts.filter(F.size("words") > 0)
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    each = rare_first(some, keep).join(some.select("id", "words", "bands"), "id")
    left, right = (each.select("word", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "words", "bands")]) for side in "lr")
    pairs = left.join(right, "word").filter(F.col("id_l") < F.col("id_r"))
    shared = F.exists(F.zip_with("bands_l", "bands_r", lambda x, y: x == y), lambda same: same)
    return pairs.filter(shared & (T.jaccard(F.col("words_l"), F.col("words_r")) >= threshold)).select("id_l", "id_r").distinct()


def dedupe(items: DataFrame, *, text: str = "text", threshold: float = THRESHOLD, hash_name: str = "blake2b") -> DataFrame:
    """(id, decision, duplicate_of): ``accepted``, ``exact_duplicate`` or ``near_duplicate`` of every item.

    The result is that of going through the items by id: an item whose hash an accepted one has is an exact duplicate,
    one with a near neighbour among the accepted a near duplicate of the smallest; protected items are always accepted.
    A text has at most two nodes, however many copies: its first item, and its first protected one, which is accepted
    from the start; no other copy can decide anything before these. Nodes are decided in rounds, all at once whose
    smaller neighbours are decided. Each round is kept in the checkpoint folder.
    """
    spared = items.select("id", F.coalesce("protected", F.lit(False)).alias("protected"))
    prints = cut_lineage(fingerprints(items, text=text, hash_name=hash_name).join(spared, "id"))
    texts = cut_lineage(prints.groupBy("hash").agg(
        F.min("id").alias("first_id"), F.min(F.when(F.col("protected"), F.col("id"))).alias("safe_id"), F.min_by("words", "id").alias("words"), F.min_by("bands", "id").alias("bands")))
    near = cut_lineage(near_edges(texts.select(F.col("first_id").alias("id"), "words", "bands"), threshold))
    linked = near.union(near.select("id_r", "id_l")).toDF("a", "b")
    safe = F.coalesce(F.col("safe_id") == F.col("first_id"), F.lit(False))
    state = texts.select(F.col("first_id").alias("id"), "safe_id", F.when(safe, "accepted").alias("state"))
    while True:
        # a neighbour text counts if its protected node, or its accepted first one, comes before the item
        seen = linked.join(state.select(F.col("id").alias("a"), F.col("safe_id").alias("a_safe"), F.col("state").alias("a_state")), "a")
        before = F.col("a") < F.col("b")
        hit = F.coalesce(F.col("a_safe") < F.col("b"), F.lit(False)) | (before & F.coalesce(F.col("a_state") == "accepted", F.lit(False)))
        about = seen.groupBy(F.col("b").alias("id")).agg(F.max(hit).alias("hit"), F.max(before & F.col("a_state").isNull()).alias("open"))
        decided = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("hit"), "rejected").when(F.coalesce("open", F.lit(False)), None).otherwise("accepted")
        state = cut_lineage(state.join(about, "id", "left").select("id", "safe_id", decided.alias("state")))
        if not state.filter(F.col("state").isNull()).limit(1).count():
            break
    kept = state.select(F.col("id").alias("t"), F.when(F.col("state") == "accepted", F.col("id")).otherwise(F.col("safe_id")).alias("kept")).filter("kept IS NOT NULL")
    own = prints.select("id", "hash", "protected").join(texts.select("hash", "first_id"), "hash")
    beside = linked.join(kept, F.col("b") == F.col("t")).select("a", "kept")
    exact = own.join(kept, own["first_id"] == kept["t"]).filter("kept < id").select("id", F.col("kept").alias("exact_of"))
    close = own.join(beside, own["first_id"] == beside["a"]).filter("kept < id").groupBy("id").agg(F.min("kept").alias("near_of"))
    every = own.select("id", "protected", "first_id").join(exact, "id", "left").join(close, "id", "left")
    decision = F.when(F.col("protected"), "accepted").when(F.col("exact_of").isNotNull(), "exact_duplicate").when(F.col("near_of").isNotNull(), "near_duplicate").otherwise("accepted")
    every = every.withColumn("decision", decision)
    return every.select("id", "decision", F.when(F.col("decision") != "accepted", F.coalesce("exact_of", "near_of")).alias("duplicate_of"))


def against_base(items: DataFrame, base: DataFrame, *, text: str = "text") -> DataFrame:
    """(id, base_id): items whose normalised text is already in a published base."""
    known = base.select(T.normalized_hash(F.col(text)).alias("hash"), F.col("id").alias("base_id")).groupBy("hash").agg(F.min("base_id").alias("base_id"))
    return items.select("id", T.normalized_hash(F.col(text)).alias("hash")).join(known, "hash").select("id", "base_id")
