"""Recall of further candidates: by vectors near to prototypes, or by signals that conflicting scenes kept back."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.select import assign
from corpusloom.tables import cut_lineage

#: A set of prototypes that one task scores at once; more are scored in blocks.
MAX_PROTOTYPES = 20_000


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, np.finfo(np.float32).eps)


def vector_top_k(pool: DataFrame, prototypes: DataFrame, k: int, *, exclude: DataFrame | None = None) -> DataFrame:
    """(label, vec_id, similarity, rank): per label the k vectors most similar to any of its prototypes.

    ``pool`` has vec_id and embedding, ``prototypes`` also label; ``exclude`` lists (label, vec_id) or vec_id to leave
    out. Similarity is the largest cosine; ties go to the smaller id. Every task multiplies its vectors with all
    prototypes, keeps its k best of each label and sends on only those. Prototypes are a small stated set, counted before
    they are broadcast, in blocks if there are many.
    """
    if not 1 <= k:
        raise ValueError("k must be positive")
    rows = [(r["label"], r["embedding"]) for r in prototypes.select("label", "embedding").dropna().orderBy("label").limit(MAX_PROTOTYPES + 1).collect()]
    if len(rows) > MAX_PROTOTYPES:
        return _top_k_in_blocks(pool, prototypes, k, exclude)
    labels = sorted({label for label, _ in rows})
    matrix = unit(np.array([v for _, v in rows], dtype=np.float64)) if rows else np.zeros((0, 0))
    owner = np.array([labels.index(label) for label, _ in rows])
    kind = prototypes.schema["label"].dataType.simpleString()
    if exclude is not None:
        marks = exclude.select("vec_id", *(["label"] if "label" in exclude.columns else [])).distinct()
        if "label" in exclude.columns:
            marks = marks.groupBy("vec_id").agg(F.collect_set("label").alias("_not"))
            pool = pool.join(marks, "vec_id", "left")
        else:
            pool = pool.join(marks, "vec_id", "left_anti")
    if "_not" not in pool.columns:
        pool = pool.withColumn("_not", F.array().cast(f"array<{kind}>"))
    spread = pool.sparkSession.sparkContext.broadcast((labels, matrix, owner))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix, owner = spread.value
        best: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(labels))}
        for b in batches:
            b = b.filter(b["embedding"].is_valid())
            if not (b.num_rows and len(labels)):
                continue
            ids = b["vec_id"].to_numpy()
            vectors = np.stack(b["embedding"].to_numpy(zero_copy_only=False)).astype(np.float64)
            dots = unit(vectors) @ matrix.T
            without = b["_not"].to_pylist()
            for i, label in enumerate(labels):
                sims = dots[:, owner == i].max(axis=1)
                allowed = np.array([not w or label not in w for w in without])
                order = np.lexsort((ids, -sims))
                best[i] = sorted(best[i] + [(-float(sims[j]), int(ids[j])) for j in order if allowed[j]][:k])[:k]
        out = [(labels[i], v, -s) for i, found in best.items() for s, v in found]
        yield pa.RecordBatch.from_pydict({"label": [o[0] for o in out], "vec_id": [o[1] for o in out], "similarity": [o[2] for o in out]},
                                         pa.schema([("label", pa.from_numpy_dtype(np.int32) if kind == "int" else pa.int64() if kind == "bigint" else pa.string()), ("vec_id", pa.int64()), ("similarity", pa.float64())]))

    near = pool.select("vec_id", "embedding", "_not").mapInArrow(task, f"label {kind}, vec_id bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k)


def _top_k_in_blocks(pool: DataFrame, prototypes: DataFrame, k: int, exclude: DataFrame | None) -> DataFrame:
    """``vector_top_k`` over more prototypes than one task scores: each block's k best, merged by largest similarity. A
    vector among a label's k best is so in the block of the prototype that it is nearest to."""
    each = cut_lineage(prototypes.select("label", "embedding").dropna().distinct())
    blocks = max(1, -(-2 * each.count() // MAX_PROTOTYPES))  # half full on average
    salt = 0
    while True:
        placed = each.withColumn("_block", F.pmod(F.xxhash64("label", "embedding", F.lit(salt)), F.lit(blocks)))
        if (placed.groupBy("_block").count().agg(F.max("count")).first()[0] or 0) <= MAX_PROTOTYPES:
            break
        salt, blocks = salt + 1, 2 * blocks
    near = [vector_top_k(pool, placed.filter(F.col("_block") == b), k, exclude=exclude) for b in range(blocks)]
    merged = reduce(DataFrame.unionByName, near).groupBy("label", "vec_id").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))
    return merged.withColumn("rank", place).filter(F.col("rank") <= k)


def recall_in_parts(pool: DataFrame, prototypes: DataFrame, k: int, folder: str, *, model: str, part_rows: int = 1_000_000) -> DataFrame:
    """``vector_top_k`` over parts of the pool, each kept in ``folder``, so that a run that was broken off goes on with the
    parts that are missing. The folder belongs to one model, prototypes and k; another is an error. Parts are made of
    identifiers by a hash, so a part is the same in every run; their k best are merged at the end."""
    spark = pool.sparkSession
    total = pool.count()
    parts = max(1, -(-total // part_rows))
    facts = {"model": model, "k": k, "parts": parts, "rows": total, "prototypes": prototypes.agg(F.coalesce(F.sum(F.xxhash64("label", "embedding").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]}
    about = f"{folder}/about"
    try:
        known = json.loads(spark.read.text(about).first()[0])
    except AnalysisException:  # the first run
        known = None
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(about)
    if known is not None and known != facts:
        raise ValueError(f"{folder} holds a recall of {known}, not of {facts}")
    for i in range(parts):
        place = f"{folder}/part={i}"
        try:
            spark.read.parquet(place)
        except AnalysisException:  # missing, or broken off before it was whole
            part = pool.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i)
            vector_top_k(part, prototypes, k).select("label", "vec_id", "similarity").write.mode("overwrite").parquet(place)
    merged = spark.read.parquet(*[f"{folder}/part={i}" for i in range(parts)])
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))
    return merged.select("label", "vec_id", "similarity").withColumn("rank", place).filter(F.col("rank") <= k)


def within_capacity(pool: DataFrame, prototypes: DataFrame, top_k: int, *, source_room: dict[str, int], author_room: dict[str, int], exclude: DataFrame | None = None) -> DataFrame:
    """(label, vec_id, similarity): per label up to ``top_k`` vectors, the most similar ones that fit the room their
    source and author have left; names without an entry have none, blank authors need none.

    ``pool`` also has source_name and source_author. The assignment works on the 16 ``top_k`` nearest vectors, twice as
    many as long as a label stays short although the pool has more, so its result is that of the whole pool.
    """
    k = 16 * top_k
    while True:
        near = vector_top_k(pool, prototypes, k, exclude=exclude).join(pool.select("vec_id", "source_name", "source_author"), "vec_id")

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["similarity", "vec_id"], ascending=[False, True]).reset_index(drop=True)
            named = frame["source_author"].fillna("").str.strip()
            loss = ((1 - frame["similarity"]) * 1_000_000).round().astype("int64") * (len(frame) * (top_k + 1) + 1) + frame.index
            rows = list(zip(frame["source_name"], [a or None for a in named], loss.tolist()))
            picked = frame.iloc[assign(rows, top_k, source_room, author_room)]
            return picked.assign(seen=len(frame))[["label", "vec_id", "similarity", "seen"]]

        kind = near.schema["label"].dataType.simpleString()
        chosen = cut_lineage(near.groupBy("label").applyInPandas(choose, f"label {kind}, vec_id bigint, similarity double, seen bigint"))
        counts = chosen.groupBy("label").agg(F.count("*").alias("n"), F.max("seen").alias("seen"))
        if not counts.filter((F.col("n") < top_k) & (F.col("seen") >= k)).limit(1).count():
            return chosen.drop("seen")
        k *= 2


def lexical_conflicts(plain: DataFrame, scores: DataFrame, found: DataFrame, scene: str, keywords: list[str], phrases: list[str]) -> DataFrame:
    """(id, competing_scene, triggers, confidence): undecided items that hold a requested strong signal of ``scene``
    while another scene scores too, best first by confidence.

    ``plain`` is the result of ``classify``, ``scores`` that of ``scene_scores``, ``found`` the evidence.
    """
    own = found.filter((F.col("scene") == scene) & (((F.col("kind") == "keyword") & F.col("term").isin(keywords)) | ((F.col("kind") == "phrase") & F.col("term").isin(phrases))))
    triggers = own.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("triggers"), F.max(F.col("kind") == "phrase").alias("phrase"))
    target = scores.filter(F.col("scene") == scene).select("id", F.col("score").alias("target"))
    rival = scores.filter(F.col("scene") != scene).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "scene")).alias("r"))
    rival = rival.select("id", F.col("r.scene").alias("competing_scene"), (-F.col("r.minus")).alias("rival"))
    rows = plain.filter("method = 'llm_required'").select("id").join(triggers, "id").join(target, "id").join(rival, "id")
    confidence = F.when(F.col("phrase"), 0.75).otherwise(0.25) + F.least("target", F.lit(100.0)) / 1000 - F.least("rival", F.lit(100.0)) / 100_000
    return rows.select("id", "competing_scene", "triggers", F.round(confidence, 6).alias("confidence"))
