"""Incremental runs: Structured Streaming over arriving files, each run ending when all that has arrived is done."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import jaccard
from corpusloom.operators import dedupe as D
from corpusloom.operators.progress import LEVELS, step
from corpusloom.tables import ensure_checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, shared by all executors."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def arriving(spark: SparkSession, folder: str, schema, *, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder, those there and those to come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands all that has arrived to ``each``, batch by batch, and ends. A later call with the same checkpoint goes on
    where this one ended; a batch may be repeated after a failure, so ``each`` has to be idempotent by batch number."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_stream(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Counts attempts per question and action, one folder of sums for each batch: replacing a batch's folder on a retry
    keeps the total right. ``folded`` reads the total."""

    def each(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("question", "action").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(stream, each, checkpoint)


def folded(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("question", "action").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def dedupe_stream(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Exact and near duplicates of arriving items against all accepted so far. Accepted fingerprints are kept by batch;
    within a batch items are decided in id order, batches in order of arrival."""
    spark = stream.sparkSession
    layout = "id bigint, hash string, words array<string>, bands array<int>, number int"

    def each(batch: DataFrame, number: int) -> None:
        try:
            earlier = spark.read.schema(layout).parquet(target).filter(F.col("number") < number).drop("number")
        except AnalysisException:  # the first batch: there is no folder yet
            earlier = spark.createDataFrame([], layout).drop("number")
        prints = D.fingerprints(batch)
        known = earlier.select("hash").distinct()
        fresh = prints.join(known, "hash", "left_anti")
        new = fresh.select(F.posexplode("bands").alias("band", "value"), "id", "words")
        old = earlier.select(F.posexplode("bands").alias("band", "value"), F.col("words").alias("there"))
        near = new.join(old, ["band", "value"]).filter(jaccard(F.col("words"), F.col("there")) >= D.THRESHOLD).select("id").distinct()
        left = batch.join(fresh.select("id"), "id", "left_semi").join(near, "id", "left_anti")
        accepted = D.dedupe(left).filter("decision = 'accepted'").select("id")
        prints.join(accepted, "id").withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    run_available(stream, each, checkpoint)


def windowed_counts(stream: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in event-time windows; those later than ``late`` behind the watermark are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def exact_duplicates_dropped(stream: DataFrame, *, late: str = "1 day") -> DataFrame:
    """A stream without events already seen within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def level_stream(stream: DataFrame) -> DataFrame:
    """(question, level, outcomes): the endless mode's level after each batch; the state is four numbers a question."""

    def advance(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, right, wrong, n = state.get if state.exists else (0, 0, 0, 0)
        rows = [(t, i, a) for f in frames for t, i, a in zip(f["ts"], f["event_id"], f["action"])]
        for _, _, action in sorted(rows):
            level, right, wrong = step(level, right, wrong, action == "correct")
            n += 1
        state.update((level, right, wrong, n))
        yield pd.DataFrame({"question": [key[0]], "level": [LEVELS[level]], "outcomes": [n]})

    rows = stream.filter(F.col("action").isin("correct", "wrong"))
    return rows.groupBy("question").applyInPandasWithState(advance, "question bigint, level string, outcomes bigint", "level int, right int, wrong int, n bigint", "update", GroupStateTimeout.NoTimeout)
