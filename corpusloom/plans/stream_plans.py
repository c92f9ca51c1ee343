"""Queries that run a stream to its present end and return what it made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming import micro as M
from corpusloom.tables import table

from .recall_plans import _SQL_LOG, attempts
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return M.arriving(spark, d, table(spark, d, "events").schema, pattern="events.parquet")


@query(f"WITH {_SQL_LOG} SELECT question, action, count(*) AS n, CAST(max(ts) AS VARCHAR) AS last FROM log GROUP BY question, action")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Attempts folded by a stream over the event files."""
    target = M.work_folder(spark, "progress")
    M.fold_stream(attempts(_events(spark, d)), target, M.work_folder(spark, "offsets"))
    return M.folded(spark, target).withColumn("last", F.col("last").cast("string"))


@query("SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, by event time."""
    target = M.work_folder(spark, "windows")
    counts = M.windowed_counts(_events(spark, d))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", M.work_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(target)
    last = rows.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


@query()
def stream_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels kept by a stateful stream; equal to ``endless_levels``."""
    target = M.work_folder(spark, "levels")
    levels = M.level_stream(attempts(_events(spark, d)))

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    levels.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", M.work_folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("question").agg(F.max_by("level", "batch").alias("level"))
