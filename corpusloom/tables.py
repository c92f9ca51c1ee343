"""Opening tables and the few physical helpers that all operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows, counted first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join.

    The count stops after ``rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``. Where that is unset, as in
    local tests, a folder of this machine is used.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` evaluated once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_places(df: DataFrame, group: Sequence[str], order: Sequence[Column], *, out: str = "_place", running: Column | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in its group by ``order``, and, if asked for, the ``running`` sum before it as
    ``_before``. ``order`` must be total within a group.

    Rows are laid out in ranges of group and order and numbered as they lie, and the counts of the ranges before are added,
    so a group of any size is spread over tasks and rows are shuffled once. The layout is kept in the checkpoint folder.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(0) if running is None else running
    laid = df.repartitionByRange(pieces, *group, *order).sortWithinPartitions(*group, *order)
    # the number of a row is its partition's, shifted by 33 bits, plus its place there
    laid = cut_lineage(laid.withColumns({"_at": F.monotonically_increasing_id(), "_value": value.cast("bigint")}))
    piece = F.shiftright("_at", 33).alias("_piece")
    counts = laid.groupBy(*group, piece).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"), F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.col("_piece").alias("_of_piece"), "_first", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_earlier") for c in ("_rows", "_sum")))
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group] + [F.shiftright("_at", 33) == F.col("_of_piece")]
    placed = laid.join(broadcast_if_small(counts), on).withColumn(out, F.col("_at") - F.col("_first") + F.col("_rows_earlier"))
    if running is not None:
        own = Window.partitionBy(*group, "_of_piece").orderBy("_at")
        placed = placed.withColumn("_before", F.col("_sum_earlier") + F.sum("_value").over(own) - F.col("_value"))
    return placed.drop("_value", "_at", "_first", "_rows_earlier", "_sum_earlier", "_of_piece", *(f"_of_{c}" for c in group))
