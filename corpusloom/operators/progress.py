"""Learner progress folded from an append-only log of attempts.

An attempt is (question, ts, event_id, action): ``correct``, ``wrong``, ``replay`` or ``view``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("easy", "medium", "hard")


def fold(log: DataFrame) -> DataFrame:
    """Per question: first outcome (a look at the answer before any attempt makes it false, a replay leaves it open),
    counters, first and last time."""
    decisive = F.col("action").isin("correct", "wrong", "view")
    when = F.struct("ts", "event_id")
    return log.groupBy("question").agg(
        F.min_by(F.when(decisive, F.col("action") == "correct"), F.when(decisive, when)).alias("first_correct"),
        F.count_if(F.col("action").isin("correct", "wrong")).alias("attempts"),
        F.count_if(F.col("action") == "replay").alias("replays"),
        F.count_if(F.col("action") == "view").alias("views"),
        F.min(F.when(decisive, F.col("ts"))).alias("first_answered_at"),
        F.max("ts").alias("updated_at"),
    )


def selection_weight(first_correct: Column) -> Column:
    """New questions weigh 3, ones first answered wrongly 9, others 0.25."""
    return F.when(first_correct.isNull(), 3.0).when(~first_correct, 9.0).otherwise(0.25)


def summary(progress: DataFrame) -> DataFrame:
    """(practised, pending, total): questions with and without a right first outcome."""
    return progress.agg(
        F.count_if(F.col("first_correct").isNotNull()).alias("practised"), F.count_if(~F.col("first_correct")).alias("pending"), F.count("*").alias("total"))


def latest_open_session(sessions: DataFrame) -> DataFrame:
    """Per mode the session last updated that is not completed, ties to the larger identifier."""
    return sessions.filter(~F.col("completed")).groupBy("mode").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def longest_streaks(log: DataFrame) -> DataFrame:
    """(question, longest): the longest run of right outcomes, by gaps and islands."""
    w = Window.partitionBy("question").orderBy("ts", "event_id")
    rows = log.filter(F.col("action").isin("correct", "wrong")).withColumn("right", F.col("action") == "correct")
    rows = rows.withColumn("island", F.sum(F.when(~F.col("right"), 1).otherwise(0)).over(w))
    runs = rows.filter("right").groupBy("question", "island").agg(F.count("*").alias("n"))
    best = runs.groupBy("question").agg(F.max("n").alias("longest"))
    return rows.select("question").distinct().join(best, "question", "left").select("question", F.coalesce("longest", F.lit(0)).alias("longest"))


def repeats_recent(log: DataFrame, key: str, last: int = 3) -> DataFrame:
    """Log entries whose ``key`` is that of one of the question's ``last`` entries before."""
    w = Window.partitionBy("question").orderBy("ts", "event_id")
    hit = F.lit(False)
    for i in range(1, last + 1):
        hit = hit | F.coalesce(F.lag(key, i).over(w) == F.col(key), F.lit(False))
    return log.withColumn("repeats", hit)


def step(level: int, right: int, wrong: int, correct: bool, run: int = 5) -> tuple[int, int, int]:
    """The endless mode's state after an outcome: up after ``run`` right ones in a row, down after as many wrong ones."""
    right, wrong = (right + 1, 0) if correct else (0, wrong + 1)
    if right == run:
        return min(level + 1, len(LEVELS) - 1), 0, 0
    if wrong == run:
        return max(level - 1, 0), 0, 0
    return level, right, wrong


def final_levels(log: DataFrame) -> DataFrame:
    """(question, level): the endless mode's level after all outcomes. The state is three numbers a question: rows come
    sorted by question and time and are folded as they stream by, so no group is held."""

    def task(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, (0, 0, 0)
        done: list[tuple] = []
        for f in frames:
            for q, a in zip(f["question"], f["action"]):
                if q != at:
                    if at is not None:
                        done.append((at, LEVELS[state[0]]))
                    at, state = q, (0, 0, 0)
                state = step(*state, a == "correct")
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=["question", "level"])
                done = []
        if at is not None:
            done.append((at, LEVELS[state[0]]))
        yield pd.DataFrame(done, columns=["question", "level"])

    rows = log.filter(F.col("action").isin("correct", "wrong")).dropna(subset=["question"])
    ordered = rows.repartition("question").sortWithinPartitions("question", "ts", "event_id")
    return ordered.select("question", "action").mapInPandas(task, "question bigint, level string")


def weighted_pick(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement in proportion to ``weight``: the n least exponential keys, by a seeded hash."""
    u = (F.pmod(F.xxhash64("question", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return candidates.withColumn("_key", -F.log(u) / F.col("weight")).orderBy("_key", "question").limit(n).drop("_key")


def session_stats(log: DataFrame) -> DataFrame:
    """(question, completed, wrong, accuracy, longest, highest): outcomes, their share of right ones in percent, the longest
    run of right ones, and the highest level that five right ones in a row, again and again, would have reached."""
    done = log.filter(F.col("action").isin("correct", "wrong"))
    n = done.groupBy("question").agg(F.count("*").alias("completed"), F.count_if(F.col("action") == "wrong").alias("wrong"))
    share = F.round((F.col("completed") - F.col("wrong")) * 100.0 / F.col("completed"), 1)
    highest = F.element_at(F.array(*map(F.lit, LEVELS)), F.least(F.lit(len(LEVELS)), F.floor(F.col("longest") / 5).cast("int") + 1))
    return n.join(longest_streaks(log), "question").select("question", "completed", "wrong", share.alias("accuracy"), "longest", highest.alias("highest"))
