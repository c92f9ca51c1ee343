"""Capping records per dominant contributor with mergeable bounded heaps.

For every group a contributor may keep at most ``max(1, n // share)`` records, the best ranked ones, n being the number of
records of the group. A heap holds the cap's best (score, identifier) entries of one contributor and is mergeable: the heap
of a union is the cap's best of the heaps. The leaves of the merge tree are tasks that hold at most LEAF records of a group;
a group of one leaf is decided there, the heaps of larger groups are merged in two further levels, and the survivors are
joined back by identifier. A heap of more than HEAP entries is kept as consecutive slices of the ranking, each with what
the slices before it leave of the cap, so no task ever holds more than about HEAP entries of a contributor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.tables import broadcast_if_small, cut_lineage

#: Entries that a task gathers before it cuts its heaps down to their caps.
FLUSH = 65_536
#: Records of a group in one leaf of the merge tree.
LEAF = 50_000
#: Entries of one heap; a larger heap is several slices of the ranking.
HEAP = 200_000


def changes(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """True at each row that differs from the one before in any of the columns; nulls are equal to each other."""
    new = np.zeros(t.num_rows, dtype=bool)
    if t.num_rows:
        new[0] = True
    for c in columns:
        codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def ranks(t: pa.Table, group: Sequence[str]) -> np.ndarray:
    """The place, from 0, of each row in its group; the rows of a group lie together."""
    place = np.arange(t.num_rows)
    return place - np.maximum.accumulate(np.where(changes(t, group), place, 0))


def best_of_groups(t: pa.Table, group: Sequence[str], order: Sequence[str], cap: str) -> pa.Table:
    """The first ``cap`` rows of each group by ``order`` (ascending, nulls last), sorted by group and order."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (*group, *order)]))
    return t.filter(pa.array(ranks(t, group) < t[cap].to_numpy()))


def heap_task(group: Sequence[str], order: Sequence[str], cap: str):
    """A task function that keeps the bounded heaps of all groups it meets. Heaps are mergeable, so when those of many
    groups together outgrow HEAP entries, they are handed to the next level of the tree and begun anew."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, FLUSH
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > limit:
                kept = best_of_groups(pa.Table.from_batches(held), group, order, cap)
                held, rows = kept.to_batches(max_chunksize=16_384), kept.num_rows
                if rows > HEAP:
                    yield from held
                    held, rows = [], 0
                limit = max(FLUSH, 2 * rows)
        if rows:
            yield from best_of_groups(pa.Table.from_batches(held), group, order, cap).to_batches(max_chunksize=16_384)

    return task


def whole_groups(group: Sequence[str], of: Callable[[pa.Table], pa.Table]):
    """A task function over rows sorted by group: ``of`` gets stretches of whole groups, FLUSH rows or one group long."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= FLUSH:
                t = pa.Table.from_batches(held).combine_chunks()
                whole = int(np.flatnonzero(changes(t, group))[-1])  # the last group may go on in the next batch
                if whole:
                    yield from of(t.slice(0, whole)).to_batches(max_chunksize=16_384)
                held = t.slice(whole).to_batches()
                rows = t.num_rows - whole
        if rows:
            yield from of(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=16_384)

    return task


def bounded_heaps(df: DataFrame, group: Sequence[str], order: Sequence[str], cap: str) -> DataFrame:
    """The ``cap`` best rows of each group by a tree of heaps: those of the map tasks, those of about sqrt(partitions)
    branches of the tasks, and those of the groups."""
    task = heap_task(group, order, cap)
    fan = max(2, isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    leaves = df.mapInArrow(task, df.schema).withColumn("_branch", F.spark_partition_id() % fan)
    branches = leaves.repartition(*group, "_branch").drop("_branch").mapInArrow(task, df.schema)
    last = branches.repartition(*group).sortWithinPartitions(*group)
    return last.mapInArrow(whole_groups(group, lambda t: best_of_groups(t, group, order, cap)), df.schema)


def sliced(df: DataFrame, group: Sequence[str], order: Sequence[str], cap: str, rows: int) -> DataFrame:
    """``df`` with ``_slice`` and the cap of each slice; ``df`` has about ``rows`` rows in groups with a cap beyond HEAP.

    Those are laid out in ranges of the whole order, which ends with the identifier, so equal scores part as well. A slice
    may keep what the slices before it leave of the cap; slices that may keep nothing are dropped. Which rows share a slice
    depends on sampled bounds, what is kept in the end does not.
    """
    small = df.filter(F.col(cap) <= HEAP).withColumn("_slice", F.lit(0))
    by = [F.col(c).asc_nulls_last() for c in (*group, *order)]
    pieces = max(2, -(-2 * rows // HEAP))
    laid = cut_lineage(df.filter(F.col(cap) > HEAP).repartitionByRange(pieces, *by).withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*group, "_slice").agg(F.count("*").alias("_here"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).drop("_here")
    named = counts.toDF(*[f"_of_{c}" for c in group], "_at", "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group] + [F.col("_slice") == F.col("_at")]
    left = laid.join(broadcast_if_small(named), on).withColumn(cap, (F.col(cap) - F.col("_before")).cast(df.schema[cap].dataType))
    return small.unionByName(left.filter(F.col(cap) > 0).select(small.columns))


def keep_best(df: DataFrame, group: Sequence[str], order: Sequence[str], cap: str, largest_cap: int, rows: int) -> DataFrame:
    """The ``cap`` best rows of each group. ``largest_cap`` bounds the caps, ``rows`` the rows with one beyond HEAP."""
    if largest_cap <= HEAP:  # every heap is one slice
        return bounded_heaps(df, group, order, cap)
    return bounded_heaps(sliced(df, group, order, cap, rows), [*group, "_slice"], order, cap).drop("_slice")


def _judged(group: str, limits: Sequence[tuple[str, int]], order: Sequence[str]):
    """(group, identifier, kept) of the rows of whole groups, by all limits in turn."""

    def judged(t: pa.Table) -> pa.Table:
        first = np.flatnonzero(changes(t, [group]))
        sizes = np.diff(np.append(first, t.num_rows))
        t = t.append_column("_row", pa.array(np.arange(t.num_rows))).append_column("_n", pa.array(np.repeat(sizes, sizes)))
        kept = np.ones(t.num_rows, dtype=bool)
        for key, share in limits:
            left = t.filter(pa.array(kept))
            held = left.append_column("_cap", pa.array(np.maximum(1, left["_n"].to_numpy() // share))).filter(left[key].is_valid())
            best = best_of_groups(held.select([group, key, *order, "_cap", "_row"]), [group, key], order, "_cap")
            kept[np.setdiff1d(held["_row"].to_numpy(), best["_row"].to_numpy())] = False
        return t.select([group, order[-1]]).append_column("_kept", pa.array(kept))

    return judged


def cap_contributors(
    rows: DataFrame,
    contributors: Sequence[tuple[str, int]],
    *,
    group: str = "_group",
    order: Sequence[str] = ("_worse", "_tie", "_id"),
    seen: str = "_seen",
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): (group, id) of the rows that all limits keep, and of those that a limit removes.

    ``rows`` has the group, the rank columns (the last is the identifier), one key column per contributor kind and
    ``seen``, the time of delivery. ``contributors`` lists (key column, share): in the order given, each contributor
    may hold ``max(1, n // share)`` of the rows that the limits before have left, n counting distinct identifiers of
    the group in the input.

    Defined results: rows without group or identifier are ignored; of several deliveries of one (group, identifier)
    the latest counts, among equally late ones the largest by the other columns; a null contributor is free of the limit;
    null and NaN scores rank last; equal ranks cannot occur, as the identifier ends the order; an empty table gives
    empty results. Other columns of the input play no part, whatever their names.
    """
    ident = order[-1]
    keys = [k for k, _ in contributors]
    rows = rows.filter(F.col(group).isNotNull() & F.col(ident).isNotNull())
    payload = [c for c in (*keys, *order) if c != ident]
    deliveries = cut_lineage(rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > LEAF))
    many, some = deliveries.agg(F.sum("_n"), F.count("*")).first()
    large = broadcast_if_small(deliveries.select(group))

    def latest(of: DataFrame, *partition: Column) -> DataFrame:
        one = of.repartition(group, *partition).groupBy(group, *partition, ident).agg(F.max(F.struct(seen, *payload)).alias("_last"))
        return one.select(group, ident, *(F.col(f"_last.{c}").alias(c) for c in payload))

    small = latest(rows.join(large, group, "left_anti") if some else rows).sortWithinPartitions(group)
    kind = {c: small.schema[c].dataType.simpleString() for c in (group, ident)}
    decided = small.select(group, *keys, *order).mapInArrow(
        whole_groups([group], _judged(group, contributors, order)), f"{group} {kind[group]}, {ident} {kind[ident]}, _kept boolean"
    )
    kept, removed = (decided.filter(c).select(group, ident) for c in (F.col("_kept"), ~F.col("_kept")))
    if some:
        # a large group is spread over its leaves by identifier, so that all deliveries of one meet
        spread = rows.join(large, group).withColumn("_leaf", F.xxhash64(ident) % F.lit(max(1, many // LEAF)))
        left = cut_lineage(latest(spread, F.col("_leaf")))
        sizes = cut_lineage(left.groupBy(group).agg(F.count("*").alias("_n")))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        every = left.select(group, ident)
        left = left.join(broadcast_if_small(sizes), group)
        for i, (key, share) in enumerate(contributors):
            rest = [group, *keys[i:], *order, "_n"]
            capped = left.select(*rest, F.greatest(F.lit(1), F.floor(F.col("_n") / share)).cast("bigint").alias("_cap"))
            best = keep_best(capped.filter(F.col(key).isNotNull()), [group, key], order, "_cap", max(1, largest // share), many)
            left = best.unionByName(capped.filter(F.col(key).isNull())).drop("_cap")
        survivors = cut_lineage(left.select(group, ident))
        kept = kept.unionByName(survivors)
        removed = removed.unionByName(every.join(survivors, [group, ident], "left_anti"))
    return kept, removed
