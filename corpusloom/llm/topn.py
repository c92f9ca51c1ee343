"""Top N items within every group by merging sorted runs with a loser tree.

Every map task sorts its rows by group and rank into runs that hold only the first N of each group; the shuffle stores the
runs bucketed by group. A reduce task reads the runs of its bucket side by side, merges them with a loser tree and, after N
outputs of a group, seeks each run to its next group. A group of millions of items reaches the reducer as at most N rows a
run, and the reducer holds the runs of one group at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caps import FLUSH, changes, whole_groups

#: Rows at which a map task closes a run and begins the next.
RUN = 262_144


class LoserTree:
    """A tournament over sorted runs: ``leaf`` is the run with the least head, None at the end.

    Inner nodes hold the loser of their match, so replacing the winner's head replays one path.
    """

    def __init__(self, heads: list):
        self.k = len(heads)
        self.heads = heads  # None: the run has ended
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = i
                return
            if self._less(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    @property
    def leaf(self) -> int | None:
        if self.k == 0:
            return None
        winner = self.losers[0]
        return None if self.heads[winner] is None else winner

    def replace(self, head) -> None:
        """Gives the winner's run a new head (None: ended) and replays its path."""
        i = self.losers[0]
        self.heads[i] = head
        node = (i + self.k) // 2
        while node > 0:
            if self._less(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i


def sorted_run(t: pa.Table, group: Sequence[str], order: Sequence[str], n: int) -> pa.Table:
    """The first n distinct items (by the last order column) of each group, sorted by group and order."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (*group, *order)]))
    numbers = np.cumsum(changes(t, group))
    ids = t[order[-1]].to_numpy()
    place = np.arange(t.num_rows)
    by = np.lexsort((place, ids, numbers))
    again = np.zeros(t.num_rows, dtype=bool)
    again[by[1:]] = (numbers[by[1:]] == numbers[by[:-1]]) & (ids[by[1:]] == ids[by[:-1]])
    t, numbers = t.filter(pa.array(~again)), numbers[~again]
    place = np.arange(t.num_rows)
    first = np.maximum.accumulate(np.where(np.diff(numbers, prepend=-1) != 0, place, 0))
    return t.filter(pa.array(place - first < n))


def _run_task(group: Sequence[str], order: Sequence[str], n: int):
    """A task that sorts its rows into runs, each the first n of every group; a run is closed at RUN rows, so a task holds
    no more than that however many groups it meets."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit, number = 0, FLUSH, 0

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("_run", pa.array(np.full(t.num_rows, number, dtype=np.int64))).to_batches(max_chunksize=16_384)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > limit:
                kept = sorted_run(pa.Table.from_batches(held), group, order, n)
                held, rows = kept.to_batches(), kept.num_rows
                limit = max(FLUSH, 2 * rows)
                if rows > RUN:
                    yield from run(kept)
                    held, rows, limit, number = [], 0, FLUSH, number + 1
        if rows:
            yield from run(sorted_run(pa.Table.from_batches(held), group, order, n))

    return task


def merge_runs(runs: list[list[tuple]], n: int) -> Iterator[tuple]:
    """Rows (group, key, item) of sorted runs, merged; only the first n distinct items of each group."""
    at = [0] * len(runs)
    tree = LoserTree([r[0][:2] if r else None for r in runs])
    group, taken = None, set()
    while (i := tree.leaf) is not None:
        row = runs[i][at[i]]
        if not taken or row[0] != group:
            group, taken = row[0], set()
        if len(taken) < n:
            if row[2] not in taken:
                taken.add(row[2])
                yield row
            at[i] += 1
        else:  # seek to the run's next group
            at[i] = bisect_right(runs[i], group, lo=at[i], key=lambda r: r[0])
        tree.replace(runs[i][at[i]][:2] if at[i] < len(runs[i]) else None)


def _sortable(values: list) -> list[tuple]:
    """Values that compare with nulls last."""
    return [(v is None, v if v is not None else 0) for v in values]


def _merge_task(group: Sequence[str], order: Sequence[str], n: int, out: Sequence[str]):
    """A task over a bucket's runs in the order of group and run, as Spark's sort, which spills, hands them over. The runs
    are read side by side, a stretch of whole groups at a time: what is held is a batch and the runs of one group."""

    def merged(t: pa.Table) -> pa.Table:
        numbers = np.cumsum(changes(t, group)).tolist()
        keys = list(zip(*(_sortable(t[c].to_pylist()) for c in order)))
        ids = t[order[-1]].to_pylist()
        runs: dict[tuple, list[tuple]] = {}
        for i, run in enumerate(zip(t["_task"].to_pylist(), t["_run"].to_pylist())):
            runs.setdefault(run, []).append((numbers[i], keys[i], ids[i], i))
        chosen = pa.array([row[3] for row in merge_runs(list(runs.values()), n)], pa.int64())
        return t.select(list(out)).take(chosen)

    return whole_groups(group, merged)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n best rows of every group; ``order`` is ascending with nulls last, its last column identifies the item.

    Defined results: rows with a null group column or identifier are dropped; an item delivered more than once counts
    once, at its best rank; ties are settled by the order columns to the identifier, so the result never depends on the
    partitioning; groups with fewer than n items come out whole; n < 1 and empty tables give no rows. Only the group and
    order columns are returned, so other columns, whatever their names, play no part.
    """
    columns = [*group, *order]
    df = df.select(*columns).dropna(subset=[*group, order[-1]])
    if n < 1:
        return df.limit(0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    runs = df.mapInArrow(_run_task(group, order, n), f"{kinds}, _run bigint").withColumn("_task", F.spark_partition_id())
    inside = [F.col(c).asc_nulls_last() for c in order]
    buckets = runs.repartition(*group).sortWithinPartitions(*group, "_task", "_run", *inside)
    return buckets.mapInArrow(_merge_task(group, order, n, columns), df.schema)
