"""Samples that follow target proportions: min-cost flow on cross-classified cell counts.

The rows of a group (run) are cross-classified by category and by stratum, a second classification whose proportions the
sample should keep. The network is source -> category -> cell -> stratum -> sink. The arcs into a category carry its target,
split into a floor and the rest, so that floors are filled first; a cell's arc carries the rows available in it; the arcs out
of a stratum carry its margin at no cost, what it gives beyond that at some cost, up to its limit if it has one. A slack arc
a category costs more than any detour and takes what the cells cannot give: flow on it is the category's shortfall. Flow on
cell arcs are the integer quotas of the cells, which are then drawn at random.

Shortfalls come before margins: a category is short only if its rows, or the limits of its strata, leave no other way. Where
no stratum is limited, a category's shortfall is therefore max(0, target - available), but which cells give its rows still
depends on all categories together, since they share the strata.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.tables import broadcast_if_small, cut_lineage

from . import caps
from .caps import keep_best

#: Cost of a unit: within all margins, beyond a stratum's margin, short of a target, short of a floor.
REAL, BEYOND, SLACK, FLOOR_SLACK = 0, 10, 1_000, 1_000_000


class Network:
    """Min-cost flow by the primal-dual method: blocking flows on the arcs of zero reduced cost."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        """An arc with its reverse; its number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, s: int) -> list[float]:
        far = float("inf")
        dist = [far] * len(self.arcs)
        dist[s] = 0
        queue, queued = [s], {s}
        for x in queue:
            queued.discard(x)
            for e in self.arcs[x]:
                if self.room[e] and dist[x] + self.cost[e] < dist[self.to[e]]:
                    dist[self.to[e]] = dist[x] + self.cost[e]
                    if self.to[e] not in queued:
                        queue.append(self.to[e])
                        queued.add(self.to[e])
        return dist

    def solve(self, s: int, t: int) -> int:
        """Sends all the flow it can from s to t at least cost; the amount."""
        total = 0
        while (dist := self._distances(s))[t] < float("inf"):
            at = [0] * len(self.arcs)
            on_path = [False] * len(self.arcs)

            def push(x: int, most: int) -> int:
                if x == t:
                    return most
                on_path[x] = True
                sent = 0
                while at[x] < len(self.arcs[x]) and sent < most:
                    e = self.arcs[x][at[x]]
                    y = self.to[e]
                    got = 0
                    if self.room[e] and not on_path[y] and dist[y] == dist[x] + self.cost[e]:
                        got = push(y, min(most - sent, self.room[e]))
                        self.room[e] -= got
                        self.room[e ^ 1] += got
                        sent += got
                    if sent < most:
                        at[x] += 1
                on_path[x] = False
                return sent

            while sent := push(s, 1 << 62):
                total += sent
                at = [0] * len(self.arcs)
        return total


def cell_quotas(
    targets: list[int], floors: list[int], cells: list[tuple[int, int, int]], margins: list[int], limits: list[int | None] | None = None
) -> tuple[list[int], list[int], list[int]]:
    """(quota of each cell, shortfall of each category, rows of each stratum beyond its margin).

    ``cells`` lists (category, stratum, available rows). ``margins`` are the strata's shares of the sample, ``limits`` the
    most that each may give, None for no limit.
    """
    k, m = len(targets), len(margins)
    source, sink = k + m, k + m + 1
    net = Network(sink + 1)
    slack, beyond = [], []
    for c in range(k):
        floor = min(floors[c], targets[c])
        net.add(source, c, floor, REAL)
        net.add(source, c, targets[c] - floor, REAL)
        slack.append((net.add(c, sink, floor, FLOOR_SLACK), net.add(c, sink, targets[c] - floor, SLACK)))
    for s in range(m):
        most = None if limits is None else limits[s]
        net.add(k + s, sink, margins[s] if most is None else min(margins[s], most), REAL)
        beyond.append(net.add(k + s, sink, sum(targets) if most is None else max(0, most - margins[s]), BEYOND))
    mid = [net.add(c, k + s, available, REAL) for c, s, available in cells]
    net.solve(source, sink)
    sent = lambda arc: net.room[arc ^ 1]
    return [sent(e) for e in mid], [sent(a) + sent(b) for a, b in slack], [sent(e) for e in beyond]


def proportional(total: int, weights: list[int]) -> list[int]:
    """``total`` parted in proportion to the weights, in whole numbers, by largest remainders; ties go to the first."""
    whole = sum(weights)
    if not whole:
        return [0] * len(weights)
    parts = [total * w // whole for w in weights]
    rest = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % whole), i))
    for i in rest[: total - sum(parts)]:
        parts[i] += 1
    return parts


def plan_quotas(cells: DataFrame, sizes: DataFrame, categories: list[tuple[str, int]], strata: int, *, share: int, floor: int) -> DataFrame:
    """(group, category, stratum, target, available, quota, shortfall) for every group of ``sizes`` and every cell.

    ``cells`` has (_group, category, stratum, n), n the rows available; ``sizes`` has (_group, _n). The sample takes
    ``_n // share`` rows a group, of which a category's target is ``max(floor, sample * weight // sum of weights)``; the
    margin of a stratum is its proportion of the group's cell rows. ``target`` and ``shortfall`` are those of the category,
    on each of its rows; a category without any cell has one row with a null stratum. ``categories`` are (name, weight > 0):
    a small fixed dimension, at most 10,000, as ``strata`` is, at most 100. A group's network has no more cells than these
    allow, however many rows the group has.
    """
    if len(categories) > 10_000 or strata > 100:
        raise ValueError("plan_quotas is for small dimensions of categories and strata")
    names, weights = [c for c, _ in categories], [w for _, w in categories]
    place, total = {c: i for i, c in enumerate(names)}, sum(w for _, w in categories)
    columns = ("_group", "category", "stratum", "target", "available", "quota", "shortfall")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for row in b.to_pylist():
                sample = row["_n"] // share
                targets = [max(floor, sample * w // total) for w in weights]
                cells = [(place[c["category"]], c["stratum"], c["n"]) for c in row["cells"] or [] if c["category"] in place]
                have = [0] * strata
                for _, s, n in cells:
                    have[s] += n
                quotas, short, _ = cell_quotas(targets, [floor] * len(targets), cells, proportional(sum(targets), have))
                seen = {c for c, _, _ in cells}
                found = [(c, s, n, q) for (c, s, n), q in zip(cells, quotas)] + [(i, None, 0, 0) for i in range(len(names)) if i not in seen]
                for c, s, n, q in sorted(found, key=lambda x: (x[0], x[1] or 0)):
                    for k, v in zip(columns, (row["_group"], names[c], s, targets[c], n, q, short[c])):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    kind = sizes.schema["_group"].dataType.simpleString()
    schema = pa.schema([("_group", pa.int64() if kind == "bigint" else pa.string()), ("category", pa.string()), ("stratum", pa.int32()), *((c, pa.int64()) for c in columns[3:])])
    gathered = cells.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("category", "stratum", "n"))).alias("cells"))
    return sizes.join(gathered, "_group", "left").select("_group", "_n", "cells").mapInArrow(
        task, f"_group {kind}, category string, stratum int, target bigint, available bigint, quota bigint, shortfall bigint"
    )


def one_cell_each(rows: DataFrame, strata: int) -> DataFrame:
    """(_group, _id, category, stratum): each row of a category once, in the least of the strata that its deliveries name,
    or the last one if they name none."""
    return rows.groupBy("_group", "_id", "category").agg(F.coalesce(F.min("stratum"), F.lit(strata - 1)).alias("stratum"))


def quota_plan(rows: DataFrame, categories: list[tuple[str, int]], strata: int = 1, *, share: int = 5, floor: int = 2) -> DataFrame:
    """The quota plan of rows (_group, _id, category, stratum); category null: the row counts in the group's size only.

    ``stratum`` is a number below ``strata``. Defined results: rows with a null group or identifier are ignored; repeated
    (group, identifier) count once in the size and once in each category they name, in the least of their strata there; a
    null stratum is the last one; every group has a row for every category, available 0 included; with no categories or an
    empty table there is no row.
    """
    rows = rows.filter(F.col("_group").isNotNull() & F.col("_id").isNotNull())
    pairs = one_cell_each(rows, strata)
    sizes = pairs.groupBy("_group").agg(F.count_distinct("_id").alias("_n"))
    cells = pairs.filter(F.col("category").isNotNull()).groupBy("_group", "category", "stratum").agg(F.count("*").alias("n"))
    return plan_quotas(cells, sizes, categories, strata, share=share, floor=floor)


def draw(rows: DataFrame, plan: DataFrame, strata: int = 1, *, seed: int = 7) -> DataFrame:
    """(_group, _id, category): of each cell as many rows as its quota, at random by a seeded hash of the identifier.

    The hash decides alone, so the draw is the same on every run and partitioning. Cells are cut to their quota by
    bounded heaps, so a hot cell is never sorted whole in one task. ``plan`` is kept in the checkpoint folder.
    """
    last = rows.dropna(subset=["_group", "_id", "category"])
    plan = cut_lineage(plan.filter(F.col("quota") > 0).select("_group", "category", "stratum", "quota", "available"))
    largest, held = plan.agg(F.max("quota"), F.sum(F.when(F.col("quota") > caps.HEAP, F.col("available")))).first()
    lots = one_cell_each(last, strata).join(broadcast_if_small(plan.drop("available")), ["_group", "category", "stratum"])
    lots = lots.select("_group", "category", "stratum", F.xxhash64("_group", "_id", F.lit(seed)).alias("_lot"), "_id", "quota")
    return keep_best(lots, ["_group", "category", "stratum"], ["_lot", "_id"], "quota", largest or 0, held or 0).select("_group", "_id", "category")
