"""Selection under quotas with limits on how much one source or one author may supply."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.tables import broadcast_if_small, with_places

SOURCE_SHARE, AUTHOR_SHARE = 0.45, 0.08


def limits(quota: Column) -> dict[str, Column]:
    """Limits of a scene and the bounds that a selection kernel may safely cut to."""
    source, author = F.greatest(F.lit(1), F.floor(quota * SOURCE_SHARE)), F.greatest(F.lit(1), F.floor(quota * AUTHOR_SHARE))
    whole = lambda a, b: F.floor(a / b)
    overall = quota + whole(quota, source) * (quota + source) + whole(quota, author) * (quota + author)
    bounds = {"source_limit": source, "author_limit": author, "pair_limit": F.least(source, author), "source_keep": quota + source, "author_keep": quota + author, "global_keep": overall}
    return {k: v.cast("bigint") for k, v in bounds.items()}


def _order() -> list[Column]:
    return [F.desc("confidence"), F.asc("tie_hash"), F.col("id").cast("string")]


def _author_key() -> Column:
    blank = F.trim(F.coalesce("source_author", F.lit(""))) == ""
    return F.when(blank, F.concat(F.lit("blank:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("author:"), "source_author"))


def bounded_candidates(pool: DataFrame, *, multiplier: int = 16) -> DataFrame:
    """Rows within twice the source and author limits by confidence, at most ``multiplier`` quotas a scene; protected
    rows always. ``pool``: scene, id, source_name, source_author, confidence, protected, quota. Places in a scene or source
    come from ranges, so neither is sorted in one task."""
    rows = pool.withColumns(limits(F.col("quota"))).withColumn("_author", _author_key())
    order = [F.desc("confidence"), F.asc("id")]
    rows = with_places(rows, ["scene", "source_name"], order, out="source_rank").withColumn("source_rank", (F.col("source_rank") + 1).cast("int"))
    rows = rows.withColumn("author_rank", F.row_number().over(Window.partitionBy("scene", "_author").orderBy(*order)))
    rows = rows.filter(F.col("protected") | ((F.col("source_rank") <= 2 * F.col("source_limit")) & (F.col("author_rank") <= 2 * F.col("author_limit"))))
    fixed = pool.groupBy("scene").agg(F.count_if("protected").alias("_protected"))
    placed = with_places(rows.join(broadcast_if_small(fixed), "scene"), ["scene"], [F.desc("protected"), *order])
    return placed.filter(F.col("_place") < F.col("_protected") + F.col("quota") * multiplier)


def kernel(pool: DataFrame) -> DataFrame:
    """The rows of each scene among which an optimal selection is sure to be found, with ``selection_rank``.

    Four cuts, each by rank: parallel rows of one source and author, rows of a source, rows of an author, rows of the
    scene. The rank is that in the full pool, so gaps stay; it and the place in the scene come from ranges, so no scene is
    sorted in one task. ``pool`` also needs tie_hash, which only protected rows keep.
    """
    rows = pool.withColumns(limits(F.col("quota"))).withColumn("_author", _author_key())
    blank = F.col("_author").startswith("blank:")
    regular = with_places(rows.filter(~F.col("protected")), ["scene"], _order(), out="selection_rank")
    # the rank stands for confidence, hash and id from here on, so the long hashes need not travel
    regular = regular.withColumns({"selection_rank": F.col("selection_rank").cast("int"), "tie_hash": F.lit(None).cast("string")})
    rank = lambda *keys: F.row_number().over(Window.partitionBy("scene", *keys).orderBy("selection_rank"))
    regular = regular.withColumn("_pair", rank("source_name", "_author")).filter(F.col("_pair") <= F.when(blank, F.col("source_limit")).otherwise(F.col("pair_limit")))
    regular = regular.withColumn("_source", rank("source_name")).filter(F.col("_source") <= F.col("source_keep"))
    regular = regular.withColumn("_by_author", rank("_author")).filter(blank | (F.col("_by_author") <= F.col("author_keep")))
    regular = with_places(regular, ["scene"], [F.col("selection_rank")]).filter(F.col("_place") < F.col("global_keep"))
    columns = [*pool.columns, "selection_rank"]
    return rows.filter("protected").withColumn("selection_rank", F.lit(None).cast("int")).select(columns).unionByName(regular.select(columns))


class _Arcs:
    """The rows of each (source, author) pair, cheapest first, as arcs of a residual graph held in arrays.

    Only the cheapest unused and the dearest used row of a pair can take part in the next improvement, so a pair is one arc
    each way however many rows it has. Relaxing all arcs of a kind is one minimum per end point, over arcs sorted by it.
    """

    FAR = 1 << 62

    def __init__(self, sources: np.ndarray, authors: np.ndarray, costs: np.ndarray):
        order = np.lexsort((costs, authors, sources))
        new = np.r_[True, (np.diff(sources[order]) != 0) | (np.diff(authors[order]) != 0)]
        self.rows = order
        self.begin = np.flatnonzero(new)
        self.end = np.r_[self.begin[1:], len(order)]
        self.cost = costs[order]
        self.source, self.author = sources[order][self.begin], authors[order][self.begin]
        self.taken = self.begin.copy()  # first unused row
        self.to_author = np.argsort(self.author, kind="stable")
        self.author_starts = np.flatnonzero(np.r_[True, np.diff(self.author[self.to_author]) != 0])
        self.source_starts = np.flatnonzero(np.r_[True, np.diff(self.source) != 0])
        self.forth = self.cost[self.begin].copy()
        self.back = np.full(len(self.begin), self.FAR, dtype=np.int64)

    def move(self, arc: int, step: int) -> None:
        at = self.taken[arc] = self.taken[arc] + step
        self.forth[arc] = self.cost[at] if at < self.end[arc] else self.FAR
        self.back[arc] = -self.cost[at - 1] if at > self.begin[arc] else self.FAR

    @staticmethod
    def _least(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least value, its place) of each stretch."""
        least = np.minimum.reduceat(values, starts)
        hit = np.flatnonzero(values == np.repeat(least, np.diff(np.r_[starts, len(values)])))
        which = np.searchsorted(starts, hit, side="right") - 1
        first = np.full(len(starts), -1)
        first[which[::-1]] = hit[::-1]
        return least, first

    def paths(self, has_room: np.ndarray, n_authors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least cost to reach each author from the sources with room, and the arc by which each author and source is reached."""
        at_source = np.where(has_room, 0, self.FAR)
        by_source = np.full(len(has_room), -1)
        at_author, by_author = np.full(n_authors, self.FAR), np.full(n_authors, -1)
        while True:
            reach = np.where((at_source[self.source] < self.FAR) & (self.forth < self.FAR), at_source[self.source] + self.forth, self.FAR)[self.to_author]
            least, place = self._least(reach, self.author_starts)
            names = self.author[self.to_author[self.author_starts]]
            better = least < at_author[names]
            at_author[names[better]], by_author[names[better]] = least[better], self.to_author[place[better]]
            back = np.where((at_author[self.author] < self.FAR) & (self.back < self.FAR) & (self.author > 0), at_author[self.author] + self.back, self.FAR)
            least, place = self._least(back, self.source_starts)
            names = self.source[self.source_starts]
            better = least < at_source[names]
            if not better.any():
                return at_author, by_author, by_source
            at_source[names[better]], by_source[names[better]] = least[better], place[better]


def assign(rows: list[tuple], needed: int, source_room: dict, author_room: dict) -> list[int]:
    """Positions of the rows of a largest selection of least cost. Rows are (source, author or None, whole cost).

    Every step adds the cheapest path from a source with room to an author with room, or to no author (number 0), which
    always has. A path costs a few passes over the arcs, each vectorised.
    """
    if not rows or needed <= 0:
        return []
    source_ids = {s: i for i, s in enumerate(dict.fromkeys(r[0] for r in rows))}
    author_ids = {None: 0} | {a: i for i, a in enumerate(dict.fromkeys(r[1] for r in rows if r[1] is not None), 1)}
    arcs = _Arcs(np.array([source_ids[r[0]] for r in rows]), np.array([author_ids[r[1]] for r in rows]), np.array([r[2] for r in rows], dtype=np.int64))
    room_s = np.array([source_room.get(s, 0) for s in source_ids])
    room_a = np.array([needed if a is None else author_room.get(a, 0) for a in author_ids])
    for _ in range(needed):
        at_author, by_author, by_source = arcs.paths(room_s > 0, len(room_a))
        ends = np.where(room_a > 0, at_author, arcs.FAR)
        author = int(ends.argmin())
        if ends[author] >= arcs.FAR:
            break
        room_a[author] -= author > 0
        arc = int(by_author[author])
        while True:
            arcs.move(arc, 1)
            source = int(arcs.source[arc])
            undone = int(by_source[source])
            if undone < 0:
                break
            arcs.move(undone, -1)
            arc = int(by_author[arcs.author[undone]])
        room_s[source] -= 1
    return sorted(int(i) for b, t in zip(arcs.begin, arcs.taken) for i in arcs.rows[b:t])


def select_scene(frame: pd.DataFrame) -> pd.DataFrame:
    """One scene's selection: protected rows first, by confidence, hash and id, then the best assignment within what they
    leave of the limits. Where protected rows alone break the quota or a limit, nothing is added to them
    (``protected_conflicts`` lists why)."""
    frame = frame.reset_index(drop=True)
    out = ["scene", "id", "confidence"]
    if frame.empty:
        return frame[out]
    quota, by_source, by_author = (int(frame[c].iloc[0]) for c in ("quota", "source_limit", "author_limit"))
    named = frame["source_author"].fillna("").str.strip()
    fixed = frame[frame["protected"]]
    fixed = fixed.assign(_minus=-fixed["confidence"], _name=fixed["id"].astype(str)).sort_values(["_minus", "tie_hash", "_name"])
    of_source, of_author = fixed["source_name"].value_counts(), named[fixed.index][lambda a: a != ""].value_counts()
    if len(fixed) > quota or (of_source > by_source).any() or (of_author > by_author).any():
        return fixed.head(quota)[out]
    source_room = {s: by_source - int(of_source.get(s, 0)) for s in frame["source_name"].unique()}
    author_room = {a: by_author - int(of_author.get(a, 0)) for a in named.unique() if a}
    regular = frame[~frame["protected"]]
    needed = quota - len(fixed)
    ranks = regular["selection_rank"].astype("int64").to_numpy()
    scale = needed * (int(ranks.max(initial=0)) + 1) + 1
    score = (1_000_000 - (regular["confidence"].astype(float).clip(0, 1) * 1_000_000).round()).astype("int64").to_numpy()
    rows = list(zip(regular["source_name"], (named[regular.index].where(lambda a: a != "", None)), (score * scale + ranks).tolist()))
    rows = [(s, a or None, c) for s, a, c in rows]
    return pd.concat([fixed, regular.iloc[assign(rows, needed, source_room, author_room)]])[out]


def select_quotas(pool: DataFrame, *, bounded: bool = True) -> DataFrame:
    """(scene, id, confidence): the selection of every scene. The kernel bounds what one task holds: for a quota of
    1,800 at most about 30,000 rows, whatever the size of the pool. Unbounded, whole scenes are assigned, with the same
    result, as the kernel loses no optimal selection; that is for pools whose scenes fit a task."""
    if bounded:
        rows = kernel(pool)
    else:
        fixed = pool.filter("protected").withColumn("selection_rank", F.lit(None).cast("int"))
        ranked = with_places(pool.filter(~F.col("protected")), ["scene"], _order(), out="selection_rank")
        rows = fixed.unionByName(ranked.withColumn("selection_rank", F.col("selection_rank").cast("int")))
    rows = rows.withColumns(limits(F.col("quota")))
    return rows.groupBy("scene").applyInPandas(select_scene, "scene string, id bigint, confidence double")


def select_remaining(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """What can be added to an earlier selection within what it leaves of quotas and limits. ``selected`` has scene and id."""
    marks = selected.select("scene", "id").distinct().withColumn("_held", F.lit(True))
    rows = pool.join(marks, ["scene", "id"], "left").withColumn("protected", F.coalesce("_held", F.lit(False))).drop("_held")
    return select_quotas(rows).join(marks, ["scene", "id"], "left_anti")


def variant_ready(pool: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of a pool whose sentence (``texts``: id, text) has three variants; protected rows are not spared."""
    from corpusloom.operators.variants import with_variants

    return pool.join(with_variants(texts).select("id"), "id", "left_semi")


def select_checked(pool: DataFrame, texts: DataFrame) -> DataFrame:
    """The selection of sentences with variants; conflicts of protected rows are an error that names them."""
    ready = variant_ready(pool, texts)
    conflicts = protected_conflicts(ready).limit(100).collect()
    if conflicts:
        raise ConflictError("; ".join(f"{r['scene']}: {r['kind']} {r['name']} {r['n']} > {r['allowed']}" for r in sorted(conflicts)))
    return select_quotas(ready)


class ConflictError(ValueError):
    """Raised where protected rows alone break a quota or limit."""


def shortages(pool_scenes: DataFrame, selected: DataFrame) -> DataFrame:
    """(scene, quota, selected, shortage) of all scenes with a quota."""
    n = selected.groupBy("scene").agg(F.count("*").alias("selected"))
    every = pool_scenes.select("scene", "quota").distinct().join(n, "scene", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return every.withColumn("shortage", F.greatest(F.lit(0), F.col("quota") - F.col("selected")))


class ShortageError(ValueError):
    """Raised with all shortages listed."""


def require_quotas(report: DataFrame) -> None:
    """Raises if a scene is short; the report has one row per scene, a small dimension."""
    missing = {r["scene"]: r["shortage"] for r in report.filter("shortage > 0").orderBy("scene").limit(10_000).collect()}
    if missing:
        raise ShortageError(f"scenes short of their quota: {missing}")


def concentration(selected: DataFrame) -> DataFrame:
    """Per scene: rows, and the largest source and named author with their counts and shares. Ties go to the smaller name."""

    def largest(key: str, name: str, rows: DataFrame) -> DataFrame:
        n = rows.groupBy("scene", key).agg(F.count("*").alias("n"))
        top = n.groupBy("scene").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(key).alias("who"))).alias("top"))
        return top.select("scene", F.col("top.who").alias(f"max_{name}"), (-F.col("top.minus")).alias(f"max_{name}_count"))

    total = selected.groupBy("scene").agg(F.count("*").alias("total"))
    named = selected.filter(F.trim("source_author") != "")
    report = total.join(largest("source_name", "source", selected), "scene").join(largest("source_author", "author", named), "scene", "left")
    share = lambda n: F.round(F.coalesce(F.col(n), F.lit(0)) / F.col("total"), 6)
    return report.withColumns({"max_source_share": share("max_source_count"), "max_author_share": share("max_author_count")}).fillna({"max_author": "", "max_author_count": 0})


def protected_conflicts(pool: DataFrame, *, most: int = 8) -> DataFrame:
    """(scene, kind, name, n, allowed): where protected rows alone break a scene's quota or limits; per scene and kind
    the ``most`` largest."""
    fixed = pool.filter("protected").withColumns(limits(F.col("quota")))
    whole = fixed.groupBy("scene", "quota").agg(F.count("*").alias("n")).filter("n > quota").select("scene", F.lit("quota").alias("kind"), F.lit("").alias("name"), "n", F.col("quota").cast("bigint").alias("allowed"))
    out = whole
    for kind, column in (("source", F.col("source_name")), ("author", F.trim("source_author"))):
        n = fixed.withColumn("name", column).filter(F.lit(kind == "source") | (F.col("name") != "")).groupBy("scene", "name", F.col(f"{kind}_limit").alias("allowed")).agg(F.count("*").alias("n"))
        place = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("n"), "name"))
        over = n.filter("n > allowed").withColumn("p", place).filter(F.col("p") <= most)
        out = out.unionByName(over.select("scene", F.lit(kind).alias("kind"), "name", "n", "allowed"))
    return out


def author_share_violations(rows: DataFrame, share: float = AUTHOR_SHARE) -> DataFrame:
    """(scene, author, n, allowed): named authors with more than their share of a published scene."""
    total = rows.groupBy("scene").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).cast("bigint").alias("allowed"))
    n = rows.withColumn("author", F.trim("source_author")).filter("author <> ''").groupBy("scene", "author").agg(F.count("*").alias("n"))
    return n.join(total, "scene").filter("n > allowed").select("scene", "author", "n", "allowed")


def balanced_reservoir(rows: DataFrame, *, quota: int) -> DataFrame:
    """Per category the rows of smallest text hash, max(8 quotas, quota + 4): the reservoir of a balanced curation."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("hash", "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= max(8 * quota, quota + 4))
