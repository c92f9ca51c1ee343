import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.names import name_key
from corpusloom.llm import caps, quota, topn

SCHEMA = "_group bigint, _author string, _source string, _worse double, _tie string, _id bigint, _seen int, _cap string"


def made(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = 1 if r.random() < 0.6 else r.randrange(2, 5)
        a = None if r.random() < 0.2 else f"a{int(r.random() ** 3 * 9)}"
        rows.append((g, a, f"s{int(r.random() ** 2 * 4)}", r.choice([None, -1.0, -0.5, -0.25, 0.0]), r.choice([None, "aa", "ab", "b"]), i, 0, "clash"))
    return rows


def order(row):
    return (row[3] is None, row[3] or 0, row[4] is None, row[4] or "", row[5])


def capped(rows, limits):
    latest = {}
    for row in rows:
        if row[0] is not None and row[5] is not None:
            k = (row[0], row[5])
            if k not in latest or latest[k][6] < row[6]:
                latest[k] = row
    n = defaultdict(int)
    for g, _ in latest:
        n[g] += 1
    left = sorted(latest.values(), key=order)
    for column, share in limits:
        held, nxt = defaultdict(int), []
        for row in left:
            if row[column] is not None:
                held[row[0], row[column]] += 1
                if held[row[0], row[column]] > max(1, n[row[0]] // share):
                    continue
            nxt.append(row)
        left = nxt
    return {(r[0], r[5]) for r in left}, set(latest) - {(r[0], r[5]) for r in left}


@pytest.mark.parametrize("leaf,heap", [(50_000, 200_000), (40, 200_000), (40, 2), (1, 1)])
def test_caps_equal_brute_force(spark, monkeypatch, leaf, heap):
    monkeypatch.setattr(caps, "LEAF", leaf)
    monkeypatch.setattr(caps, "HEAP", heap)
    monkeypatch.setattr(caps, "FLUSH", 50)
    rows = made(600)
    rows += [(g, a, s, w, t, i, 1, c) for g, a, s, w, t, i, _, c in rows[::9]]  # delivered again
    rows += [(1, "other", "s0", -2.0, "aa", 5, 2, None), (None, "a1", "s1", -1.0, "aa", 3, 0, None), (1, "a1", "s1", -1.0, "aa", None, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept, removed = caps.cap_contributors(df, [("_author", 40), ("_source", 8)])
    want_kept, want_removed = capped(rows, [(1, 40), (2, 8)])
    assert {tuple(r) for r in kept.collect()} == want_kept
    assert sorted(tuple(r) for r in removed.collect()) == sorted(want_removed)


def test_caps_with_equal_scores_and_no_ties(spark, monkeypatch):
    """A contributor whose rows all rank alike but for the identifier is still cut in slices."""
    monkeypatch.setattr(caps, "LEAF", 10)
    monkeypatch.setattr(caps, "HEAP", 3)
    rows = [(1, "a", None, None, None, i, 0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept, removed = caps.cap_contributors(df, [("_author", 10), ("_source", 2)])
    assert sorted(r["_id"] for r in kept.collect()) == list(range(30)) and removed.count() == 270


def test_caps_tree_merge_and_empty(spark, monkeypatch):
    rows = made(300, 3)
    monkeypatch.setattr(caps, "LEAF", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        kept, _ = caps.cap_contributors(df, [("_author", 40), ("_source", 8)])
        assert {tuple(r) for r in kept.collect()} == capped(rows, [(1, 40), (2, 8)])[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    kept, removed = caps.cap_contributors(spark.createDataFrame([], SCHEMA), [("_author", 40)])
    assert kept.count() == removed.count() == 0


def test_top_n_equals_brute_force(spark, monkeypatch):
    rows = made(800, 5)
    rows += rows[::7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r[0], r[1], r[4]) for r in topn.top_n(df, ["_group", "_source"], ["_worse", "_tie", "_id"], 3).collect()}
    groups = defaultdict(dict)
    for row in rows:
        groups[row[0], row[2]][row[5]] = row
    want = {(g, s, r[5]) for (g, s), rs in groups.items() for r in sorted(rs.values(), key=order)[:3]}
    assert got == want
    monkeypatch.setattr(topn, "RUN", 5)
    monkeypatch.setattr(topn, "FLUSH", 20)
    monkeypatch.setattr(caps, "FLUSH", 20)
    again = topn.top_n(df, ["_group", "_source"], ["_worse", "_tie", "_id"], 3).collect()
    assert len(again) == len(want) and {(r[0], r[1], r[4]) for r in again} == want
    assert topn.top_n(df.limit(0), ["_group"], ["_worse", "_tie", "_id"], 3).count() == 0
    assert topn.top_n(df, ["_group"], ["_worse", "_tie", "_id"], 0).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(1)
    for k in range(0, 9):
        runs = [sorted((r.randrange(3), r.randrange(50)) for _ in range(r.randrange(6))) for _ in range(k)]
        tree, out, at = topn.LoserTree([x[0] if x else None for x in runs]), [], [0] * k
        while (i := tree.leaf) is not None:
            out.append(runs[i][at[i]])
            at[i] += 1
            tree.replace(runs[i][at[i]] if at[i] < len(runs[i]) else None)
        assert out == sorted(sum(runs, []))


def test_cell_quotas_fill_floors_first_and_show_shortfalls():
    quotas, short, beyond = quota.cell_quotas([5, 4, 2], [2, 2, 2], [(0, 0, 3), (0, 1, 9), (1, 0, 1)], [1, 9])
    assert sum(quotas[:2]) == 5 and quotas[2] == 1 and short == [0, 3, 2] and beyond == [0, 0]
    # both categories want 6, the strata give 4 and 3 at most: floors are served, then what is left
    quotas, short, _ = quota.cell_quotas([6, 6], [3, 3], [(0, 0, 9), (0, 1, 9), (1, 0, 9)], [4, 3], [4, 3])
    assert sum(quotas) == 7 and sum(short) == 5 and max(short) <= 3


def best_flow(targets, floors, cells, margins, limits):
    """The least (short of floors, short of targets, beyond margins) over all ways to fill the cells."""
    found = None
    for pick in itertools.product(*(range(n + 1) for _, _, n in cells)):
        by_category, by_stratum = [0] * len(targets), [0] * len(margins)
        for (c, s, _), q in zip(cells, pick):
            by_category[c] += q
            by_stratum[s] += q
        if any(g > t for g, t in zip(by_category, targets)) or any(m is not None and g > m for g, m in zip(by_stratum, limits)):
            continue
        below = sum(max(0, min(f, t) - g) for f, t, g in zip(floors, targets, by_category))
        short = sum(t - g for t, g in zip(targets, by_category))
        over = sum(max(0, g - m) for g, m in zip(by_stratum, margins))
        cost = below * quota.FLOOR_SLACK + (short - below) * quota.SLACK + over * quota.BEYOND
        found = cost if found is None else min(found, cost)
    return found


def test_flow_is_optimal_where_categories_compete_for_strata():
    """With limited strata min(target, available) a category is often infeasible; the flow finds the least cost."""
    r = random.Random(5)
    infeasible = 0
    for _ in range(150):
        targets, floors = [r.randrange(5) for _ in range(3)], [r.randrange(3) for _ in range(3)]
        cells = [(c, s, r.randrange(4)) for c in range(3) for s in range(2) if r.random() < 0.7]
        margins = [r.randrange(5), r.randrange(5)]
        limits = [r.choice([None, m, m + 2]) for m in margins]
        quotas, short, beyond = quota.cell_quotas(targets, floors, cells, margins, limits)
        got = [sum(q for (x, _, _), q in zip(cells, quotas) if x == c) for c in range(3)]
        given = [sum(q for (_, x, _), q in zip(cells, quotas) if x == s) for s in range(2)]
        assert all(q <= n for q, (_, _, n) in zip(quotas, cells)) and short == [t - g for t, g in zip(targets, got)]
        assert all(m is None or g <= m for g, m in zip(given, limits)) and beyond == [max(0, g - m) for g, m in zip(given, margins)]
        below = sum(max(0, min(f, t) - g) for f, t, g in zip(floors, targets, got))
        cost = below * quota.FLOOR_SLACK + (sum(short) - below) * quota.SLACK + sum(beyond) * quota.BEYOND
        assert cost == best_flow(targets, floors, cells, margins, limits)
        have = [sum(n for x, _, n in cells if x == c) for c in range(3)]
        infeasible += got != [min(t, h) for t, h in zip(targets, have)]
    assert infeasible > 20


def test_proportional_parts():
    assert quota.proportional(7, [1, 1, 1]) == [3, 2, 2] and quota.proportional(5, [0, 0]) == [0, 0]
    assert sum(quota.proportional(1000, [3, 5, 11])) == 1000


def test_quota_plan_and_draw(spark):
    rows = [(1, i, "a", i % 3) for i in range(60)] + [(1, 100 + i, "b", 0) for i in range(3)] + [(1, 200 + i, None, 1) for i in range(37)]
    rows += [(2, 1, "a", None), (None, 7, "a", 0), (1, 0, "a", 2), (1, None, "b", 0)]
    df = spark.createDataFrame(rows, "_group bigint, _id bigint, category string, stratum int")
    plan = quota.quota_plan(df, [("a", 3), ("b", 1)], 3, share=5, floor=2)
    cells = {(r["_group"], r["category"], r["stratum"]): (r["target"], r["available"], r["quota"], r["shortfall"]) for r in plan.collect()}
    assert cells[1, "b", 0] == (5, 3, 3, 2) and cells[2, "a", 2] == (2, 1, 1, 1) and cells[2, "b", None] == (2, 0, 0, 2)
    of_a = [cells[1, "a", s] for s in range(3)]
    # of 20 rows the strata (23, 20 and 20 rows) should give 7, 7 and 6; b takes 3 of the first
    given = [q for _, _, q, _ in of_a]
    assert sum(given) == 15 and all(q <= m for q, m in zip(given, (4, 7, 6)))
    drawn = quota.draw(df, plan, 3).collect()
    assert len(drawn) == len(set(drawn)) == 19
    assert sorted(map(tuple, quota.draw(df.repartition(7), plan, 3).collect())) == sorted(map(tuple, drawn))
    assert quota.quota_plan(df.limit(0), [("a", 3)]).count() == 0


@pytest.mark.parametrize("heap", [200_000, 2])
def test_draw_keeps_hot_cells_in_slices(spark, monkeypatch, heap):
    monkeypatch.setattr(caps, "HEAP", heap)
    df = spark.createDataFrame([(1, i, "a", 0) for i in range(200)], "_group bigint, _id bigint, category string, stratum int")
    plan = quota.quota_plan(df, [("a", 1)], share=5, floor=2)
    got = sorted(r["_id"] for r in quota.draw(df, plan).collect())
    lots = df.select("_id", F.xxhash64("_group", "_id", F.lit(7)).alias("lot")).orderBy("lot", "_id").limit(40).collect()
    assert got == sorted(r["_id"] for r in lots)


def test_name_keys(spark):
    same = ["Celfikilb R. Gralmikorsk", "by Celfikilb R. Gralmikorsk", "Gralmikorsk, Celfikilb R.", "ＣＥＬＦＩＫＩＬＢ_r_gralmikorsk ", "Cel​fikilb-R.-Gralmikorsk;", "(celfikilb R.　gralmikorsk)"]
    rows = spark.createDataFrame([(s,) for s in same], "n string").select(name_key(F.col("n"))).distinct().collect()
    assert rows == [("celfikilb gralmikorsk r",)]
    none = spark.createDataFrame([(None,), ("",), (" ​",), ("--",)], "n string").select(name_key(F.col("n"))).distinct().collect()
    assert none == [(None,)]
