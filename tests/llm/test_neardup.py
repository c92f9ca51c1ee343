import random
from itertools import combinations

import numpy as np
import pytest

from corpusloom.functions.pytext import words
from corpusloom.llm import neardup


def brute(rows, t):
    sets = [(i, frozenset(words(x)), x or "") for i, x in rows]
    out = set()
    for (i, a, x), (j, b, y) in combinations(sets, 2):
        alike = len(a & b) >= t * len(a | b) - 1e-9 if a | b else x == y
        if alike and i != j:
            out.add((min(i, j), max(i, j)))
    return out


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.random() ** 2 * 120)}" for _ in range(400)]
    rows = []
    for _ in range(n):
        base = r.choice(rows)[1].split() if rows and r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randrange(1, 14))]
        if r.random() < 0.6 and base:
            base = list(base)
            base[r.randrange(len(base))] = r.choice(vocabulary)
        rows.append((f"s{len(rows):03d}", " ".join(base)))
    return rows


@pytest.mark.parametrize("block,leaf,t", [(4096, 64, 0.7), (6, 3, 0.7), (5, 2, 0.8)])
def test_pairs_equal_brute_force(spark, monkeypatch, block, leaf, t):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup.VantageJoin.__init__, "__defaults__", (leaf,))
    rows = texts(250, 4)
    rows += [("x1", ""), ("x2", None), ("x3", " . "), ("x4", " . "), ("x5", "<b>Ｗ1</b>&amp;w2 w​3"), ("x6", "w1 W2 w'3"), ("y1", "one two " * 4000)]
    rows += [(f"z{i}", "the same text again and again here") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "text as _words", "1 as _set")
    got = [tuple(r) for r in neardup.expand_pairs(*neardup.near_duplicates(df.repartition(3), t=t)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t)


def test_vantage_join_loses_no_pair():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(3, 12)) * 7919) for _ in range(300)]
    sizes = np.array([len(s) for s in sets])
    fp = neardup.fingerprints(sets)
    want = {(i, j) for i, j in combinations(range(300), 2) if len(np.setxor1d(sets[i], sets[j])) <= 3 / 17 * (sizes[i] + sizes[j])}
    for leaf in (2, 10, 400):
        join = neardup.VantageJoin(fp, sizes, 3 / 17, leaf)
        got = [(min(i, j), max(i, j)) for a, b in join.within(np.arange(300)) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and want <= set(got)
        half = [(min(i, j), max(i, j)) for a, b in join.across(np.arange(150), np.arange(150, 300)) for i, j in zip(a.tolist(), b.tolist())]
        assert {p for p in want if p[0] < 150 <= p[1]} <= set(half) and len(half) == len(set(half))


def test_classes_are_components(spark):
    rows = texts(150, 9) + [("lone", "nothing like the others in this table at all")]
    df = spark.createDataFrame(rows, "id string, text string")
    links, members = neardup.near_duplicates(df, t=0.7)
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(links, members).collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows, 0.7):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: c for i, (c, _) in got.items()} == {i: find(i) for i, _ in rows}
    assert got["lone"] == ("lone", 0)
    links, members = neardup.near_duplicates(df.limit(0))
    assert neardup.classes(links, members).count() == 0 and neardup.expand_pairs(links, members).count() == 0
