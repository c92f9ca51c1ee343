import itertools
import random
import time
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.operators import select as P
from pyspark.sql import functions as F


def sequential(items, prints):
    """The greedy procedure, one item after another."""
    accepted, out = [], {}
    by = {r["id"]: r for r in prints}
    for i, protected in sorted(items):
        p = by[i]
        exact = [a for a in accepted if by[a]["hash"] == p["hash"]]
        near = []
        for a in accepted:
            q = by[a]
            shared = any(x == y for x, y in zip(p["bands"], q["bands"]))
            w, v = set(p["words"]), set(q["words"])
            if shared and w and v and q["hash"] != p["hash"] and len(w & v) / len(w | v) >= D.THRESHOLD:
                near.append(a)
        if protected or not (exact or near):
            accepted.append(i)
            out[i] = ("accepted", None)
        elif exact:
            out[i] = ("exact_duplicate", min(exact))
        else:
            out[i] = ("near_duplicate", min(near))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_equals_the_sequential_procedure(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    texts = []
    for _ in range(150):
        base = r.choice(texts).split() if texts and r.random() < 0.7 else [r.choice(vocabulary) for _ in range(r.choice([0, 2, 20, 30]))]
        if base and r.random() < 0.6:
            base = list(base)
            base[r.randrange(len(base))] = r.choice(vocabulary)
        texts.append(" ".join(base))
    items = spark.createDataFrame([(i, t, r.random() < 0.1) for i, t in enumerate(texts)], "id bigint, text string, protected boolean")
    prints = D.fingerprints(items).collect()
    want = sequential([(x["id"], x["protected"]) for x in items.collect()], prints)
    got = {x["id"]: (x["decision"], x["duplicate_of"]) for x in D.dedupe(items).collect()}
    assert got == want
    assert Counter(d for d, _ in want.values())["near_duplicate"] > 3
    assert D.dedupe(items.limit(0)).count() == 0


def test_simhash_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, ""), (2, "one"), (3, "one two three four")], "id int, t string").withColumn("s", T.shingles(T.content_words(F.col("t"))))
    got = {r["id"]: r["h"] for r in df.select("id", D.simhash64(F.col("s")).alias("h")).collect()}
    assert got[1] == 0 and got[2] != got[3] != 0


def best(rows, needed, sources, authors):
    """Largest and cheapest feasible subset by trying all."""
    for n in range(min(needed, len(rows)), -1, -1):
        costs = []
        for pick in itertools.combinations(range(len(rows)), n):
            s, a = Counter(rows[i][0] for i in pick), Counter(rows[i][1] for i in pick if rows[i][1])
            if all(c <= sources[k] for k, c in s.items()) and all(c <= authors[k] for k, c in a.items()):
                costs.append(sum(rows[i][2] for i in pick))
        if costs:
            return n, min(costs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.sampled_from(["x", "y", "z", None]), st.integers(0, 30)), max_size=8), st.integers(0, 6), st.integers(0, 3), st.integers(0, 2))
def test_assignment_is_largest_and_cheapest(rows, needed, per_source, per_author):
    sources, authors = dict.fromkeys("ABC", per_source), dict.fromkeys("xyz", per_author)
    got = P.assign(rows, needed, sources, authors)
    n, cost = best(rows, needed, sources, authors)
    assert len(got) == n and sum(rows[i][2] for i in got) == cost
    assert all(c <= per_source for c in Counter(rows[i][0] for i in got).values())


COLUMNS = ["scene", "id", "source_name", "source_author", "confidence", "protected", "tie_hash", "selection_rank", "quota", "source_limit", "author_limit"]


def test_select_scene_keeps_protected_rows_within_the_limits():
    rows = [("s", i, f"src{i % 3}", f"a{i % 5}" if i % 4 else "", 0.5 + (i % 5) / 10, i < 2, "x", i, 10, 4, 2) for i in range(40)]
    frame = pd.DataFrame(rows, columns=COLUMNS)
    got = frame[frame["id"].isin(P.select_scene(frame)["id"])]
    assert len(got) == 10 and {0, 1} <= set(got["id"])
    assert got["source_name"].value_counts().max() <= 4
    assert got[got["source_author"] != ""]["source_author"].value_counts().max() <= 2


def test_protected_rows_beyond_the_quota_are_taken_by_rank_whatever_their_order():
    rows = [("s", i, f"src{i}", "", 0.5 + (i % 4) / 10, True, "ba"[i % 2], 0, 3, 3, 3) for i in range(9)] + [("s", 20, "src", "", 1.0, False, "a", 0, 3, 3, 3)]
    frame = pd.DataFrame(rows, columns=COLUMNS)
    for seed in range(3):
        assert P.select_scene(frame.sample(frac=1, random_state=seed))["id"].tolist() == [3, 7, 2]  # a conflict: no regular row is added


def test_assignment_of_a_whole_quota_takes_seconds():
    r = random.Random(2)
    rows = [(f"s{int(40 * r.random() ** 3)}", None if r.random() < 0.1 else f"a{int(900 * r.random() ** 3)}", r.randrange(10**6) * 1000 + i) for i in range(30_000)]
    began = time.perf_counter()
    got = P.assign(rows, 1_800, dict.fromkeys({s for s, _, _ in rows}, 810), dict.fromkeys({a for _, a, _ in rows if a}, 144))
    assert len(got) == 1_800 and time.perf_counter() - began < 20
    assert max(Counter(rows[i][0] for i in got).values()) <= 810 and max(Counter(rows[i][1] for i in got if rows[i][1]).values()) <= 144


def made_pool(spark):
    r = random.Random(4)
    rows = [(sc, i, f"src{int(4 * r.random() ** 2)}", f"a{r.randrange(6)}" if r.random() < 0.7 else "", round(r.random(), 1), r.random() < 0.03, f"h{r.randrange(9)}", 12) for sc in "xy" for i in range(120)]
    return spark.createDataFrame(rows, "scene string, id bigint, source_name string, source_author string, confidence double, protected boolean, tie_hash string, quota bigint")


def test_unbounded_and_remaining_selection(spark):
    pool = made_pool(spark)
    rows = {k: {(x["scene"], x["id"]) for x in P.select_quotas(pool, bounded=b).collect()} for k, b in (("kernel", True), ("whole", False))}
    cost = lambda got: sorted(pool.filter("NOT protected").join(spark.createDataFrame(sorted(got), "scene string, id bigint"), ["scene", "id"]).groupBy("scene").agg(F.sum("confidence"), F.count("*")).collect())
    assert rows["kernel"] == rows["whole"] and cost(rows["kernel"])
    held = spark.createDataFrame(sorted(rows["kernel"])[:7], "scene string, id bigint")
    added = P.select_remaining(pool.withColumn("protected", F.lit(False)), held)
    got = {(x["scene"], x["id"]) for x in added.collect()}
    assert got and not got & set(sorted(rows["kernel"])[:7]) and max(Counter(s for s, _ in got | set(sorted(rows["kernel"])[:7])).values()) <= 12


def test_selection_needs_variants_and_names_conflicts(spark):
    pool = made_pool(spark).filter("scene = 'x'")
    texts = pool.select("id", F.when(F.col("id") % 2 == 0, "The famous station stands near the old harbour.").otherwise("No.").alias("text"))
    assert all(r["id"] % 2 == 0 for r in P.select_checked(pool.withColumn("protected", F.lit(False)), texts).collect())
    with pytest.raises(P.ConflictError, match="x: quota"):
        P.select_checked(pool.withColumn("protected", F.lit(True)), texts)


def test_shortages_are_all_listed(spark):
    pool = spark.createDataFrame([("a", 3), ("b", 2)], "scene string, quota int")
    report = P.shortages(pool, spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "scene string, id int"))
    assert {tuple(r) for r in report.collect()} == {("a", 3, 1, 2), ("b", 2, 2, 0)}
    with pytest.raises(P.ShortageError, match="'a': 2"):
        P.require_quotas(report)
