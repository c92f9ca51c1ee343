import random

import numpy as np

from corpusloom.llm import cutoff


def sentence(r):
    who, what = r.choice(["Marlo", "Tessan", "Orvil", "Brenta"]), r.choice(["lamp", "ticket", "letter", "basket"])
    return r.choice([f"{who} carried the {what} across the old bridge.", f"Did {who} leave the {what} at the station?", f"The {what} that {who} bought was cheaper than expected."])


def corpus(n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = f"s{i % 4}"
        lines = [" ".join(sentence(r) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(2, 6))]
        text = "\n".join(lines)
        kind = r.random()
        label = 0
        if kind < 0.25:
            text += "\n" + r.choice([f"Page {r.randrange(99)}", "THE END", f"https://x.example/{r.randrange(99)}", "(applause)"])
        if source == "s0" and len(text) > 220:
            text = text[:220]
            label = int(not text.rstrip().endswith((".", "?")))
        elif kind > 0.93:
            part = cutoff.cut(text, r)
            if part:
                text, label = part, 1
        rows.append((i, text, source, label))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, label int, score int")
    got = {r["doc_id"]: r["score"] for r in cutoff.score_texts(df).collect()}
    truth = {i: y for i, _, _, y in rows}
    hits = sum(got[i] >= 0.5 and y for i, y in truth.items())
    assert sum(truth.values()) > 60 and len(got) == len(rows)
    assert hits / sum(truth.values()) > 0.9
    assert hits / sum(s >= 0.5 for s in got.values()) > 0.9


def test_blank_null_long_and_repeated(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n​", None), (4, "x " * 50000, None), (5, "Fine.", "b"), (5, "Fine.", "b"), (None, "Fine.", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    scored = cutoff.score_texts(df)
    got = sorted(((r["doc_id"], r["source"], r["score"] > 0) for r in scored.collect()), key=str)
    assert len(got) == 7 and [g for g in got if g[0] in (1, 2, 3)] == [(1, "a", False), (2, "a", False), (3, None, False)]
    rates = {r["source"]: r["texts"] for r in cutoff.cut_rates(scored).collect()}
    assert rates == {"a": 2, "b": 3, None: 2}
    assert cutoff.cut_off(df.limit(0)).count() == 0


def test_limits_need_enough_texts(spark):
    rows = [("a", "x" * 100)] * 9 + [("a", "y" * n) for n in range(70, 90)] + [("b", "x" * 100)] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id int, _source string, _text string")
    surveyed = cutoff.survey(df.repartition(3), 1.0, 7)
    assert surveyed.filter("x IS NULL").agg({"_n": "sum"}).first()[0] == len(rows)
    got = cutoff.source_limits(surveyed.filter("x IS NULL")).collect()
    assert [tuple(r) for r in got] == [("a", 100, 100)]


def test_regression_learns_and_cuts_are_inside_sentences():
    x = np.array([[1, 2], [1, 3], [4, 2], [4, 3]] * 50)
    y = np.array([1, 1, 0, 0] * 50)
    model = cutoff.LogisticRegression(8).fit(x, y)
    assert ((model.probability(x) > 0.5) == (y == 1)).all()
    r = random.Random(0)
    text = "One short sentence here. Another one follows it, and then it ends."
    for _ in range(100):
        part = cutoff.cut(text, r)
        assert part is None or not part.rstrip("…. ").endswith("here.") and len(part) < len(text) + 13
    assert cutoff.cut("tiny", r) is None
