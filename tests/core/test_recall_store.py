import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import progress as G
from corpusloom.operators import recall as R
from corpusloom.operators import review as V
from corpusloom.operators import stages, store, translate, variants
from corpusloom.streaming import micro


def test_vector_top_k_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(1)
    pool = [(i, r.normal(size=6).tolist()) for i in range(80)] + [(100, None), (101, [0.0] * 6)]
    protos = [("a", r.normal(size=6).tolist()), ("a", r.normal(size=6).tolist()), ("b", r.normal(size=6).tolist())]
    p = spark.createDataFrame(pool, "vec_id bigint, embedding array<double>").repartition(5)
    q = spark.createDataFrame(protos, "label string, embedding array<double>")
    out = spark.createDataFrame([("a", 3), ("b", 4)], "label string, vec_id bigint")

    def want(label, skip):
        m = [np.array(v) / np.linalg.norm(v) for x, v in protos if x == label]
        sims = [(-max(np.dot(np.array(v) / max(np.linalg.norm(v), 1e-7), w) for w in m), i) for i, v in pool if v and i != skip]
        return [i for _, i in sorted(sims)[:7]]

    for limit in (20_000, 2):
        monkeypatch.setattr(R, "MAX_PROTOTYPES", limit)
        got = R.vector_top_k(p, q, 7, exclude=out).orderBy("label", "rank").collect()
        assert [x["vec_id"] for x in got if x["label"] == "a"] == want("a", 3)
        assert [x["vec_id"] for x in got if x["label"] == "b"] == want("b", 4)
    assert R.vector_top_k(p.limit(0), q, 3).count() == 0


def test_review_rules(spark):
    s = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.9), (1, "z", 0.5), (2, "x", 0.1)], "item_id int, scene string, similarity double")
    merged = V.merge_suggestions(s)
    assert {r["item_id"]: (r["family"], r["scenes"]) for r in merged.collect()} == {1: ("y", ["y", "x", "z"]), 2: ("x", ["x"])}
    bad = spark.createDataFrame([(1, "q"), (2, "x"), (1, None)], "item_id int, scene string")
    assert [tuple(r) for r in V.outside_suggestions(bad, merged).collect()] == [(1, "q")]
    with pytest.raises(ValueError):
        V.batches(merged, 0)


@pytest.mark.parametrize(
    "source,translation,mismatch",
    [
        ("It costs 1,500 dollars.", "价格是1500美元。", False), ("About 2 million people.", "约200万人。", False), ("The 3rd of May at 10:30.", "5月3日10:30。", False),
        ("He has 3 cats and 3 dogs.", "他有3只猫。", True), ("Version 1.2.3 is out.", "1.2.3版发布。", False), ("It weighs 5kg.", "重5公斤。", False),
        ("No numbers here.", "有7个。", False), ("2.50 euros", "2.5欧元", False), ("twenty 20", "二十", True), ("12 345 points", "12345分", False),
    ],
)
def test_numbers_compare_by_value(spark, source, translation, mismatch):
    df = spark.createDataFrame([(source, translation)], "s string, t string")
    assert df.select(translate.lacks(translate.numbers(F.col("s")), translate.numbers(F.col("t")))).first()[0] == mismatch


def test_translation_issues(spark):
    fine, money = [], ["currency_mismatch"]
    rows = [
        ("It costs 5 dollars.", "价格是5美元。", fine), ("Hello there my friend.", "", ["empty_translation"]), ("Hello there.", "Hello there again friends", ["low_chinese_ratio", "english_residue"]),
        ("It costs 5 euros.", "价格是5美元。", money), ("Half is 50 percent.", "一半是50。", ["percentage_mismatch"]), ("She lost 5 pounds of weight.", "她减了5磅。", fine),
        ("Hi.", "你" * 30, ["abnormal_length"]), ("He paid 7 crowns.", "他付了钱。", ["number_mismatch"]), (None, "你好。", fine), ("I have 3, 4 or 5 of them in 2019, 30 in all.", "我有3、4或5个，2019年共30个。", fine),
        ("We leave at 8:15.", "我们8点15分出发。", fine), ("It has 60,000 seats.", "它有6万个座位。", fine), ("They spent 2.5 billion dollars.", "他们花了25亿美元。", fine), ("Come by March 2nd.", "3月2日前来。", fine),
        ("The lamp is $1350. 00 now.", "灯现在是1350.00美元。", fine), ("It opens at 6. 30 pm today.", "今天晚上6:30开门。", fine), ("See 4. 12 Members stand in the hall.", "见第4项，12名成员站在大厅里。", fine), ("The code is ab12cd here.", "代码是AB12CD。", fine),
        ("Pay 9 yen.", "付9日元。", fine), ("Pay ¥9 now.", "现在付9日元。", money), ("The lunch is 30 yuan.", "午饭30元。", fine), ("Swap 90 yen for Canadian dollars.", "用90日元换加拿大元。", fine), ("Pay 9 pounds.", "付9英镑。", fine),
        ("She is 120 pounds, 54 kg and 30 years old.", "她120磅（54公斤），30岁。", fine), ("We ate at Golden Yen Restaurant.", "我们在金燕餐厅吃饭。", fine), ("My friend is Tony Yen.", "我的朋友是甄东尼。", fine), ("Look for EUR PhD posts.", "寻找欧洲博士职位。", fine), ("Read the elements.", "阅读这些元素。", fine),
    ]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(rows)], "id int, s string, t string")
    got = {r["id"]: r["issues"] for r in translate.with_issues(df, "s", "t").collect()}
    assert {i: (rows[i][0], x) for i, x in got.items()} == {i: (s, w) for i, (s, _, w) in enumerate(rows)}


def test_translate_stage_splits_by_issues(spark):
    items = spark.createDataFrame([(1, "Good morning to you."), (2, "Bad 7.")], "id bigint, text string")
    done, repairs = translate.translate_stage(items, lambda ts: ["早上好。" if "Good" in t else "坏。" for t in ts])
    assert [r["id"] for r in done.collect()] == [1] and [r["id"] for r in repairs.collect()] == [2]


def test_variants_follow_their_rules(spark):
    texts = ["I do not know the famous station near the old harbour.", "a an the", "", None, "Cannot stop, please take part in the celebration tomorrow! " * 3, "One two.", "Lamps, tables; chairs: knives", "well-known 3 word3s here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = variants.with_variants(df)
    assert variants.violations(made, df).count() == 0
    got = {r["id"]: r["variants"] for r in made.collect()}
    assert sorted(got) == [0, 4, 5, 6, 7] and all(len(v) == 3 for v in got.values())
    assert [v["difficulty"] for v in got[0]] == ["easy", "medium", "hard"] and any(v["aliases"] for v in got[0])
    assert all(v["answer_word_count"] == 1 for v in got[6])  # no answer goes across punctuation
    broken = made.filter("id = 0")
    change = lambda **c: broken.withColumn("variants", F.transform("variants", lambda v: v.withField(*next((k, f(v)) for k, f in c.items()))))
    cases = {
        "count": broken.withColumn("variants", F.slice("variants", 1, 2)), "span": change(answer_start=lambda v: v["answer_start"] + 1), "words": change(answer_word_count=lambda v: F.lit(9)),
        "answers": broken.withColumn("variants", F.transform("variants", lambda v, i: F.col("variants")[0].withField("difficulty_score", i.cast("double")))), "scores": change(difficulty_score=lambda v: F.lit(1.0)),
    }
    for problem, rows in cases.items():
        assert [r["problem"] for r in variants.violations(rows, df).collect()] == [problem]
    assert variants.with_variants(df.limit(0)).count() == 0


def test_progress_and_streaks(spark):
    log = [(1, 1, 1, "replay"), (1, 2, 2, "correct"), (1, 3, 3, "wrong"), (2, 1, 4, "view"), (2, 2, 5, "correct"), (3, 1, 6, "replay"), (4, 1, 7, "wrong")] + [(5, i, 10 + i, "correct") for i in range(11)]
    df = spark.createDataFrame(log, "question bigint, ts int, event_id int, action string")
    first = {r["question"]: r["first_correct"] for r in G.fold(df).collect()}
    assert first == {1: True, 2: False, 3: None, 4: False, 5: True}
    assert {r["question"]: r["longest"] for r in G.longest_streaks(df).collect()} == {1: 1, 2: 1, 4: 0, 5: 11}
    assert {r["question"]: r["level"] for r in G.final_levels(df).collect()} == {1: "easy", 2: "easy", 4: "easy", 5: "hard"}
    assert G.final_levels(df.limit(0)).count() == 0
    weights = df.select("question").distinct().withColumn("weight", F.lit(1.0))
    assert G.weighted_pick(weights, 3, 1).count() == 3


def test_level_steps():
    r, state = random.Random(0), (0, 0, 0)
    for _ in range(500):
        state = G.step(*state, r.random() < 0.8)
        assert 0 <= state[0] <= 2 and 0 <= state[1] < 5 and 0 <= state[2] < 5


def test_store(spark):
    s = spark.createDataFrame([(f"s{i}", "k1" if i % 2 else "k2", i * 10) for i in range(10)], "id string, sub_scene_key string, random_key bigint")
    assert [r["id"] for r in store.circular_sample(s, seed=75, limit=4).collect()] == ["s8", "s9", "s0", "s1"]
    assert [r["id"] for r in store.circular_sample(s, seed=0, limit=9, scenes=["k1"], exclude=["s1"]).collect()] == ["s3", "s5", "s7", "s9"]
    assert [r["id"] for r in store.ordered_lookup(s, ["s3", "nope", "s1", "s3"]).collect()] == ["s3", "s1", "s3"]
    with pytest.raises(ValueError):
        store.circular_sample(s, seed=-1, limit=1)


def test_merge_and_fingerprint(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    new = spark.createDataFrame([("b", None), ("c", "4"), ("d", "5")], "k string, v string")
    got = {r["k"]: (r["action"], r["v"]) for r in stages.merge_items(old, new, ["k"], ["v"]).collect()}
    assert got == {"a": ("keep", "1"), "b": ("unchanged", None), "c": ("update", "4"), "d": ("insert", "5")}
    rows = spark.createDataFrame([(i, str(i)) for i in range(200)], "id bigint, t string")
    prints = {stages.fingerprint(rows.repartition(n), "id", ["id", "t"]).first()["digest"] for n in (1, 7)}
    assert len(prints) == 1 and stages.fingerprint(rows.filter("id <> 9"), "id", ["id", "t"]).first()["digest"] not in prints


def test_streams_resume_and_agree_with_batch(spark, tmp_path):
    rows = [(q, t, q * 100 + t, "correct" if (q * t) % 3 else "wrong") for q in range(4) for t in range(20)]
    schema = "question bigint, ts int, event_id int, action string"
    source, target, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    df = spark.createDataFrame(rows, schema)
    df.filter("ts < 10").coalesce(1).write.mode("append").parquet(source)
    micro.fold_stream(micro.arriving(spark, source, df.schema), target, offsets)
    df.filter("ts >= 10").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        micro.fold_stream(micro.arriving(spark, source, df.schema), target, offsets)
    want = {(r["question"], r["action"]): r["n"] for r in df.groupBy("question", "action").agg(F.count("*").alias("n")).collect()}
    assert {(r["question"], r["action"]): r["n"] for r in micro.folded(spark, target).collect()} == want


def test_dedupe_stream_knows_earlier_batches(spark, tmp_path):
    text = "the quick brown fox jumps over a lazy sleeping dog near the river bank every single morning"
    source, target, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    schema = "id bigint, text string, protected boolean"
    for rows in ([(1, text, False), (2, "something else entirely different here", False)], [(3, text.upper(), False), (4, "brand new words come along today", False), (5, text, True)]):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(source)
        micro.dedupe_stream(micro.arriving(spark, source, df.schema), target, offsets)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 4]


def test_recall_within_capacity(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist(), f"s{i % 2}", f"a{i % 3}" if i % 5 else "") for i in range(60)]
    pool = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, source_name string, source_author string")
    protos = spark.createDataFrame([("x", [1.0, 0.0, 0.0, 0.0])], "label string, embedding array<double>")
    got = R.within_capacity(pool, protos, 2, source_room={"s1": 9}, author_room={"a0": 1}).collect()
    chosen = [rows[x["vec_id"]] for x in got]
    assert len(chosen) == 2 and all(c[2] == "s1" for c in chosen) and sum(c[3] == "a0" for c in chosen) <= 1 and not any(c[3] in ("a1", "a2") for c in chosen)
    fit = sorted((-v[0] / np.linalg.norm(v), i) for i, v, s, a in rows if s == "s1" and a in ("", "a0"))
    best, used = [], 0
    for _, i in fit:
        if len(best) < 2 and (rows[i][3] == "" or used == 0):
            best.append(i)
            used += rows[i][3] == "a0"
    assert sorted(best) == sorted(x["vec_id"] for x in got)


def test_repairs(spark):
    drafts = spark.createDataFrame([(1, "bad", "g2", ["x"]), (2, "old", "g1", ["x"])], "id int, draft string, generation string, issues array<string>")
    items = spark.createDataFrame([(1, "He paid 7 crowns."), (2, "Old one.")], "id int, text string")
    todo = translate.open_repairs(drafts, items, spark.createDataFrame([(1, "k"), (2, "k")], "id int, scene string"), "g2")
    assert [r["id"] for r in todo.collect()] == [1]
    for answer, accepted in (("他付了7克朗。", 1), ("他付了钱。", 0)):
        done, left = translate.apply_repairs(todo, spark.createDataFrame([(1, answer, "n")], "id int, translation_zh string, review_note string"))
        assert (done.count(), left.count()) == (accepted, 1 - accepted)


def test_recall_goes_on_where_it_was_broken_off(spark, tmp_path):
    r = np.random.default_rng(5)
    pool = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(50)], "vec_id bigint, embedding array<double>")
    protos = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0])], "label string, embedding array<double>")
    folder = str(tmp_path / "recall")
    run = lambda model="m1": sorted((x["label"], x["vec_id"], x["rank"]) for x in R.recall_in_parts(pool, protos, 4, folder, model=model, part_rows=20).collect())
    want = sorted((x["label"], x["vec_id"], x["rank"]) for x in R.vector_top_k(pool, protos, 4).collect())
    assert run() == want
    shutil.rmtree(f"{folder}/part=1")
    assert run() == want
    with pytest.raises(ValueError, match="m1"):
        run("m2")
