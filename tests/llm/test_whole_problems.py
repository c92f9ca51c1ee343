"""Queries and operators of the training-data package do the whole job, at sizes and thresholds where a cut would show."""

from corpusloom.llm import pairs, plans, quota


def test_classes_hold_all_links_of_the_problem(spark, tmp_path):
    rows = [("a", "one two three four five six seven eight"), ("b", "one two three four five six seven nine"), ("c", "nothing like these at all")]  # a and b: 7 of 9 words
    spark.createDataFrame(rows, "id string, text string").write.parquet(f"{tmp_path}/sentences.parquet")
    got = {r["id"]: (r["class_id"], r["links"]) for r in plans.QUERIES["p4_classes"](spark, str(tmp_path)).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("c", 0)}
    assert plans.QUERIES["p4_found"](spark, str(tmp_path)).count() == 1


def test_endings_beyond_the_broadcast_are_known_too(spark, monkeypatch):
    prompt = "Somebody told us something there."
    ends = ["集市今天很早就关门", "渡船明天下午才离开", "图书馆里没有人说话", "面包刀放在桌子上面"]
    rows = [(prompt, f"{e}。") for n, e in zip((60, 60, 2, 1), ends) for _ in range(n)]
    rows = [(f"sound{i}", *r) for i, r in enumerate(rows)]
    rows += [*((f"whole{i}", prompt, e) for i, e in enumerate(ends[:3])), ("cut", prompt, ends[2][:-2]), ("cut", prompt, ends[2][:-2]), ("once", prompt, ends[3]), ("nothing", prompt, None)]
    df = spark.createDataFrame(rows, "id string, text string, translation_zh string").repartition(3)
    want = sorted([("cut", "truncated"), ("cut", "truncated"), ("nothing", "empty"), ("once", "truncated")])
    for most in (200_000, 2):
        monkeypatch.setattr(pairs, "MOST_ENDINGS", most)
        assert sorted(tuple(r) for r in pairs.broken_pairs(df).collect()) == want, most


def test_every_number_of_name_parts_has_its_usual_shape(spark):
    names = ["兰" * a + "·" + "兰" * b for a in range(1, 12) for b in range(1, 12) for _ in range(2)] + ["兰·兰·兰"]
    endings = pairs.Endings("兰")
    rows = [(*endings.of(f"{x}。")[:4], 1) for x in names]
    df = spark.createDataFrame(rows, "_before string, _arity string, _shape string, _after string, _n bigint")
    assert {r["_arity"]: r["_usual"] for r in pairs.usual_shapes(df).collect()} == {"2": "N1.1", "3": "N1.1.1"}


def test_flow_over_one_cell_a_category_decomposes():
    targets, floors, have = [5, 2, 9, 4], [2, 2, 2, 2], [7, 0, 3, 4]
    cells = [(c, 0, n) for c, n in enumerate(have)]
    assert quota.cell_quotas(targets, floors, cells, [20])[:2] == ([5, 0, 3, 4], [0, 2, 6, 0])
