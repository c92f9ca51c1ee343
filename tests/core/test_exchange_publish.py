import json

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import exchange as X
from corpusloom.operators import publish as B
from corpusloom.operators import review, stages


@pytest.mark.parametrize("bad,problem", [('{"a": 1, "a": 2, "b": "x"}', "repeated key|no JSON object"), ('{"a": 1}', "other fields"), ('{"a": 1, "b": "x", "c": 2}', "other fields"), ("[1]", "no JSON object"), ('{"a": "q", "b": "x"}', "bad a"), ("{a", "no JSON object")])
def test_strict_json(spark, tmp_path, bad, problem):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1, "b": "x"}\n\n{"b": null, "a": 2}\n')
    assert [tuple(r) for r in X.read_strict(spark, path, {"a": "int", "b": "string"}).collect()] == [(1, "x"), (2, None)]
    with open(path, "a") as f:
        f.write(bad + "\n")
    with pytest.raises(Exception, match=problem):
        X.read_strict(spark, path, {"a": "int", "b": "string"}).collect()


def test_chunks_are_bounded(spark):
    rows = spark.createDataFrame([("f", i, "x" * 40) for i in range(50)] + [("g", 1, "")], "family string, id int, text string")
    got = X.chunks(rows, "family", "id", "text", most_rows=8, most_bytes=200).groupBy("family", "chunk").agg(F.count("*").alias("n"), F.sum(F.length("text") + 1).alias("b")).collect()
    assert all(r["n"] <= 8 and r["b"] <= 241 for r in got) and sum(r["n"] for r in got) == 51
    assert sorted(r["chunk"] for r in got if r["family"] == "f") == list(range(sum(r["family"] == "f" for r in got)))


def test_store_round_trip(spark):
    items = spark.createDataFrame([(1, "I do not know the famous station near the old harbour."), (2, "Go up."), (3, "The committee could not find a better solution yesterday.")], "id int, text string")
    selected = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, scene string")
    translated = spark.createDataFrame([(1, "x"), (2, "y")], "id int, translation_zh string")
    rows = B.rows_to_publish(items, selected, translated, spark.createDataFrame([], "item_id int"))
    assert {r["id"]: r["complete"] for r in rows.collect()} == {1: True, 2: True, 3: False}
    tables = B.question_store(B.allocate_ids(rows))
    assert tables["sentences"].count() == 2 and tables["question_variants"].count() == 6
    ids = sorted(r["id"] for r in tables["question_variants"].collect())
    got = B.lookup(tables, [ids[3], "none", ids[0], ids[3]]).collect()
    assert [r["id"] for r in got] == [ids[3], ids[0], ids[3]]
    base = spark.createDataFrame([(9, "GO up.")], "id int, text string")
    assert sorted(r["id"] for r in B.extend(base, items.withColumn("protected", F.lit(False)), most=5).collect()) == [1, 3]


def test_curation_skips_near_duplicates(spark):
    text = "the quick brown fox jumps over a lazy sleeping dog near the river bank every single morning."
    rows = spark.createDataFrame([("c", 1, text), ("c", 2, text.upper()), ("c", 3, "A completely different sentence about trains."), ("d", 4, "One more about boats and the sea.")], "category string, id int, text string")
    got = B.curate(rows, quota=2).collect()
    assert len(got) == 3 and len({r["id"] for r in got} & {1, 2}) == 1


def test_command_line(spark, tmp_path, capsys):
    items = spark.createDataFrame([(1, "I do not know the famous station near the old harbour.", False), (2, "short", False)], "id bigint, text string, protected boolean")
    items.write.parquet(str(tmp_path / "in"))
    assert cli.main(["clean", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1
    assert cli.main(["dedupe", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "d")], spark) == 0
    assert cli.main(["variants", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "v")], spark) == 0
    assert cli.main(["queries"], spark) == 0 and "quality_gate" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["recall", "--input", "x", "--prototypes", "y", "--output", "z", "--top-k", "501"], spark)


def test_versions_checkpoints_and_review(spark):
    items = spark.range(6)
    own = spark.createDataFrame([(1, "v1", "keyword"), (2, "v2", "keyword"), (3, "v1", "source_explicit"), (4, None, None)], "id bigint, version string, method string")
    gone = spark.createDataFrame([(5,)], "item_id bigint")
    ask = lambda **k: sorted(r["id"] for r in stages.pending(items, None, own, gone, **k).collect())
    assert ask() == [0] and ask(version="v2", authoritative=("source_explicit",)) == [0, 1, 4] and ask(version="v2") == [0, 1, 3, 4]
    done = lambda *rows: spark.createDataFrame(list(rows), "item_id bigint, value string")
    lost = lambda *rows: spark.createDataFrame(list(rows), "item_id bigint, stage string, reason string")
    eligible = spark.createDataFrame([(1,), (2,), (3,)], "item_id bigint")
    stage, rejections = stages.checkpointed(done((1, "old"), (9, "kept")), done((1, "new"), (2, "new")), lost((8, "s", "x")), lost((3, "s", "y")), eligible)
    assert sorted(map(tuple, stage.collect())) == [(1, "new"), (2, "new"), (9, "kept")] and sorted(r["item_id"] for r in rejections.collect()) == [3, 8]
    for results, rejected in ((done((7, "x")), lost()), (done((1, "x")), lost((1, "s", "y")))):
        with pytest.raises(ValueError, match="may not write"):
            stages.checkpointed(done(), results, lost(), rejected, eligible)
    classified = spark.createDataFrame([(1, None, "none"), (2, "a", "source")], "id bigint, scene string, method string")
    outcomes = spark.createDataFrame([(1, "b", "applied"), (2, "c", "conflict"), (None, "c", "unmatched")], "id bigint, scene string, outcome string")
    later = {"translate": done((1, "x"), (2, "y"))}
    after, left = review.apply_decisions(classified, outcomes, later)
    assert sorted(map(tuple, after.collect())) == [(1, "b", "review"), (2, "a", "source")] and [r["item_id"] for r in left["translate"].collect()] == [2]


def test_json_fields_keep_types_and_nulls(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null, "c": [1, {"x": "y"}]}',), (None,), ("{}",)], "p string")
    got = [r[0] for r in df.select(stages.set_json_fields(F.col("p"), F.struct(F.lit("m").alias("method"), F.lit(2).alias("a")))).collect()]
    assert [g and json.loads(g) for g in got] == [{"b": None, "c": [1, {"x": "y"}], "method": "m", "a": 2}, None, {"method": "m", "a": 2}]


def test_curation_gates_and_needs_variants(spark):
    good = [f"The {a} station stands near the {b} harbour today." for a in ("famous", "quiet") for b in ("northern", "southern", "eastern")]
    rows = [("b", i, t) for i, t in enumerate(good)] + [("a", 10 + i, t) for i, t in enumerate(good[:2])] + [("a", 20, "No."), ("b", 21, "unfinished sentence without an end mark here"), ("b", 22, good[0])]
    got = B.curate(spark.createDataFrame(rows, "category string, id bigint, text string"), quota=2).collect()
    assert all(r["id"] < 20 for r in got) and len({r["text"] for r in got}) == len(got) and {r["category"] for r in got} <= {"a", "b"}
    hashes = {c: [r["hash"] for r in sorted(got, key=lambda r: r["place"]) if r["category"] == c] for c in "ab"}
    assert all(h == sorted(h) for h in hashes.values()) and hashes["a"]


def test_decisions_make_the_round_trip(spark, tmp_path):
    requests = spark.createDataFrame([(i, f"text {i}", "fam" if i < 3 else "other") for i in range(5)], "item_id bigint, text string, kind string")
    written = X.export_requests(requests, str(tmp_path / "out"), family="kind", most_rows=2)
    assert sorted((r["family"], r["chunk"], r["item_id"]) for r in written.collect()) == [("fam", 0, 0), ("fam", 0, 1), ("fam", 1, 2), ("other", 0, 3), ("other", 0, 4)]
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["item_id"], r["text"]) for r in back.collect()) == [(i, f"text {i}") for i in range(5)]
    scenes = spark.createDataFrame([("a", "top")], "scene_key string, top_key string")
    answer = lambda i, top="top", sub="a", why="fits": {"item_id": i, "top_scene": top, "sub_scene": sub, "reason": why}

    def read(rows):
        path = tmp_path / f"in{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        return X.import_decisions(spark, str(path), requests, scenes)

    whole = [answer(0), *(answer(i, None, None) for i in range(1, 5))]
    assert read(whole).count() == 5
    for bad, problem in ((whole[:4], "4: missing"), ([*whole, answer(9)], "9: unexpected"), ([*whole, answer(1)], "1: repeated"), ([answer(0, "top", "b"), *whole[1:]], "0: unknown scene"), ([answer(0, None, "a"), *whole[1:]], "0: half a scene"), ([answer(0, why=" "), *whole[1:]], "0: no reason")):
        with pytest.raises(ValueError, match=problem):
            read(bad)
