"""Every registered query over tables that are empty, and over tables with nulls, repeated rows and further columns."""

import pytest

from corpusloom.llm import plans

SCHEMAS = {
    "candidates": "run_id bigint, id bigint, text string, source_name string, source_author string, top_scene string, sub_scene string, confidence double, protected boolean, tie_hash string, recalled_at timestamp_ntz",
    "sub_scenes": "scene_key string, top_key string, label string, quota int, sort_order int",
    "sentences": "id string, text string, translation_zh string, sub_scene_key string, source_name string, normalized_hash string, random_key bigint",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, collected_at timestamp_ntz",
    "benchmark": "item_id bigint, text string",
}
ROWS = {
    "candidates": [
        (1, 1, "a", "S", "by A", "top", "Scene-One", 0.5, None, "x", None), (1, 1, "a", "s ", "A", "TOP", "scene_one", 0.5, None, "x", None), (1, 2, None, None, None, None, None, None, None, None, None),
        (1, 3, "b", "S", "\\N", "top", "第一", float("nan"), True, None, None), (None, 4, None, None, None, None, None, 1.0, None, None, None), (1, None, None, None, None, None, None, 1.0, None, None, None),
    ],
    "sub_scenes": [("scene_one", "top", "第一", 5, 1), ("gone", "top", "旧", None, 2), (None, None, None, None, None)],
    "sentences": [("s1", "One two three.", "一二三。", "k", None, None, None), ("s2", "one TWO three", None, None, None, None, None), ("s2", "one TWO three", None, None, None, None, None), (None, "x", "x", None, None, None, None)],
    "documents": [(1, "One two three four five six seven eight nine.", None, None, None, None, None), (2, None, None, "s", None, None, None), (2, None, None, "s", None, None, None), (None, "", None, None, None, None, None), (3, "long " * 5000, None, "s", None, None, None)],
    "benchmark": [(7, "zero one two three four five six seven eight"), (8, None), (None, "one two three four five six seven eight nine ten"), (9, "short")],
}


def tables(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema).selectExpr("*", "1 as _id", "'x' as _set", "2.0 as _cap", "'y' as _group")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {"empty": tables(spark, tmp_path_factory.mktemp("empty"), {}), "odd": tables(spark, tmp_path_factory.mktemp("odd"), ROWS)}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(spark, folders, name):
    assert plans.QUERIES[name](spark, folders["empty"]).collect() == []


def test_odd_tables(spark, folders):
    got = {name: sorted((tuple(r) for r in q(spark, folders["odd"]).collect()), key=str) for name, q in plans.QUERIES.items()}
    assert got["p1_found"] == [(1, 3)]  # one row a source: the second row of "S" goes, rows without a source are their own
    assert got["p2_found"] == [(1, 1), (1, 3)]
    assert got["p3_found"] == []
    assert len(got["p3_sample"]) == 2
    assert got["p4_found"] == [("s1", "s2")]
    assert got["p5_found"].count(("s2", "empty")) == 2
    assert [r[0] for r in got["p6_ids"] if r[1] == []] == [2, 2, None]
    assert got["p7_found"] == [(1, 7)]
    assert len(got["p8_rates"]) == 2
