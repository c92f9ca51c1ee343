"""Queries do the whole job, at sizes where a cut would show."""

import numpy as np

from corpusloom.operators import recall as R
from corpusloom.plans import registry


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_selection_fills_the_whole_quota(spark, tmp_path):
    d = str(tmp_path)
    save(spark, d, "sub_scenes", [("tram", "ride", 150)], "scene_key string, top_key string, quota int")
    rows = [(1, i, f"source{i % 4}", None, "ride", "tram", 1 - i / 1000, i >= 192, f"{i:03d}") for i in range(200)]
    save(spark, d, "candidates", rows, "run_id bigint, id bigint, source_name string, source_author string, top_scene string, sub_scene string, confidence double, protected boolean, tie_hash string")
    run = {n: registry.QUERIES[n](spark, d).collect() for n in ("selection_candidates_bounded", "selection_kernel", "selection_flow", "selection_flow_violations", "protected_conflicts")}
    assert len(run["selection_candidates_bounded"]) == len(run["selection_kernel"]) == 200
    assert {r["id"] for r in run["selection_flow"]} == {*range(142), *range(192, 200)}  # no source reaches its limit of 67
    assert [r["broken"] for r in run["selection_flow_violations"]] == [0, 0, 0]
    assert run["protected_conflicts"] == []  # 8 protected rows are far within the quota


def test_review_coverage_asks_for_the_items_of_all_runs(spark, tmp_path):
    d = str(tmp_path)
    save(spark, d, "candidates", [(1, 1), (1003, 2), (1004, 3), (1550, 4), (1550, 1)], "run_id bigint, id bigint")
    save(spark, d, "rejections", [(1,), (3,), (5,)], "item_id bigint")
    got = {tuple(r) for r in registry.QUERIES["review_coverage"](spark, d).collect()}
    assert got == {(2, "missing"), (4, "missing"), (5, "unexpected")}


def test_token_ranges_reach_all_positions(spark, tmp_path):
    d = str(tmp_path)
    save(spark, d, "raw_items", [(i,) for i in range(14_000)], "id bigint")
    docs = list(range(0, 1400, 3))
    save(spark, d, "documents", [(i,) for i in docs], "doc_id bigint")
    got = {r["segment_id"]: r["text"] for r in registry.QUERIES["token_ranges"](spark, d).collect()}
    want = {}
    for i in docs:
        first = i * 13 % 2000  # each of the seven meetings has 2,000 positions
        ids = [7 * pos + i % 7 for pos in range(first, min(first + i % 40, 1999) + 1)]
        want[i] = "".join(str(x) if x % 5 == 0 else f" {x}" for x in ids).strip()
    assert got == want
    assert max(int(w) for t in got.values() for w in t.split() if len(w) < 6) > 13_000  # the last positions too


def test_prototypes_of_one_label_may_be_many(spark, monkeypatch):
    r = np.random.default_rng(3)
    pool = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(60)], "vec_id bigint, embedding array<float>")
    prototypes = spark.createDataFrame([("many" if i < 20 else "few", r.normal(size=4).tolist()) for i in range(23)] + [("many", [1.0, 0.0, 0.0, 0.0])] * 5, "label string, embedding array<float>")
    exclude = spark.createDataFrame([("many", 5), ("few", 7)], "label string, vec_id bigint")
    whole, blocks = [], []
    for most, got in ((20_000, whole), (8, blocks)):
        monkeypatch.setattr(R, "MAX_PROTOTYPES", most)
        got += sorted((x["label"], x["rank"], x["vec_id"], round(x["similarity"], 9)) for x in R.vector_top_k(pool, prototypes, 6, exclude=exclude).collect())
    assert len(whole) == 12 and blocks == whole


def test_documents_of_any_language_are_split(spark, tmp_path):
    d = str(tmp_path)
    langs = ["en", " en", "en-XX", "eng", "EN", None, "fr"]
    save(spark, d, "documents", [(i, "Dr. Low came. It rained.", x) for i, x in enumerate(langs)] + [(9, None, None)], "doc_id bigint, text string, lang string")
    split = registry.QUERIES["sentence_split"](spark, d).groupBy("doc_id").count().collect()
    assert sorted(r["doc_id"] for r in split) == list(range(7)) and len({r["count"] for r in split}) == 1
    safe = {r["doc_id"]: r["sentences"] for r in registry.QUERIES["abbrev_safe_split"](spark, d).collect()}
    assert set(safe) == {*range(7), 9} and all(safe[i] == ["Dr. Low came.", "It rained."] for i in range(7))
