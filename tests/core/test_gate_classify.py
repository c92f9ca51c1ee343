import pytest

from corpusloom.operators import classify as C
from corpusloom.operators import gate

CASES = [
    ("00:00:01,000 --> 00:00:03,000", "subtitle_metadata"),
    ("[door closes]", "stage_direction"),
    ("(laughs quietly)", "stage_direction"),
    ("SPEAKER 2: I would like to go home now.", "speaker_label"),
    ("Too few words.", "too_short"),
    ("word " * 36 + ".", "too_long"),
    ("This sentence has no final mark", "incomplete"),
    ("They wanted to attack the old town.", "sensitive"),
    ('She said "hello and left the room.', "unbalanced_quotes"),
    ("This is the first one. This is the second one.", "multiple_sentences"),
    ("Dr. Smith went home after the long meeting.", None),
    ("Call 5551234 5551234 5551234 at a b c d e.", "mostly_numeric"),
    ("no no no no no yes yes.", "low_quality"),
    ("<b>Please</b>&nbsp;close the “old” door.", None),
    (None, None),
]


def test_gate_reasons(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r["id"]: r["reason"] for r in gate.with_rejection_reason(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_protected_items_pass(spark):
    df = spark.createDataFrame([(1, "short", True), (2, "short", False), (3, "short", None)], "id int, text string, protected boolean")
    accepted, rejected = gate.clean_stage(df)
    assert [r["id"] for r in accepted.collect()] == [1] and sorted(r["id"] for r in rejected.collect()) == [2, 3]


LEX = {"food": {"keyword": ["bread", "berries"], "phrase": ["bread knife"], "context": ["eat", "cook"], "single": ["soup"], "blocked": ["alphabet soup"]}, "road": {"keyword": ["tram", "bus"], "context": ["drive", "walk"], "single": ["taxi"]}}
TEXTS = [
    ("The bread knife is here", None, None, False, "s", ("food", "keyword")),
    ("A berry and some bread", None, None, False, "s", ("food", "keyword")),
    ("bread tram", None, None, False, "s", (None, "out_of_candidate_pool")),
    ("we eat and cook", None, None, False, "s", ("food", "context_keywords")),
    ("we eat and cook, drive and walk", None, None, False, "s", (None, "out_of_candidate_pool")),
    ("hot soup", None, None, False, "s", ("food", "single_keyword_whitelist")),
    ("hot alphabet soup", None, None, False, "s", (None, "out_of_candidate_pool")),
    ("soup in the tram", None, None, False, "s", (None, "out_of_candidate_pool")),
    ("soup", None, None, True, "s", (None, "llm_required")),
    ("nothing", "road", "road_top", False, "s", ("road", "source_explicit")),
    ("nothing", "road", "other", False, "s", (None, "out_of_candidate_pool")),
    ("nothing", None, None, False, "wire", ("road", "candidate_source")),
    ("", None, None, None, None, (None, "out_of_candidate_pool")),
]


@pytest.mark.parametrize("partitions", [1, 4])
def test_candidate_classes(spark, partitions):
    rows = [(i, t, s, top, p, src) for i, (t, s, top, p, src, _) in enumerate(TEXTS)]
    items = spark.createDataFrame(rows, "id int, text string, sub_scene string, top_scene string, protected boolean, source_name string").repartition(partitions)
    scenes = spark.createDataFrame([("food", "food_top"), ("road", "road_top")], "scene_key string, top_key string")
    got = C.classify_candidates(items, C.lexicon(spark, LEX), scenes, source_scenes={"wire": "road"}).collect()
    assert {r["id"]: (r["scene"], r["method"]) for r in got} == {i: x[-1] for i, x in enumerate(TEXTS)}
