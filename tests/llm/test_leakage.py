import random

import pytest

from corpusloom.functions.pytext import words
from corpusloom.llm import leakage

ITEMS = [
    (1, "Mira Holt paid 40 crowns for the old lamp in Varno. Nobody at the market knew why she left."),
    (2, "The lesson about rivers repeats each word twice, so take your time and listen."),
    (3, None),
    (4, "Who locked the gate?"),
    (5, "Mira Holt paid 40 crowns for the old lamp in Varno, said the clerk."),
]


def brute(docs, items, k):
    out = set()
    for d, t in docs:
        own = words(t)
        runs = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i, x in items:
            ws = words(x)
            if d is not None and any(tuple(ws[j : j + k]) in runs for j in range(len(ws) - k + 1)):
                out.add((d, i))
    return out


def documents():
    r = random.Random(3)
    pool = sorted({w for _, t in ITEMS for w in words(t)}) + ["zebra", "quill"]
    docs = []
    for i in range(120):
        ws = [r.choice(pool) for _ in range(r.randrange(0, 40))]
        if i % 3 == 0:
            src = words(ITEMS[r.choice([0, 1, 4])][1])
            a, n = r.randrange(len(src)), r.randrange(5, 12)
            ws[len(ws) // 2 : len(ws) // 2] = src[a : a + n]
        docs.append((i, " ".join(r.choice([w, w.upper(), f"<b>{w}</b>", w + ","]) for w in ws)))
    docs += [(500, None), (501, ""), (502, "x " * 30000 + "LESSON about&nbsp;rivers re​peats each word twice so"), (None, ITEMS[0][1]), (503, ITEMS[4][1]), (503, ITEMS[4][1])]
    docs += [(504, "Bela Kern paid 77 crowns for the old lamp in Ostrow. Nobody at the market knew why she left.")]
    return docs


@pytest.mark.parametrize("characters", [16_000_000, 10])
def test_windows_equal_brute_force(spark, monkeypatch, characters):
    monkeypatch.setattr(leakage, "INDEX_CHARACTERS", characters)
    docs = documents()
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id bigint, text string, item_id int").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for k in (3, 8):
        got = leakage.leaks(df.select("doc_id", "text"), items, size=k).collect()
        assert {tuple(r) for r in got} == brute(docs, ITEMS, k)
    assert sum(r["doc_id"] == 503 for r in leakage.leaks(df, items).collect()) == 2 * sum(d == 503 for d, _ in brute(docs, ITEMS, 8))
    assert leakage.leaks(df.limit(0), items).count() == leakage.leaks(df, items.limit(0)).count() == 0


@pytest.mark.parametrize("characters", [16_000_000, 10])
def test_renamed_items_are_found(spark, monkeypatch, characters):
    monkeypatch.setattr(leakage, "INDEX_CHARACTERS", characters)
    df = spark.createDataFrame(documents(), "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    exact = {tuple(r) for r in leakage.leaks(df, items, size=14).collect()}
    renamed = {tuple(r) for r in leakage.leaks(df, items, size=14, renamed=True).collect()}
    assert (504, 1) in renamed - exact and exact <= renamed


def planted(seed=11):
    """Items of names and numbers, documents that hold them under consistent or inconsistent renamings, and the truth."""
    r = random.Random(seed)
    name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize()
    forms = [
        "the clerk wrote that {0} {1} owed {5} crowns to {2} {3} until {0} {1} came back to {4} with the lamp",
        "before noon {0} {1} carried {5} baskets from {4} to the mill where {2} {3} counted all {5} of them twice",
        "it is said that {2} {3} owed the ferryman {5} until {2} left for {4} with {0} {1} in the dark",
    ]
    values = lambda: [*(name() for _ in range(5)), r.randrange(2, 9999)]
    items, docs, truth = [], [], set()
    for i in range(30):
        own = values()
        items.append((i, f"Note: {forms[i % 3].format(*own)}. {name()} agreed."))
        for j in range(4):
            other, d = values(), i * 10 + j
            text = forms[i % 3].format(*other)
            if j == 3:  # one name is not renamed alike everywhere
                key = other[0] if i % 3 == 0 else str(other[5]) if i % 3 == 1 else other[2]
                text = text.replace(key, name() if i % 3 != 1 else "10000", 1)
            docs.append((d, f"{name()} said: {text}, and that was all."))
            if j < 3:
                truth |= {(d, k) for k in range(i % 3, 30, 3)}
    return docs, items, truth


@pytest.mark.parametrize("characters", [16_000_000, 10])
def test_planted_renamings_are_found_whole(spark, monkeypatch, characters):
    monkeypatch.setattr(leakage, "INDEX_CHARACTERS", characters)
    docs, items, truth = planted()
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), size=19, renamed=True)
    assert {tuple(r) for r in got.collect()} == truth  # recall 1, and no inconsistent renaming


def test_names_are_the_same_however_the_items_are_parted(spark, monkeypatch):
    """A name of one item that is a common word in another is a word for both, in an index as in a shuffled join."""
    items = [(1, "then Rose took the long road to the old mill and Rose sang there"), (2, "the rose was red and the road was long and dusty")]
    docs = [(1, "then Anna took the long road to the old mill and Anna sang there"), (2, "then Rose took the long road to the old mill and Rose sang there")]
    made = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for characters in (16_000_000, 10):
        monkeypatch.setattr(leakage, "INDEX_CHARACTERS", characters)
        assert sorted(map(tuple, leakage.leaks(*made, size=12, renamed=True).collect())) == [(2, 1)]
        assert sorted(map(tuple, leakage.leaks(made[0], made[1].filter("item_id = 1"), size=12, renamed=True).collect())) == [(1, 1), (2, 1)]


def test_slots_must_be_consistent(spark):
    items = [(1, "so Ann met Bob and then Ann saw Bob again")]
    literal = leakage.literal_words(spark, spark.createDataFrame(items, "_item bigint, _text string"))
    index = leakage.WindowIndex(leakage.Templates(literal, 8, True), items)
    ask = lambda t: index.found([words(t)])
    assert ask("so Kim met Lou and then Kim saw Lou again")
    assert not ask("so Kim met Lou and then Lou saw Kim again")
    assert not ask("so Kim met Kim and then Kim saw Kim again")
