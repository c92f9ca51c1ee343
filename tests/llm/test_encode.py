import base64
import os
import random

import pytest

from corpusloom.llm import encode

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return encode.BytePairEncoder(encode.read_ranks(f.read()))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.PIECES, mergeable_ranks=ranks, special_tokens={})


def samples():
    r = random.Random(0)
    yield from ["", " ", "\n\n  x", "<|endoftext|>", "Grolpasker's 12345 naïve café 你好，世界 🙂👍🏽", "a" * 5000, "ab" * 3000, " " * 700 + "z", "\x00\x01﻿​", "don't we'll I'M"]
    for alphabet in ("abcdefgh ", "aeiou tnsrhld'.,\n", "的一是不了在人有我他", "éüßñ£🙂 \t", "0123456789.,-_"):
        for _ in range(400):
            yield "".join(r.choice(alphabet) for _ in range(r.randrange(1, 60)))
    for _ in range(400):
        yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FFF), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(r.randrange(1, 40)))


def test_ids_equal_the_tokenizer(encoder, reference):
    for text in samples():
        ids = memoryview(encoder.encode(text)).cast("i").tolist()
        assert ids == reference.encode_ordinary(text), text[:50]


def test_every_token_has_its_parts(encoder):
    whole = [i for i, n in enumerate(encoder.length) if n > 1]
    assert all(encoder.parts[i][0] >= 0 for i in whole)


def test_forgetting_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(encode.BytePairEncoder, "MEMORY", 5)
    for text in list(samples())[:300]:
        assert memoryview(encoder.encode(text)).cast("i").tolist() == reference.encode_ordinary(text)


def test_corpus(spark, reference):
    rows = [(1, "one two", 1), (2, None, 1), (3, "", 1), (1, "one two", 1), (None, "x", 1), (5, "long " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [tuple(r) for r in encode.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted(((i, reference.encode_ordinary(t) if t else []) for i, t, _ in rows), key=str)
    assert encode.encode_corpus(df.limit(0)).collect() == []
