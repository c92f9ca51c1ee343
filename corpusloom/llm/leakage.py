"""Evaluation texts leaking into training text, found by templates of word windows.

Every word is canonicalised: numbers, units and names become typed placeholders, the other words of the test material
stay as they are. A window of words thus has a template (its canonical words) and slots (what the placeholders stand
for). Windows of all documents are hash-joined with those of the test items by template, and the slots of those that match
are then checked by a signature: equal slots mean that the very words are there; for re-parameterised items the signature
is the pattern in which slots repeat, so that it is equal if and only if one renaming, one to one, turns the item's slots
into the document's.

The test items' windows are held by every task as one index if they fit it. More are joined by shuffle, on template and
signature, after a bitmap of fixed size over all templates has kept back the windows that cannot match. What counts as a name is
decided over all items together in both cases, so the result is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.pytext import fold, words

#: Characters of test material that the index of a task may hold.
INDEX_CHARACTERS = 16_000_000
#: Different words of test material, kept as 64-bit hashes, that tell names from other words.
VOCABULARY = 8_000_000
#: Bits of the bitmap of templates (16 MB).
BITMAP = 1 << 27
#: Texts taken together in one vectorised step.
STEP = 500

NUMBER, UNIT, NAME = "\0number", "\0unit", "\0name"
#: Units of measure, money and time.
UNITS = frozenset("kg g mg km m cm mm mi ft inch inches lb lbs oz l ml percent euro euros dollar dollars pound pounds crowns crown usd eur gbp hours hour minutes minute seconds second days day weeks week years year points point".split())
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？:])\s+|\n")


def _hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def word_uses(text: str) -> tuple[set[str], set[str], set[str]]:
    """Words of a text that stand in lower case, with a capital inside a sentence, and first in a sentence."""
    lower, upper, first = set(), set(), set()
    for sentence in _SENTENCE.split(text):
        for i, w in enumerate(_WORD.findall(re.sub(r"['’]", "", sentence))):
            (lower if not w[:1].isupper() else upper if i else first).add(fold(w))
    return lower, upper, first


def literal_words(spark: SparkSession, items: DataFrame) -> np.ndarray:
    """Sorted hashes of the words of all items that are no names: written in lower case somewhere, or with a capital only
    at the start of sentences. The distinct words are aggregated first; more than VOCABULARY of them are an error."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uses: dict[int, int] = {}
            for text in b["_text"].to_pylist():
                for flag, ws in zip((1, 2, 4), word_uses(text)):
                    for w in ws:
                        h = _hash(w)
                        uses[h] = uses.get(h, 0) | flag
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(uses), dtype=np.uint64).view(np.int64)), pa.array(list(uses.values()), pa.int32())], ["w", "use"])

    uses = items.select("_text").mapInArrow(task, "w bigint, use int").groupBy("w").agg(F.bit_or("use").alias("use"))
    known = uses.filter((F.col("use").bitwiseAND(1) > 0) | (F.col("use") == 4)).select("w").limit(VOCABULARY + 1).toArrow()["w"].to_numpy()
    if len(known) > VOCABULARY:
        raise ValueError(f"test material of more than {VOCABULARY} different words")
    return np.sort(known.view(np.uint64))


class Templates:
    """Windows of ``size`` words as (template, signature) of 64 bits each."""

    def __init__(self, literal: np.ndarray, size: int, renamed: bool):
        self.literal, self.size, self.renamed = literal, size, renamed
        self.known: dict[str, tuple[int, int]] = {}

    def canonical(self, w: str) -> str:
        if w.isdigit() or w.isnumeric():
            return NUMBER
        if w in UNITS:
            return UNIT
        h = np.uint64(_hash(w))
        at = np.searchsorted(self.literal, h)
        return w if at < len(self.literal) and self.literal[at] == h else NAME

    def _code(self, w: str) -> tuple[int, int]:
        c = self.known.get(w)
        if c is None:
            if len(self.known) > 500_000:
                self.known.clear()
            kind = self.canonical(w)
            c = self.known[w] = (_hash(kind), _hash(w) if kind[0] == "\0" else 0)
        return c

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template of every window, its first word's place among all words, slot code of every word)."""
        lengths = [len(ws) for ws in texts]
        n, k = sum(lengths), self.size
        if n < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        code = self._code
        codes = np.array([code(w) for ws in texts for w in ws], dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        start = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h = h * _MULTIPLIER + codes[j : n - k + 1 + j, 0]
        h = h[start]
        return h ^ (h >> np.uint64(29)), start, codes[:, 1]

    def signatures(self, slots: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What must be equal, besides the template, of the windows that begin at ``start``."""
        window = slots[start[:, None] + np.arange(self.size)]
        if self.renamed:  # the place, from 1, at which each slot first occurs; 0 for literal words
            first = np.zeros(window.shape, dtype=np.uint64)
            for i in range(0, len(window), 4_096):
                part = window[i : i + 4_096]
                first[i : i + 4_096] = (part[:, :, None] == part[:, None, :]).argmax(axis=2) + 1
            window = np.where(window == 0, np.uint64(0), first)
        h = np.zeros(len(window), dtype=np.uint64)
        for j in range(self.size):
            h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER + window[:, j]
        return h


class WindowIndex:
    """All windows of some items, by template and signature."""

    def __init__(self, templates: Templates, items: list[tuple]):
        self.of, self.ids = templates, [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        template, start, slots = templates.windows(self.words)
        signature = templates.signatures(slots, start)
        self.templates = np.unique(template)
        self.flat = [w for ws in self.words for w in ws]
        owner = np.repeat(np.arange(len(items)), [len(ws) for ws in self.words])
        self.at: dict[tuple[int, int], list[tuple[int, int]]] = {}  # first window of every item with a key
        for key, s in zip(zip(template.tolist(), signature.tolist()), start.tolist()):
            held = self.at.setdefault(key, [])
            if not held or held[-1][0] != owner[s]:
                held.append((int(owner[s]), s))

    def found(self, texts: list[list[str]]) -> set[tuple[int, int]]:
        """(number of the text, number of the item) of all windows whose templates match and whose slots pass."""
        template, start, slots = self.of.windows(texts)
        out: set[tuple[int, int]] = set()
        if not (len(template) and len(self.templates)):
            return out
        at = np.minimum(np.searchsorted(self.templates, template), len(self.templates) - 1)
        hit = np.flatnonzero(self.templates[at] == template)
        if not len(hit):
            return out
        signature = self.of.signatures(slots, start[hit]).tolist()
        ends = np.cumsum([len(ws) for ws in texts])
        doc = np.searchsorted(ends, start[hit], side="right").tolist()
        k = self.of.size
        for d, s, key in zip(doc, start[hit].tolist(), zip(template[hit].tolist(), signature)):
            own = None
            for item, first in self.at.get(key, ()):
                if (d, item) not in out:
                    if own is None:
                        begin = s - int(ends[d - 1] if d else 0)
                        own = texts[d][begin : begin + k]
                    if self._same(own, self.flat[first : first + k]):
                        out.add((d, item))
        return out

    def _same(self, a: list[str], b: list[str]) -> bool:
        """Whether the words are equal or, where renaming is allowed, one renaming of slots turns b into a."""
        if a == b or not self.of.renamed:
            return a == b
        kinds = list(map(self.of.canonical, a))
        if kinds != list(map(self.of.canonical, b)):
            return False
        pairs = {(x, y) for x, y, kind in zip(a, b, kinds) if kind[0] == "\0"}
        return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def _window_rows(templates: Templates, ident: str, kind: str, bitmap: np.ndarray | None):
    """Task: (_template, _signature, ident) of the windows of each text, once each; with a bitmap only of those it has."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, STEP) for i in range(0, b.num_rows, STEP)):
                texts = [words(t) for t in part["_text"].to_pylist()]
                template, start, slots = templates.windows(texts)
                if bitmap is not None:
                    bit = (template % np.uint64(BITMAP)).astype(np.int64)
                    passed = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    template, start = template[passed], start[passed]
                signature = templates.signatures(slots, start)
                owner = np.searchsorted(np.cumsum([len(ws) for ws in texts]), start, side="right")
                keys = [pa.array(x.view(np.int64)) for x in (template, signature)]
                yield pa.RecordBatch.from_arrays([*keys, part[ident].take(pa.array(owner, pa.int64()))], ["_template", "_signature", ident])

    return task, f"_template bigint, _signature bigint, {ident} {kind}"


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all templates, from at most 4,096 buckets of 4 KB, aggregated before they come to the driver."""
    bit = F.pmod(F.col("_template").cast("decimal(20,0)"), F.lit(BITMAP)).cast("bigint")  # as of the unsigned number: BITMAP divides 2^64
    parts = windows.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 32768 as int)").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in parts.collect():
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def leaks(
    documents: DataFrame, items: DataFrame, *, size: int = 8, renamed: bool = False, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id): documents with at least ``size`` consecutive words of a test item, in order and without a gap.

    With ``renamed``, also those whose window is the item's under a one-to-one renaming of numbers, units and names; a
    larger size is advised then. Defined results: null texts, items of fewer than ``size`` words and null identifiers
    match nothing; a pair comes once for each row that holds it, however many windows match; very long texts are searched whole; an empty
    table gives no rows. Other columns play no part. Test material beyond INDEX_CHARACTERS is joined by shuffle instead of
    an index, by two 64-bit hashes of each window.
    """
    spark = documents.sparkSession
    doc_kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    read = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).dropna().dropDuplicates()
    docs = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).dropna()
    about = read.agg(F.sum(F.length("_text"))).first()[0] or 0
    templates = Templates(literal_words(spark, read), size, renamed)

    if about > INDEX_CHARACTERS:
        theirs, schema = _window_rows(templates, "_item", item_kind, None)
        theirs = read.mapInArrow(theirs, schema).distinct()
        shared = spark.sparkContext.broadcast(_bitmap(theirs))

        def ours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _window_rows(templates, "_row", "", shared.value)[0](batches)

        own = docs.withColumn("_row", F.struct("_doc", F.monotonically_increasing_id().alias("_at"))).select("_row", "_text")
        own = own.mapInArrow(ours, f"_template bigint, _signature bigint, _row struct<_doc: {doc_kind}, _at: bigint>").distinct()
        pairs = own.join(theirs, ["_template", "_signature"]).select("_row", "_item").distinct()
        return pairs.select("_row._doc", "_item").toDF(doc_id, item_id)

    held = spark.sparkContext.broadcast(sorted((tuple(r) for r in read.collect()), key=str))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WindowIndex(templates, held.value)
        for b in batches:
            for part in (b.slice(i, STEP) for i in range(0, b.num_rows, STEP)):
                pairs = sorted(index.found([words(t) for t in part["_text"].to_pylist()]))
                of = part["_doc"].take(pa.array([d for d, _ in pairs], pa.int64()))
                seen = pa.array([index.ids[i] for _, i in pairs], pa.int64() if item_kind == "bigint" else None)
                yield pa.RecordBatch.from_arrays([of, seen], ["_doc", "_item"])

    return docs.mapInArrow(task, f"_doc {doc_kind}, _item {item_kind}").toDF(doc_id, item_id)
