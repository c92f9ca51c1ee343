"""Text cut off by field limits or in transfer: a hashed logistic regression on how texts close.

Intact values are cut artificially inside a sentence, at a limit or anywhere, with or without a mark of the cut; the
cut copies are the positives, the values as they stand the negatives. Some of these are cut in truth, so the model's own
finds are taken out of the negatives and it is fitted again, twice. Every text is then scored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.tables import broadcast_if_small, cut_lineage

#: Size of the hashed feature space.
DIMENSIONS = 1 << 17
#: Documented bound: about so many documents are drawn, by a hash of the identifier, to fit the classifier.
TRAINING_DOCUMENTS = 20_000
#: A length is a source's limit if so many of its texts, and this share of them, have it exactly.
LIMIT_COUNT, LIMIT_SHARE = 5, 0.005

MARKS = ("…", "...", " ...", " …", "[...]", " [...]", "[…]", " (truncated)", "[truncated]", " (more)", "...more", "�", "-")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_TOKEN = re.compile(r"\S+")
_SPEAKER = re.compile(r"[^\s:]{1,20}(?: [^\s:]{1,20})?:\s")
_NUMBERED = re.compile(r"\d{1,4}[.)]\s")
_FINAL = ".!?。！？｡؟।"
_CLOSING = "\"'”’»)]」』）】"


def char_class(c: str) -> str:
    if c.isdigit():
        return "9"
    if "一" <= c <= "鿿" or "㐀" <= c <= "䶿":
        return "Z"
    if c.isalpha():
        return "A" if c.isupper() else "a"
    if c.isspace():
        return "_"
    return c if ord(c) < 0x2100 or c in "…。！？，；：、” � " else "*"


def shape(token: str) -> str:
    """A token with its kind kept: names and numbers masked, short words as they are."""
    if re.match(r"https?://|www\.", token):
        return "URL"
    core = token.strip(".,;:!?…\"'()[]“”")
    tail = token[len(token.rstrip(".,;:!?…\"')]”")) :]
    if core.isdigit():
        return "9" + tail
    if len(core) > 4 and core[:1].isupper() and core[1:].islower():
        return "N" + tail
    if core[:1] == "#":
        return "#" + shape(core[1:]) if len(core) > 1 else "#"
    if core and all(char_class(c) == "Z" for c in core):
        return "Z" + tail
    return token.lower() if len(token) <= 16 else "long" + tail


def line_kind(line: str) -> str:
    if _NUMBERED.match(line):
        return "number"
    if line.startswith("<"):
        return "tag"
    if _SPEAKER.match(line):
        return "speaker"
    return line[0] if line[:1] in "-*•—–#(" else "plain"


def features(text: str, at_limit: bool, near_limit: bool) -> list[int]:
    """Hashed features of how a text closes; a few of them look at all its lines."""
    whole = text.rstrip()
    start = max(whole.rfind("\n"), whole.rfind("\r")) + 1
    line = whole[start:]
    bare = _TAG.sub("", line).rstrip()
    opened, closed = len(re.findall(r"<[a-zA-Z]", line)), len(re.findall(r"</[a-zA-Z]+>", line))
    inner = bare.rstrip(_CLOSING)
    last = bare[-3:]
    kinds = "".join(map(char_class, last))
    sentence_end = inner[-1:] in tuple(_FINAL) and not inner.endswith("..")
    tokens = _TOKEN.findall(bare)
    shapes = [shape(t) for t in (tokens if len(tokens) <= 8 else tokens[:3] + tokens[-2:])]
    kind = line_kind(line) if line else "none"
    before = whole[:start].rstrip()
    earlier = before[max(before.rfind("\n"), before.rfind("\r")) + 1 :]
    like = "first" if not earlier else "same" if line_kind(earlier) == kind else "other"
    count = len(tokens)
    size = "0" if not count else "1" if count < 2 else "2" if count < 3 else "3-5" if count < 6 else "6-9" if count < 10 else "10+"
    end = "final" if sentence_end else kinds[-1:]
    quotes = bare.count('"') % 2 == 1 or bare.count("“") > bare.count("”")
    brackets = bare.count("(") + bare.count("[") + bare.count("（") > bare.count(")") + bare.count("]") + bare.count("）")
    mark = next((m for m in ("...", "…", "[", "(", "�") if (bare[-12:] if m in "[(" else bare[-4:]).find(m) >= 0), "")
    named = [
        f"end={end}",
        f"ends={kinds}",
        f"last={shapes[-1] if shapes else ''}",
        f"first={shapes[0] if shapes else ''}",
        f"two={' '.join(shapes[:2])}",
        f"line={' '.join(shapes) if count <= 6 else 'long'}",
        f"size={size}",
        f"kind={kind}",
        f"place={kind},{like},{size},{end}",
        f"quotes={quotes}",
        f"brackets={brackets}",
        f"tags={opened > closed},{closed > 0},{end}",
        f"broken={'<' in line[line.rfind('>') + 1:]}",
        f"limit={at_limit}",
        f"near={near_limit}",
        f"limit,end={at_limit or near_limit},{end}",
        f"mark={mark}",
        f"mark,end={mark},{kinds[-1:]}",
        f"single={line_kind(earlier) if earlier else ''},{size},{sentence_end}",
        f"blank={before != whole[:start].rstrip(' ') and whole[:start].endswith(chr(10) * 2)},{size},{end}",
    ]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in named]


def cut(text: str, r: random.Random) -> str | None:
    """An artificial cut of an intact text inside a sentence, sometimes marked; None for texts too short for it."""
    whole = text.rstrip()
    room = max(whole.rfind("\n") + 1, int(len(whole) * 0.8)) if "\n" in whole else len(whole) - 2
    for _ in range(8):
        if room < 12:
            return None
        at = r.randrange(10, room)
        left = _TAG.sub("", whole[:at]).rstrip()
        inner = left.rstrip(_CLOSING)
        if not left or inner[-1:] in tuple(_FINAL) or whole[at - 1] == "\n" or left.endswith("\n") or whole[at : at + 1] in "\n\r":
            continue
        if r.random() < 0.3:
            return whole[:at].rstrip() + r.choice(MARKS)
        return whole[:at]
    return None


def examples(text: str, r: random.Random) -> Iterator[tuple[list[int], int]]:
    """(features, label): the text as it stands and, where it can be cut, an artificially cut copy. Either may happen to
    be at a limit, an intact one seldom."""
    limited = r.random() < 0.02
    yield features(text, limited, limited), 0
    if part := cut(text, r):
        limited = r.random() < 0.4
        yield features(part, limited and r.random() < 0.7, limited), 1


class LogisticRegression:
    """Binary logistic regression on sparse binary features, fitted by AdaGrad over mini-batches."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.w = np.zeros(dimensions)
        self.b = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, seed: int = 0) -> LogisticRegression:
        """``x`` holds the same number of feature positions in every row."""
        order, squares, bias_square = np.random.default_rng(seed), np.full(len(self.w), 1e-6), 1e-6
        for _ in range(epochs if len(y) else 0):
            for rows in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
                error = self.probability(x[rows]) - y[rows]
                g = np.bincount(x[rows].ravel(), weights=np.repeat(error, x.shape[1]), minlength=len(self.w)) / len(rows)
                touched = np.flatnonzero(g)
                step = g[touched] + l2 * self.w[touched]
                squares[touched] += step**2
                self.w[touched] -= rate * step / np.sqrt(squares[touched])
                bias = error.mean()
                bias_square += bias**2
                self.b -= rate * bias / bias_square**0.5
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.w[x].sum(axis=1) + self.b, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_model(x: np.ndarray, y: np.ndarray) -> LogisticRegression:
    """Fits three times: texts as they stand that a model holds for possibly cut are left out of the next one's negatives."""
    model = LogisticRegression()
    sound = np.ones(len(y), dtype=bool)
    for doubt in (0.2, 0.1, None):
        model = LogisticRegression().fit(x[sound], y[sound])
        if doubt and len(y):
            sound = (y == 1) | (model.probability(x) < doubt)
    return model


def source_limits(lengths: DataFrame) -> DataFrame:
    """(_source, _chars, _bytes): the length in characters and in bytes that each source's texts end at most often, where
    that is often enough to be a limit; null otherwise. ``lengths`` counts all texts: (_source, _c, _b, _n)."""
    totals = lengths.groupBy("_source").agg(F.sum("_n").alias("_all"))

    def most(length, name):
        n = lengths.filter(F.col(length) >= 64).groupBy("_source", length).agg(F.sum("_n").alias("_n"))
        top = n.groupBy("_source").agg(F.max(F.struct("_n", length)).alias("_top"))
        enough = (F.col("_top._n") >= LIMIT_COUNT) & (F.col("_top._n") >= LIMIT_SHARE * F.col("_all"))
        return top.join(totals, "_source").filter(enough).select("_source", F.col(f"_top.{length}").alias(name))

    chars, size = most("_c", "_chars"), most("_b", "_bytes")
    return cut_lineage(chars.join(size, "_source", "full_outer"))


def _limited(rows: DataFrame, limits: DataFrame, chars: Column, size: Column) -> DataFrame:
    """``rows`` with ``_at`` (length equals the source's limit in characters) and ``_near`` (in bytes, a broken character aside)."""
    near = (size <= F.col("_bytes")) & (size > F.col("_bytes") - 4)
    met = rows.join(broadcast_if_small(limits), "_source", "left")
    return met.withColumns({"_at": F.coalesce(chars == F.col("_chars"), F.lit(False)), "_near": F.coalesce(near, F.lit(False))}).drop("_chars", "_bytes")


def survey(texts: DataFrame, share: float, seed: int) -> DataFrame:
    """One pass: the counted lengths of all texts (_source, _c, _b, _n), and the examples (x, y) of a share of them, drawn by
    a hash of their identifier, with the length of the text each is made of."""
    drawn = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    columns = ["_source", "_c", "_b", "_n", "x", "y"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table({"_source": b["_source"], "_c": pc.utf8_length(b["_text"]), "_b": pc.binary_length(b["_text"])})
            n = t.group_by(["_source", "_c", "_b"]).aggregate([([], "count_all")]).combine_chunks()
            if n.num_rows:
                empty = [pa.nulls(n.num_rows, pa.list_(pa.int32())), pa.nulls(n.num_rows, pa.int8())]
                yield from pa.Table.from_arrays([*(n[c] for c in ("_source", "_c", "_b", "count_all")), *empty], columns).to_batches()
            at, xs, ys = [], [], []
            chosen = pa.Table.from_batches([b]).append_column("_c", t["_c"]).append_column("_b", t["_b"]).filter(b["_drawn"])
            for i, text in enumerate(chosen["_text"].to_pylist()):
                for x, y in examples(text, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ seed)):
                    at.append(i)
                    xs.append(x)
                    ys.append(y)
            if at:
                made = chosen.select(["_source", "_c", "_b"]).take(pa.array(at)).combine_chunks()
                made = [*made.columns, pa.nulls(len(at), pa.int64()), pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.int8())]
                yield from pa.Table.from_arrays(made, columns).to_batches()

    read = texts.select("_source", "_text", drawn.alias("_drawn"))
    return cut_lineage(read.mapInArrow(task, "_source string, _c int, _b int, _n bigint, x array<int>, y tinyint"))


def train(examples: DataFrame) -> LogisticRegression:
    """The classifier, fitted on the examples made of texts that are at no limit: others are no examples of intact ones."""
    rows = examples.filter(~F.col("_at") & ~F.col("_near")).select("x", "y").orderBy("y", F.xxhash64("x")).toArrow()
    if not rows.num_rows:
        return LogisticRegression()
    y = rows["y"].to_numpy().astype(float)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    return fit_model(x, y)


def score_texts(rows: DataFrame, *, ident: str = "doc_id", text: str = "text", source: str = "source", documents: int = TRAINING_DOCUMENTS, seed: int = 7) -> DataFrame:
    """(ident, source, score) of every row: the probability that the text was cut off. The classifier is fitted on about
    ``documents`` texts; the table is read twice, besides its row count.

    Defined results: null, empty and blank texts score 0, as nothing shows a cut; a null source has limits of its own;
    repeated rows are scored each; texts of any length are read whole for their length and structure; an empty table
    gives no rows. Only the three named columns are read, so other columns play no part.
    """
    read = rows.select(F.col(ident).alias("_id"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(text).alias("_text"))
    said = F.coalesce(F.col("_text").rlike(r"[^\s\p{Cf}\p{Cc}]"), F.lit(False))  # ends at the first visible character
    surveyed = survey(read.filter(said), min(1.0, documents / max(1, rows.count())), seed)
    lengths = surveyed.filter("x IS NULL").groupBy("_source", "_c", "_b").agg(F.sum("_n").alias("_n"))
    limits = source_limits(lengths)
    learned = train(_limited(surveyed.filter("x IS NOT NULL"), limits, F.col("_c"), F.col("_b")))
    kind, source_kind = rows.schema[ident].dataType.simpleString(), rows.schema[source].dataType.simpleString()
    model = read.sparkSession.sparkContext.broadcast(learned)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            score = np.zeros(b.num_rows)
            shown = np.flatnonzero(b["_said"].to_numpy(zero_copy_only=False))
            if len(shown):
                part = b.take(pa.array(shown))
                score[shown] = m.probability(np.array([features(*r) for r in zip(*(part[c].to_pylist() for c in ("_text", "_at", "_near")))]))
            yield pa.RecordBatch.from_arrays([b["_id"], b["_source"], pa.array(score)], ["_id", "_source", "score"])

    marked = _limited(read.withColumn("_said", said), limits, F.length("_text"), F.octet_length("_text"))
    scored = marked.select("_id", "_source", "_text", "_said", "_at", "_near").mapInArrow(task, f"_id {kind}, _source {source_kind}, score double")
    return scored.select(F.col("_id").alias(ident), F.nullif("_source", F.lit("")).alias(source), "score")


def cut_off(rows: DataFrame, *, threshold: float = 0.5, **columns) -> DataFrame:
    """The rows of ``score_texts`` at or over the threshold."""
    return score_texts(rows, **columns).filter(F.col("score") >= threshold)


def cut_rates(scored: DataFrame, *, source: str = "source", threshold: float = 0.5) -> DataFrame:
    """(source, texts, cut, share): how often each source's texts are cut off."""
    n = scored.groupBy(source).agg(F.count("*").alias("texts"), F.count_if(F.col("score") >= threshold).alias("cut"))
    return n.withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
