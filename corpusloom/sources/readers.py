"""Readers of corpora. Every reader returns the ingest relation, one row per sentence with its provenance."""

from __future__ import annotations

import json
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import broadcast_if_small

INGEST = ("source_name", "source_item_id", "source_url", "source_author", "license_name", "license_url", "text", "top_scene", "sub_scene")


def ingest(df: DataFrame, **constants: str | Column) -> DataFrame:
    """The ingest relation from a frame that has some of its columns, the others given or null. Blank texts are dropped."""
    out = []
    for c in INGEST:
        value = constants.get(c)
        column = value if isinstance(value, Column) else F.lit(value) if value is not None else F.col(c) if c in df.columns else F.lit(None)
        out.append(column.cast("string").alias(c))
    return df.select(out).filter(F.regexp_replace(F.coalesce("text", F.lit("")), T.SPACE, "") != "")


@dataclass
class SourceConfig:
    """A declared source: where it is, how it is laid out, where its fields are."""

    name: str
    path: str
    format: str
    text_field: str = "text"
    license_name: str = ""
    license_url: str = ""
    id_field: str | None = None
    author_field: str | None = None
    url_field: str | None = None
    url_template: str | None = None
    item_url: str = ""
    delimiter: str = ","
    field_names: list[str] = field(default_factory=list)
    element: str = "p"
    max_items: int | None = None
    top_scene: str | None = None
    sub_scene: str | None = None


def load_configs(content: str) -> list[SourceConfig]:
    """Sources from a JSON array; unknown and repeated names are errors."""
    configs = [SourceConfig(**x) for x in json.loads(content)]
    if len({c.name for c in configs}) != len(configs):
        raise ValueError("two sources of one name")
    return configs


class _Events(HTMLParser):
    """A page as a flat list of events: (1, tag) opens, (-1, tag) closes, (0, text) stands between."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.list: list[tuple[int, str]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.list.append((1, tag))

    def handle_endtag(self, tag):
        self.list.append((-1, tag))

    def handle_data(self, data):
        self.list.append((0, data))


def _depths(events: list[tuple[int, str]], tags: Container[str]) -> list[int]:
    """How many elements of these names are open after each event; an end without a beginning counts for nothing."""
    steps = (way if value in tags else 0 for way, value in events)
    return list(accumulate(steps, lambda depth, step: max(0, depth + step)))


def _squeezed(parts: Iterable[str], gap: str) -> str:
    return " ".join(gap.join(parts).split())


def element_texts(html: str, name: str) -> list[str]:
    """The texts of all elements of a name, nested ones with their parent."""
    events = _Events(html).list
    runs = groupby(zip(events, _depths(events, {name})), lambda x: x[1] > 0)
    texts = (_squeezed((value for (way, value), _ in run if not way), " ") for is_open, run in runs if is_open)
    return [t for t in texts if t]


#: Elements that part lines, and elements that are no running prose.
_BLOCKS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "section", "article", "header", "footer", "hr")
_NO_PROSE = ("code", "pre", "blockquote", "script", "style", "ul", "ol", "li", "a")


def visible_text(html: str | None) -> str:
    """What a reader sees of running prose: no code, quotes, lists, links or scripts; blocks apart."""
    events = _Events(html or "").list
    shown = (" " if way and value in _BLOCKS else value if not (way or depth) else "" for (way, value), depth in zip(events, _depths(events, _NO_PROSE)))
    return _squeezed(shown, "")


def map_strings(df: DataFrame, column: str, f: Callable[[str], object], kind: str, arrow: pa.DataType) -> DataFrame:
    """``df`` with a column replaced by a Python function of it, in Arrow batches; nulls stay null."""
    schema = ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if x is None else f(x) for x in b[column].to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([made if c == column else b[c] for c in b.schema.names], names=b.schema.names)

    return df.mapInArrow(task, schema)


def read_source(spark: SparkSession, c: SourceConfig) -> DataFrame:
    """A declared source as the ingest relation. Compressed files are recognised by their ending."""
    if c.format == "json":
        rows = spark.read.json(c.path, multiLine=True)
    elif c.format == "jsonl":
        rows = spark.read.json(c.path)
    elif c.format in ("csv", "tsv"):
        reader = spark.read.option("sep", "\t" if c.format == "tsv" else c.delimiter).option("quote", '"').option("escape", '"')
        if c.field_names:
            rows = reader.schema(", ".join(f"`{n}` string" for n in c.field_names)).csv(c.path)
        else:
            rows = reader.option("header", True).csv(c.path)
    elif c.format == "text":
        rows = spark.read.text(c.path).withColumnRenamed("value", c.text_field)
    elif c.format == "html":
        pages = spark.read.text(c.path, wholetext=True)
        texts = map_strings(pages, "value", lambda h: element_texts(h, c.element), "array<string>", pa.list_(pa.string()))
        rows = texts.select(F.explode("value").alias(c.text_field))
    elif c.format == "parquet":
        rows = spark.read.parquet(c.path)
    else:
        raise ValueError(f"unknown format {c.format}")
    rows = rows.filter(F.col(c.text_field).isNotNull())
    url = F.lit(c.item_url)
    if c.url_template:
        parts, url = c.url_template.replace("}", "{").split("{"), F.lit("")
        url = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    elif c.url_field:
        own = F.col(c.url_field)
        url = F.when(own.rlike("^https?://"), own).otherwise(F.lit(c.item_url))
    ident = F.col(c.id_field) if c.id_field else F.substring(T.normalized_hash(F.col(c.text_field)), 1, 16)
    author = F.coalesce(F.col(c.author_field), F.lit("")) if c.author_field else F.lit("")
    return ingest(rows, source_name=c.name, source_item_id=ident, source_url=url, source_author=author, license_name=c.license_name, license_url=c.license_url, text=F.col(c.text_field), top_scene=c.top_scene, sub_scene=c.sub_scene)


def read_all(spark: SparkSession, configs: list[SourceConfig]) -> DataFrame:
    """All declared sources, each with at most its ``max_items`` rows in order of the item."""
    out = None
    for c in configs:
        rows = read_source(spark, c)
        if c.max_items is not None:
            n = F.row_number().over(Window.partitionBy("source_name").orderBy("source_item_id", "text"))
            rows = rows.withColumn("_n", n).filter(F.col("_n") <= c.max_items).drop("_n")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources")
    return out


def missing_provenance(rows: DataFrame, required: tuple[str, ...] = ("source_name", "source_item_id", "source_url", "source_author", "license_name", "license_url")) -> DataFrame:
    """(source_name, source_item_id, missing) of rows that lack required fields."""
    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in required]
    return rows.select("source_name", "source_item_id", F.array_compact(F.array(*blank)).alias("missing")).filter(F.size("missing") > 0)


# corpora with a layout of their own


def sentence_dump(spark: SparkSession, path: str, *, language: str = "eng") -> DataFrame:
    """A dump of tab-separated id, language, text, author ...; rows of a language, a numeric id and a named author."""
    rows = spark.read.schema("id string, lang string, text string, author string").option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    named = F.coalesce("author", F.lit(""))
    return rows.filter((F.col("lang") == language) & F.col("id").rlike("^[0-9]+$") & ~named.isin("", "\\N")).select("id", "text", "author")


def utterances(spark: SparkSession, utterance_path: str, speaker_path: str) -> DataFrame:
    """(id, text, author): utterances with their speaker's name from a second file, by meta.name, name or id; those
    without any are dropped. The speaker file is a JSON map of id to properties."""
    u = spark.read.schema("id string, text string, speaker string").json(utterance_path)
    inner = F.from_json("speaker", "id string, name string, meta struct<name: string>")
    given = F.coalesce(inner["id"], F.col("speaker"))
    u = u.select("id", "text", given.alias("key"), F.coalesce(inner["meta"]["name"], inner["name"]).alias("own"))
    raw = spark.read.text(speaker_path, wholetext=True)
    s = raw.select(F.explode(F.from_json("value", "map<string, struct<name: string, meta: struct<name: string>>>")).alias("key", "p"))
    s = s.select("key", F.coalesce(F.col("p.meta.name"), F.col("p.name")).alias("there"))
    author = F.coalesce("own", "there", "key")
    return u.join(s, "key", "left").select("id", "text", author.alias("author")).filter(F.coalesce("author", F.lit("")) != "")


def news_extracts(pages: DataFrame, *, most: int = 6) -> DataFrame:
    """(page_id, pos, text, dated): the first ``most`` sentences of each extract after its dateline.

    ``pages`` has page_id and extract."""
    line = r"^\s*(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),\s+([A-Z][a-z]+ \d{1,2}, \d{4})\s*"
    dated = F.try_to_timestamp(F.regexp_extract("extract", line, 1), F.lit("MMMM d, yyyy")).cast("date")
    each = pages.select("page_id", dated.alias("dated"), F.posexplode(T.abbreviation_safe_sentences(F.regexp_replace("extract", line, ""))).alias("pos", "text"))
    return each.filter(F.col("pos") < most)


def ebook(spark: SparkSession, path: str) -> DataFrame:
    """(path, author, paragraph, sentence, text) of e-books between their start and end marks; books without an author
    line are dropped."""
    books = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    plain = F.regexp_replace("value", "\r", "")
    author = F.trim(F.regexp_extract(plain, r"(?m)^Author:[ \t]*(.+)$", 1))
    body = F.regexp_extract(plain, r"(?s)\*\*\* ?START OF[^\n]*\n(.*?)(?:\*\*\* ?END OF|\z)", 1)
    paragraphs = books.select("path", author.alias("author"), F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("paragraph", "p")).filter("author <> ''")
    return paragraphs.select("path", "author", "paragraph", F.posexplode(T.sentences(F.col("p"))).alias("sentence", "text"))


#: Who speaks in clinical dialogues, written in any case, before a colon.
SPEAKERS = r"(?i)(^|[ \t\n\r])(Doctor|Patient|Physician|Provider|Clinician|Nurse|Guest_[a-z]+(?:_[0-9])?|D|P)[ \t\n\r]*:[ \t\n\r]*"


def speaker_turns(rows: DataFrame, *, text: str = "dialogue") -> DataFrame:
    """``rows`` with one row per turn (turn, speaker, utterance) of a dialogue written "Doctor: ... Patient: ..."."""
    marked = F.regexp_replace(F.col(text), SPEAKERS, "\x01$2\x02")
    turns = F.filter(F.split(marked, "\x01"), lambda t: F.instr(t, "\x02") > 0)
    each = rows.select("*", F.posexplode(turns).alias("turn", "_t"))
    return each.select("*", F.substring_index("_t", "\x02", 1).alias("speaker"), T.collapse(F.substring_index("_t", "\x02", -1)).alias("utterance")).drop("_t").filter("utterance <> ''")


def science_questions(spark: SparkSession, path: str) -> DataFrame:
    """(text): questions of a Parquet corpus; only that column is read."""
    rows = spark.read.parquet(path)
    if "question" not in rows.columns:
        raise ValueError("no column question")
    return rows.select(T.clean(F.col("question")).alias("text")).filter("text <> ''").distinct()


def spoken_dialogues(spark: SparkSession, path: str, instruction_prefix: str) -> DataFrame:
    """(conversation_id, index, speaker, text) of dialogues whose instruction has a prefix; gaps in the index are errors."""
    schema = "conversation_id string, instruction_id string, utterances array<struct<index: int, speaker: string, text: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).filter(F.col("instruction_id").startswith(instruction_prefix))
    whole = F.forall(F.transform("utterances", lambda u, i: u["index"] == i), lambda ok: ok)
    checked = rows.withColumn("_ok", F.assert_true(whole, F.concat(F.lit("broken index in "), "conversation_id")))
    return checked.filter(F.col("_ok").isNull()).select("conversation_id", F.explode("utterances").alias("u")).select("conversation_id", "u.index", "u.speaker", "u.text")


def forum_sentences(posts: DataFrame, users: DataFrame, tag_scenes: dict[str, tuple[int, str]]) -> DataFrame:
    """(post_id, pos, author, scene, text): sentences of a forum's questions in prose.

    ``posts``: post_id, kind, body (HTML), tags (``<a><b>`` or ``|a|b|``), owner_id, owner_name; ``users``: user_id,
    name; ``tag_scenes``: tag -> (priority, scene), the least priority among a post's tags wins, posts without a known
    tag are dropped.
    """
    tags = F.regexp_extract_all("tags", F.lit("[^<>|]+"), F.lit(0))
    spark = posts.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, p, s) for t, (p, s) in tag_scenes.items()], "tag string, priority int, scene string"))
    asked = posts.filter("kind = 1").withColumn("tag", F.explode(tags)).join(known, "tag")
    one = asked.groupBy("post_id").agg(F.min(F.struct("priority", "scene")).alias("s"))
    rows = posts.filter("kind = 1").join(one, "post_id").join(users, F.col("owner_id") == F.col("user_id"), "left")
    rows = rows.select("post_id", "body", F.coalesce("name", "owner_name").alias("author"), F.col("s.scene").alias("scene"))
    prose = map_strings(rows, "body", visible_text, "string", pa.string())
    return prose.select("post_id", "author", "scene", F.posexplode(T.sentences(F.col("body"))).alias("pos", "text"))


def token_ranges(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, text): the tokens of each segment, glued at punctuation.

    ``tokens``: meeting, speaker, pos, word, punctuation; ``segments``: segment_id, meeting, speaker, first, last. A
    range join within meeting and speaker; positions are put in blocks of 256, so the join has an equality key of
    bounded size.
    """
    width = 256
    s = segments.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    t = tokens.withColumn("block", F.floor(F.col("pos") / width))
    met = s.join(t, ["meeting", "speaker", "block"]).filter(F.col("pos").between(F.col("first"), F.col("last")))
    glued = F.concat(F.when(F.col("punctuation"), "").otherwise(" "), F.col("word"))
    lists = met.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("pos", glued.alias("w")))).alias("ws"))
    return lists.select("segment_id", F.trim(F.array_join(F.transform("ws", lambda x: x["w"]), "")).alias("text"))


def labelled(rows: DataFrame, keys: list[str], allowed: DataFrame) -> DataFrame:
    """Rows whose label is in an allow-list, with the scene it maps to."""
    return rows.join(broadcast_if_small(allowed), keys)


def unambiguous_service(turns: DataFrame) -> DataFrame:
    """Turns with the one service that all their frames name; others are dropped."""
    services = F.array_distinct(F.transform("frames", lambda f: f["service"]))
    return turns.withColumn("service", F.when(F.size(services) == 1, F.get(services, F.lit(0)))).filter(F.col("service").isNotNull())


def legacy_import(old: DataFrame, *, protected: bool = True) -> DataFrame:
    """Rows of an earlier store as protected items; a repeated hash is an error when the result is read."""
    n = F.count("*").over(Window.partitionBy("normalized_hash"))
    checked = old.withColumn("_bad", F.assert_true(n == 1, F.concat(F.lit("repeated hash "), "normalized_hash"))).filter(F.col("_bad").isNull())
    return checked.drop("_bad").withColumn("protected", F.lit(protected))
