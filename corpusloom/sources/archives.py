"""Containers: zip and tar members as rows, read on the executors, and the layouts found in them."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import posixpath
import shutil
import stat
import tarfile
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.tables import broadcast_if_small


def safe_member(name: str) -> str:
    """The name of a member, or an error if it would leave the archive's folder."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if name.startswith("/") or clean.startswith("../") or clean == ".." or ":" in clean.split("/")[0] or "\0" in name:
        raise ValueError(f"unsafe member {name!r}")
    return clean


def members_of(content: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of all regular files of a zip or tar archive, sorted by name; links and devices are errors."""
    if name.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in sorted(t.getmembers(), key=lambda m: m.name):
                if m.isdir():
                    continue
                if not m.isreg():
                    raise ValueError(f"irregular member {m.name!r}")
                yield safe_member(m.name), t.extractfile(m).read()
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in sorted(z.infolist(), key=lambda m: m.filename):
            kind = stat.S_IFMT(m.external_attr >> 16)
            if m.is_dir():
                continue
            if kind not in (0, stat.S_IFREG):
                raise ValueError(f"irregular member {m.filename!r}")
            yield safe_member(m.filename), z.read(m)


def archive_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(archive, member, content): the text of the members whose names match. One archive is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            for archive, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                for member, data in members_of(content, archive):
                    if re.fullmatch(pattern, member):
                        yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [member], "content": [data.decode("utf-8-sig", "replace")]})

    return files.mapInArrow(task, "archive string, member string, content string")


def _parsed(column: str, schema: str) -> Column:
    """JSON by a schema; text that is no such JSON is an error, as dropping it would leave an incomplete result."""
    parsed = F.from_json(column, schema)
    problem = F.concat(F.lit("malformed JSON: "), F.substring(column, 1, 80))
    return F.when(F.col(column).isNotNull() & parsed.isNull(), F.raise_error(problem)).otherwise(parsed)


def task_dialogues(members: DataFrame) -> DataFrame:
    """(item_id, speaker, text) of members that hold a JSON array of dialogues with turns; the split is the folder's name."""
    schema = "array<struct<dialogue_id: string, turns: array<struct<speaker: string, utterance: string>>>>"
    split = F.element_at(F.split("member", "/"), -2)
    d = members.select(split.alias("split"), F.explode(_parsed("content", schema)).alias("d"))
    t = d.select("split", "d.dialogue_id", F.posexplode("d.turns").alias("n", "t"))
    return t.select(F.concat_ws(":", "split", "dialogue_id", F.lit("turn"), F.col("n").cast("string")).alias("item_id"), F.col("t.speaker").alias("speaker"), F.col("t.utterance").alias("text"))


def daily_dialogues(members: DataFrame) -> DataFrame:
    """(item_id, utt_idx, text) of a list of dialogues with numbered utterances."""
    schema = "array<struct<original_id: string, dialogue_id: string, turns: array<struct<utt_idx: int, utterance: string>>>>"
    d = members.select(F.explode(_parsed("content", schema)).alias("d"))
    t = d.select(F.coalesce("d.original_id", "d.dialogue_id").alias("id"), F.explode("d.turns").alias("t"))
    return t.select(F.concat_ws(":", "id", F.col("t.utt_idx").cast("string")).alias("item_id"), "t.utt_idx", F.col("t.utterance").alias("text"))


def intents(members: DataFrame) -> DataFrame:
    """(split, pos, text, intent) of a map of splits to lists of [text, intent]."""
    d = members.select(F.explode(_parsed("content", "map<string, array<array<string>>>")).alias("split", "rows"))
    return d.select("split", F.posexplode("rows").alias("pos", "r")).select("split", "pos", F.col("r")[0].alias("text"), F.col("r")[1].alias("intent"))


def localised_intents(members: DataFrame, locale: str) -> DataFrame:
    """(id, scenario, intent, text, author) of JSON lines in one locale."""
    lines = members.select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    r = _parsed("line", "id string, locale string, scenario string, intent string, utt string, worker_id string")
    return lines.select(r.alias("r")).filter(F.col("r.locale") == locale).select("r.id", "r.scenario", "r.intent", F.col("r.utt").alias("text"), F.col("r.worker_id").alias("author"))


def schema_guided(members: DataFrame) -> DataFrame:
    """(split, dialogue_id, n, speaker, text, frames) of schema-guided dialogues, for ``unambiguous_service``."""
    schema = "array<struct<dialogue_id: string, turns: array<struct<speaker: string, utterance: string, frames: array<struct<service: string>>>>>>"
    d = members.select(F.element_at(F.split("member", "/"), -2).alias("split"), F.explode(_parsed("content", schema)).alias("d"))
    t = d.select("split", "d.dialogue_id", F.posexplode("d.turns").alias("n", "t"))
    return t.select("split", "dialogue_id", "n", F.col("t.speaker").alias("speaker"), F.col("t.utterance").alias("text"), F.col("t.frames").alias("frames"))


def service_descriptions(members: DataFrame) -> DataFrame:
    """(split, service, description) of the schema files of schema-guided dialogues."""
    schema = "array<struct<service_name: string, description: string>>"
    each = members.select(F.element_at(F.split("member", "/"), -2).alias("split"), F.explode(_parsed("content", schema)).alias("s"))
    return each.select("split", F.col("s.service_name").alias("service"), F.col("s.description").alias("description"))


def described_turns(turns: DataFrame, services: DataFrame) -> DataFrame:
    """Turns of one service (``readers.unambiguous_service``) with its description in the schema of their own split; a
    service that this does not describe is an error."""
    known = services.groupBy("split", "service").agg(F.min("description").alias("description"), F.lit(True).alias("_known"))
    met = turns.join(broadcast_if_small(known), ["split", "service"], "left")
    problem = F.concat(F.lit("no schema for "), F.coalesce("split", F.lit("")), F.lit("/"), "service")
    checked = met.withColumn("_ok", F.when(F.col("_known"), True).otherwise(F.raise_error(problem)))
    return checked.filter("_ok").drop("_known", "_ok")


def _rows_of(members: DataFrame, read, schema: str) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for member, content in zip(b["member"].to_pylist(), b["content"].to_pylist()):
                rows = list(read(member, content))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return members.select("member", "content").mapInArrow(task, schema)


def question_answers(members: DataFrame) -> DataFrame:
    """(member, focus, question, answer) of XML documents of question and answer pairs, in either of two dialects."""

    def read(member: str, content: str):
        root = ET.fromstring(content)
        tag = lambda e: e.tag.rsplit("}", 1)[-1].lower()
        text = lambda e, *names: next((" ".join("".join(x.itertext()).split()) for x in e.iter() if tag(x) in names), "")
        focus = text(root, "focus", "doctitle-focus")
        for pair in root.iter():
            if tag(pair) in ("qapair", "pair"):
                yield {"member": member, "focus": focus, "question": text(pair, "question"), "answer": text(pair, "answer")}

    return _rows_of(members, read, "member string, focus string, question string, answer string")


def clinical_dialogues(members: DataFrame) -> DataFrame:
    """(split, id, dialogue) of CSV members with the columns ID and dialogue, in any case; the split is in the file name.
    ``readers.speaker_turns`` cuts them into turns."""

    def read(member: str, content: str):
        split = next((s for s in ("train", "valid", "test") if s in member.lower()), "")
        for row in csv.DictReader(io.StringIO(content)):
            low = {k.strip().lower(): v for k, v in row.items() if k}
            if (low.get("dialogue") or "").strip():
                yield {"split": split, "id": low.get("id", ""), "dialogue": low["dialogue"]}

    return _rows_of(members, read, "split string, id string, dialogue string")


def meeting_words(members: DataFrame) -> DataFrame:
    """(member, pos, id, word, punctuation) of word files of a transcript, in order."""

    def read(member: str, content: str):
        words = [w for w in ET.fromstring(content).iter() if w.tag.rsplit("}", 1)[-1] == "w" and (w.text or "").strip()]
        for pos, w in enumerate(words):
            ident = next((v for k, v in w.attrib.items() if k.rsplit("}", 1)[-1] == "id"), "")
            yield {"member": member, "pos": pos, "id": ident, "word": w.text.strip(), "punctuation": w.attrib.get("punc") == "true"}

    return _rows_of(members, read, "member string, pos bigint, id string, word string, punctuation boolean")


def document_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, text) of word-processor files: the texts of the paragraphs of their main part."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                root = ET.fromstring(dict(members_of(content, file))["word/document.xml"])
                local = lambda e: e.tag.rsplit("}", 1)[-1]
                texts = ["".join(t.text or "" for t in p.iter() if local(t) == "t").strip() for p in root.iter() if local(p) == "p"]
                rows = [{"path": file, "paragraph": i, "text": t} for i, t in enumerate(texts) if t]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return files.mapInArrow(task, "path string, paragraph bigint, text string")


def markdown_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, text) of Markdown files: blocks apart, links reduced to their text, marks dropped."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    plain = F.regexp_replace(F.regexp_replace("value", r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^[ \t]*(?:#{1,6}|[-*>]|\d+\.)[ \t]+", "")
    blocks = files.select("path", F.posexplode(F.split(plain, r"\n\s*\n")).alias("paragraph", "text"))
    return blocks.select("path", "paragraph", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).filter("text <> ''")


# snapshots and locks


def file_lock(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files of a source, digested on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def lock_problems(now: DataFrame, locked: DataFrame) -> DataFrame:
    """(path, problem): files that are new, missing or changed against a lock."""
    both = now.select("path", F.col("sha256").alias("a")).join(locked.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def config_fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def write_json_atomic(path: str, payload: object) -> None:
    """Writes a small JSON file beside its place and renames it, so that readers see the old or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, sort_keys=True)
    os.replace(f.name, path)


class Snapshots:
    """Versions of a stage's table under one folder of a local or mounted file system.

    A version is written whole, then entered as the stage's next number. Entering creates a file that must not exist yet, so
    of two writers that read the same version only one succeeds (compare and swap). An entry names the version of the stage
    before that it was made from; if that stage has moved on since, the version is stale and no longer current.
    """

    def __init__(self, root: str, stages: tuple[str, ...]):
        self.root, self.stages = root, stages
        os.makedirs(root, exist_ok=True)

    def _entry(self, stage: str) -> tuple[int, dict]:
        """(number, content) of the last entry; number 0 if there is none."""
        numbers = [int(m.group(1)) for m in (re.fullmatch(rf"{re.escape(stage)}[.](\d+)[.]json", f) for f in os.listdir(self.root)) if m]
        if not numbers:
            return 0, {}
        with open(os.path.join(self.root, f"{stage}.{max(numbers)}.json"), encoding="utf-8") as f:
            return max(numbers), json.load(f)

    def generation(self, stage: str) -> str | None:
        at = self.stages.index(stage)
        entry = self._entry(stage)[1]
        if not entry or (at and entry["after"] != self.generation(self.stages[at - 1])):
            return None
        return entry["generation"]

    def publish(self, stage: str, table: DataFrame, *, expected: str | None, digest: str) -> str:
        number, _ = self._entry(stage)
        if self.generation(stage) != expected:
            raise RuntimeError(f"{stage} has changed since it was read")
        at = self.stages.index(stage)
        entry = {"generation": digest, "after": self.generation(self.stages[at - 1]) if at else None}
        table.write.mode("overwrite").parquet(os.path.join(self.root, stage, digest))
        new = os.path.join(self.root, f".{stage}.{digest}.{os.getpid()}.tmp")
        write_json_atomic(new, entry)
        try:
            os.link(new, os.path.join(self.root, f"{stage}.{number + 1}.json"))  # fails if another writer was first
        except FileExistsError:
            raise RuntimeError(f"{stage} has changed while it was written") from None
        finally:
            os.remove(new)
        return digest

    def read(self, spark: SparkSession, stage: str) -> DataFrame:
        current = self.generation(stage)
        if current is None:
            raise LookupError(f"{stage} has no current version")
        return spark.read.parquet(os.path.join(self.root, stage, current))


def publish_together(outputs: dict[str, str]) -> None:
    """Moves finished files or folders (new -> place) together: if one move fails, all places are as they were."""
    kept, done = {}, []
    try:
        for new, place in outputs.items():
            if os.path.exists(place):
                kept[place] = f"{place}.before"
                os.replace(place, kept[place])
            os.replace(new, place)
            done.append(place)
    except OSError:
        for place in done:
            (shutil.rmtree if os.path.isdir(place) else os.remove)(place)
        for place, old in kept.items():
            os.replace(old, place)
        raise
    for old in kept.values():
        (shutil.rmtree if os.path.isdir(old) else os.remove)(old)
