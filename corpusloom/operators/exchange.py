"""Files exchanged with people and other systems: strict JSON lines, canonical payloads, chunks, validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import broadcast_if_small, cut_lineage, with_places

MAX_LINE = 1 << 20


def read_strict(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """JSON lines with exactly the given fields and types; a line that is too long, no object, has repeated, missing or
    further keys or values of another kind fails the read, naming the problem."""
    lines = spark.read.text(path).filter("value <> ''")
    keys = F.json_object_keys("value")
    schema = ", ".join(f"`{k}` {t}" for k, t in fields.items())
    parsed = F.from_json("value", schema)
    wanted = F.array(*[F.lit(k) for k in sorted(fields)])
    problem = (
        F.when(F.length("value") > MAX_LINE, "line too long").when(keys.isNull(), "no JSON object").when(F.size(keys) != F.size(F.array_distinct(keys)), "repeated key")
        .when(F.array_sort(keys) != wanted, "other fields"))
    for k in fields:
        given = F.get_json_object("value", f"$.{k}")
        problem = problem.when(given.isNotNull() & parsed[k].isNull(), f"bad {k}")
    checked = lines.withColumn("_ok", F.when(problem.isNull(), True).otherwise(F.raise_error(F.concat(problem, F.lit(": "), F.substring("value", 1, 80)))))
    return checked.filter("_ok").select(parsed.alias("p")).select("p.*")


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order, so that equal payloads are equal strings."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def chunks(rows: DataFrame, family: str, order: str, payload: str, *, most_rows: int = 500, most_bytes: int = 16 << 20) -> DataFrame:
    """Rows with the number of their file within the family: a file holds at most ``most_rows`` rows and starts anew
    where the bytes so far fill another ``most_bytes``. Places and bytes so far come from ranges, so no family is sorted in
    one task; ``order`` is unique within a family."""
    size = F.octet_length(payload) + 1
    placed = with_places(rows, [family], [F.col(order)], running=size)
    parts = placed.withColumns({"_r": F.floor(F.col("_place") / most_rows), "_b": F.floor((F.col("_before") + size - 1) / most_bytes)})
    files = parts.select(F.col(family).alias("_family"), "_r", "_b").distinct()
    files = files.withColumn("chunk", (F.row_number().over(Window.partitionBy("_family").orderBy("_r", "_b")) - 1).cast("int")).withColumnsRenamed({"_r": "_r2", "_b": "_b2"})
    on = F.col(family).eqNullSafe(F.col("_family")) & (F.col("_r") == F.col("_r2")) & (F.col("_b") == F.col("_b2"))
    return parts.join(broadcast_if_small(files), on).drop("_family", "_r", "_b", "_r2", "_b2", "_place", "_before")


def payload_problems(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """(id, problem): classifications that break a rule: confidence within 0 and 1, scene known, top scene its own, both
    or none given."""
    known = broadcast_if_small(scenes.select(F.col("scene_key").alias("sub_scene"), F.col("top_key").alias("_top")))
    j = rows.join(known, "sub_scene", "left")
    c = F.col("confidence")
    problem = (
        F.when(c.isNull() | F.isnan(c) | ~c.between(0, 1), "confidence").when(F.col("sub_scene").isNull() != F.col("top_scene").isNull(), "half a scene")
        .when(F.col("sub_scene").isNotNull() & F.col("_top").isNull(), "unknown scene").when(F.col("_top") != F.col("top_scene"), "foreign top scene"))
    return j.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


def translation_problems(rows: DataFrame) -> DataFrame:
    """(id, problem): finished translations that break a rule: text present, no issues left, a review note or nothing where
    they were repaired. ``rows``: id, translation_zh, issues, review_note, repaired."""
    blank = lambda c: T.collapse(F.coalesce(F.col(c), F.lit(""))) == ""
    problem = F.when(blank("translation_zh"), "no translation").when(F.coalesce(F.size("issues"), F.lit(0)) > 0, "open issues").when(F.col("repaired") & blank("review_note"), "no review note")
    return rows.select("id", problem.alias("problem")).filter("problem IS NOT NULL")


#: What a decision on a class holds, as it is exchanged: both scenes or none.
DECISION = {"item_id": "bigint", "top_scene": "string", "sub_scene": "string", "reason": "string"}


def export_requests(rows: DataFrame, folder: str, *, family: str, most_rows: int = 500) -> DataFrame:
    """Writes requests as JSON lines, one folder a family and chunk, of at most ``most_rows`` rows each; what was written.
    ``rows`` has item_id, the family's column and whatever a reviewer needs."""
    line = rows.select("item_id", F.col(family).alias("family"), F.to_json(F.struct(*rows.columns)).alias("value"))
    parts = chunks(line, "family", "item_id", "value", most_rows=most_rows).select("family", "chunk", "item_id", "value")
    parts = cut_lineage(parts)
    parts.select("family", "chunk", "value").repartition("family", "chunk").write.partitionBy("family", "chunk").text(folder)
    return parts.select("family", "chunk", "item_id")


def import_decisions(spark: SparkSession, path: str, requested: DataFrame, scenes: DataFrame) -> DataFrame:
    """The decisions of result files, read strictly. All requests must be answered once, nothing else, by known scenes with
    their own top scene or by none; otherwise it is an error that names the first problems, and nothing is imported."""
    rows = cut_lineage(read_strict(spark, path, DECISION))
    n = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    both = requested.select("item_id").distinct().withColumn("asked", F.lit(True)).join(n, "item_id", "full_outer")
    covered = both.select("item_id", F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "repeated").alias("problem"))
    classes = payload_problems(rows.withColumns({"id": F.col("item_id"), "confidence": F.lit(1.0)}), scenes).withColumnRenamed("id", "item_id")
    reasons = rows.filter(F.trim(F.coalesce("reason", F.lit(""))) == "").select("item_id", F.lit("no reason").alias("problem"))
    wrong = covered.filter("problem IS NOT NULL").unionByName(classes).unionByName(reasons).orderBy("item_id", "problem").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['item_id']}: {r['problem']}" for r in wrong))
    return rows


def with_capacity(rows: DataFrame, used: DataFrame, *, source_limit: int, author_limit: int) -> DataFrame:
    """Rows whose source and named author still have room: ``used`` lists what is selected already."""
    s = used.groupBy("source_name").agg(F.count("*").alias("_s"))
    a = used.filter(F.trim("source_author") != "").groupBy("source_author").agg(F.count("*").alias("_a"))
    j = rows.join(s, "source_name", "left").join(a, "source_author", "left")
    return j.filter((F.coalesce("_s", F.lit(0)) < source_limit) & (F.coalesce("_a", F.lit(0)) < author_limit)).drop("_s", "_a")


def authentic(text: Column, markers: list[str], *, openers: list[str], connectors: list[str]) -> Column:
    """Whether a sentence of an exam paper is prose: no marker of instructions, no opener of options, no connector at its
    end, no Han, no blanks to fill."""
    low = F.lower(text)
    marked = F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: low.contains(m))
    opened = F.exists(F.array(*[F.lit(o) for o in openers]), lambda o: low.startswith(o))
    ended = F.exists(F.array(*[F.lit(c) for c in connectors]), lambda c: low.endswith(F.concat(F.lit(" "), c)))
    return ~(marked | opened | ended | text.rlike(r"[\x{4E00}-\x{9FFF}]|_{2,}|\.{4,}"))


def exam_session(path: Column) -> Column:
    """Year and month of an exam in a file name, as yyyy-mm; null if there is none."""
    year, month = F.regexp_extract(path, r"(20\d{2})[^0-9]{0,3}(\d{1,2})", 1), F.regexp_extract(path, r"(20\d{2})[^0-9]{0,3}(\d{1,2})", 2)
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0")))


def around(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """What stands before and after the span [start, end) of code points."""
    return F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
