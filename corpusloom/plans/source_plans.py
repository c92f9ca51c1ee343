"""Queries over the source readers' transformations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources import readers as R
from corpusloom.tables import table

from . import sqltext as S
from .registry import query


@query(
    f"""SELECT doc_id, CAST(i - 1 AS INT) AS turn, split_part(t[i], chr(2), 1) AS speaker, {S.collapse("split_part(t[i], chr(2), -1)")} AS utterance FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (
SELECT doc_id, list_filter(string_split({S.sub('text', R.SPEAKERS, chr(1) + chr(92) + '2' + chr(2))}, chr(1)), lambda x: contains(x, chr(2))) AS t FROM documents WHERE doc_kind = 'clinic')) WHERE utterance <> ''"""
)
def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the clinic talks."""
    docs = table(spark, d, "documents").filter("doc_kind = 'clinic'").select("doc_id", F.col("text").alias("dialogue"))
    return R.speaker_turns(docs).select("doc_id", "turn", "speaker", "utterance")


def _sql_visible(x: str) -> str:
    """Visible prose by patterns: elements that are no prose go whole, outermost kinds first, then tags."""
    for tag in ("script", "style", "blockquote", "ul", "ol", "pre", "code", "li", "a"):
        x = S.sub(x, rf"(?is)<{tag}([ \t\n][^>]*)?>.*?</{tag}[ \t\n]*>", "")
    x = S.sub(x, rf"(?i)</?({'|'.join(R._BLOCKS)})([ \t\n/][^>]*)?>", " ")
    return S.collapse(S.unescape(S.sub(x, "</?[A-Za-z][^>]*>", "")))


@query(f"SELECT doc_id, coalesce({_sql_visible('text')}, CASE WHEN text IS NULL THEN NULL ELSE '' END) AS text FROM documents WHERE doc_kind = 'forum'")
def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible prose of the forum posts; the parser is tested on fixtures."""
    posts = table(spark, d, "documents").filter("doc_kind = 'forum'").select("doc_id", "text")
    return R.map_strings(posts, "text", R.visible_text, "string", pa.string())


@query(f"SELECT doc_id, {S.collapse(S.sub('text', T.TAG, ' '))} AS text FROM documents WHERE doc_kind = 'forum'")
def html_tag_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_kind = 'forum'").select("doc_id", T.collapse(F.regexp_replace("text", T.TAG, " ")).alias("text"))


@query(
    """SELECT source_name, source_item_id, CASE WHEN regexp_matches(source_url, '^https?://') THEN source_url ELSE 'https://none.example/' || CAST(id AS VARCHAR) END AS source_url, coalesce(source_author, '') AS source_author, text FROM raw_items WHERE text IS NOT NULL AND regexp_replace(text, '[\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g') <> ''"""
)
def source_projection(spark: SparkSession, d: str) -> DataFrame:
    """The ingest relation projected from the raw items: own URL or one from a template, blank texts dropped."""
    rows = table(spark, d, "raw_items")
    url = F.when(F.col("source_url").rlike("^https?://"), F.col("source_url")).otherwise(F.concat(F.lit("https://none.example/"), F.col("id").cast("string")))
    made = R.ingest(rows, source_url=url, source_author=F.coalesce("source_author", F.lit("")))
    return made.select("source_name", "source_item_id", "source_url", "source_author", "text")


@query(
    """WITH t AS (SELECT id % 7 AS meeting, id // 7 AS pos, CAST(id AS VARCHAR) AS word, id % 5 = 0 AS punctuation FROM raw_items), e AS (SELECT meeting, max(pos) + 1 AS positions FROM t GROUP BY meeting),
s AS (SELECT doc_id AS segment_id, meeting, (doc_id * 13) % positions AS first, (doc_id * 13) % positions + doc_id % 40 AS last FROM documents JOIN e ON meeting = doc_id % 7)
SELECT segment_id, trim(string_agg(CASE WHEN punctuation THEN word ELSE ' ' || word END, '' ORDER BY pos)) AS text FROM s JOIN t ON s.meeting = t.meeting AND t.pos BETWEEN s.first AND s.last GROUP BY segment_id"""
)
def token_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Segments joined with the tokens in their range; positions are made of the identifiers of the test tables, those of
    the segments spread over all positions of their meeting."""
    t = table(spark, d, "raw_items").select((F.col("id") % 7).alias("meeting"), F.lit("x").alias("speaker"), F.floor(F.col("id") / 7).alias("pos"), F.col("id").cast("string").alias("word"), (F.col("id") % 5 == 0).alias("punctuation"))
    ends = t.groupBy("meeting").agg((F.max("pos") + 1).alias("positions"))
    first = (F.col("doc_id") * 13) % F.col("positions")
    s = table(spark, d, "documents").withColumn("meeting", F.col("doc_id") % 7).join(F.broadcast(ends), "meeting").select(
        F.col("doc_id").alias("segment_id"), "meeting", F.lit("x").alias("speaker"), first.alias("first"), (first + F.col("doc_id") % 40).alias("last"))
    return R.token_ranges(t, s)


@query("SELECT id, source_name, run_id, confidence FROM raw_items JOIN (SELECT id, max(run_id) AS run_id, arg_max(confidence, run_id) FILTER (WHERE NOT isnan(confidence)) AS confidence FROM candidates GROUP BY id) USING (id) WHERE source_name IN ('Quarry Sentence Bank', 'Willow Story Shelf') AND coalesce(protected, false) = false")
def optional_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Filters composed from the options that are given; 'all' adds none."""
    options = {"source_name": ["Quarry Sentence Bank", "Willow Story Shelf"], "top_scene": "all"}
    best = table(spark, d, "candidates").groupBy("id").agg(F.max("run_id").alias("run_id"), F.max_by(F.col("confidence"), F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), F.col("run_id"))).alias("confidence"))
    rows = table(spark, d, "raw_items").filter(~F.coalesce("protected", F.lit(False)))
    for column, value in options.items():
        if value != "all":
            rows = rows.filter(F.col(column).isin(value))
    return rows.join(best, "id").select("id", "source_name", "run_id", "confidence")
