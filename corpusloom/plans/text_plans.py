"""Queries over texts: cleaning, gate, sentences, words, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import gate
from corpusloom.tables import table

from . import sqltext as S
from .registry import query


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents: item_id, doc_id, pos, text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    each = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    return each.select((F.col("doc_id") * 100_000 + F.col("pos")).alias("item_id"), "doc_id", "pos", "text")


SQL_SENTENCES = f"""SELECT doc_id * 100000 + pos - 1 AS item_id, doc_id, CAST(pos - 1 AS INT) AS pos, s[pos] AS text
FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))"""


@query(SQL_SENTENCES)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return document_sentences(spark, d)


@query(
    f"""SELECT doc_id, list_transform({S.sentences(S.sub(S.collapse('text'), '(^|[^A-Za-z])(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|[A-Z])[.]', chr(92) + '1' + chr(92) + '2' + chr(2)))}, lambda s: replace(s, chr(2), '.')) AS sentences
FROM documents"""
)
def abbrev_safe_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.abbreviation_safe_sentences(F.col("text")).alias("sentences"))


@query(f"SELECT id, {S.clean('text')} AS clean_text FROM raw_items")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").select("id", T.clean(F.col("text")).alias("clean_text"))


@query(f"SELECT id, {S.reason('text')} AS reason FROM raw_items")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return gate.with_rejection_reason(table(spark, d, "raw_items").select("id", "text")).select("id", "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {S.reason('text')} AS reason FROM raw_items WHERE NOT coalesce(protected, false)) WHERE reason IS NOT NULL GROUP BY reason")
def rejection_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return gate.reason_counts(table(spark, d, "raw_items").select("text", "protected"))


@query(f"SELECT sha256({S.normalized('text')}) AS hash, count(*) AS n, min(id) AS first_id FROM raw_items WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def normalized_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_items").filter("text IS NOT NULL").select("id", T.normalized_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"SELECT id, {S.content_words('text')} AS words FROM raw_items WHERE text IS NOT NULL")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter("text IS NOT NULL").select("id", T.content_words(F.col("text")).alias("words"))


@query(f"SELECT id, {S.shingles('w')} AS shingles FROM (SELECT id, {S.content_words('text')} AS w FROM raw_items WHERE text IS NOT NULL)")
def shingles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_items").filter("text IS NOT NULL").select("id", T.content_words(F.col("text")).alias("w"))
    return rows.select("id", T.shingles(F.col("w")).alias("shingles"))


@query(f"""SELECT id, {S.sub(S.clean('text'), '''([^.?!"'”’])(["'”’]*)$''', chr(92) + '1.' + chr(92) + '2')} AS text FROM raw_items""")
def terminal_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").select("id", T.terminal_punctuation(T.clean(F.col("text"))).alias("text"))


@query("SELECT id, regexp_matches(source_url, '^https?://[^/ ]+') AS ok, regexp_extract(source_url, '^https?://([^/:?# ]+)', 1) AS host FROM raw_items")
def url_validate(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("source_url")
    return table(spark, d, "raw_items").select("id", url.rlike("^https?://[^/ ]+").alias("ok"), F.regexp_extract(url, "^https?://([^/:?# ]+)", 1).alias("host"))


@query(
    f"""WITH h AS (SELECT DISTINCT sha256({S.normalized('text')}) AS h FROM sentences), c AS (SELECT h, count(*) OVER (PARTITION BY substr(h, 1, 16)) AS n FROM h)
SELECT 's_' || substr(h, 1, CASE WHEN n > 1 THEN 24 ELSE 16 END) AS stable_id, CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT) AS random_key FROM c"""
)
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the distinct texts, longer where two share a prefix, and their random keys."""
    from pyspark.sql import Window

    h = table(spark, d, "sentences").select(T.normalized_hash(F.col("text")).alias("h")).distinct()
    same = F.count("*").over(Window.partitionBy(F.substring("h", 1, 16)))
    stable = F.concat(F.lit("s_"), F.when(same > 1, F.substring("h", 1, 24)).otherwise(F.substring("h", 1, 16)))
    return h.select(stable.alias("stable_id"), T.random_key(F.col("h")).alias("random_key"))


@query("SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})\n', 1) AS dateline, CASE WHEN s IS NULL THEN 'unknown' WHEN s < DATE '2029-06-01' THEN 'early' WHEN s < DATE '2030-06-01' THEN 'middle' ELSE 'late' END AS licence FROM (SELECT doc_id, text, CAST(try_strptime(regexp_extract(text, '([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})\n', 1), '%B %d, %Y') AS DATE) AS s FROM documents WHERE doc_kind = 'news')")
def licence_by_dateline(spark: SparkSession, d: str) -> DataFrame:
    """News extracts with the licence that their dateline falls under: a lookup in a table of date ranges."""
    line = F.regexp_extract("text", "([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})\n", 1)
    when = F.try_to_timestamp(line, F.lit("MMMM d, yyyy")).cast("date")
    licence = F.when(when.isNull(), "unknown").when(when < F.lit("2029-06-01").cast("date"), "early").when(when < F.lit("2030-06-01").cast("date"), "middle").otherwise("late")
    return table(spark, d, "documents").filter("doc_kind = 'news'").select("doc_id", line.alias("dateline"), licence.alias("licence"))


@query(f"SELECT id, answer, CASE WHEN answer = lower({S.clean('text')}) THEN true ELSE false END AS correct FROM (SELECT id, text, lower({S.collapse(f'translate(text, {S.lit(T.QUOTES_FROM)}, {S.lit(T.QUOTES_TO)})')}) AS answer FROM sentences)")
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    """Normalised answers against the cleaned text."""
    rows = table(spark, d, "sentences").select("id", "text", T.normalize_answer(F.col("text")).alias("answer"))
    return rows.select("id", "answer", (F.col("answer") == T.normalized(F.col("text"))).alias("correct"))
