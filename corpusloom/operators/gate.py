"""The quality gate: an ordered cascade of reasons to reject a sentence, the first that holds counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: The words that make a text unfit for learners.
SENSITIVE = (
    "porn|suicide|self-harm|terrorism|terrorist|rape|murder|abuse|war|weapon|dying|attack(?:ed|ing|s)?|kill(?:ed|ing|s)?|violent|violence|"
    "air strike|racial slur|explicit sex|graphic violence|fuck(?:ed|ing|er|s)?|motherfucker|shit(?:ty)?|cunt|kill(?:ed|ing)? +(?:my|your|him|her|them)self"
)
SENSITIVE_PATTERN = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{SENSITIVE})(?:$|[^A-Za-z0-9_])"
#: Lines that are no sentences, titles that end in a point, and where a second sentence begins.
SUBTITLE = r"^\d{1,2}:\d{2}:\d{2}(?:[,.]\d{3})?\s*-->\s*\d{1,2}:\d{2}:\d{2}(?:[,.]\d{3})?$"
STAGE_DIRECTION = r"^(?:\[[^\]]+\]|\([^\)]+\))$"
SPEAKER = r"^(?i:SPEAKER|SPK|PERSON)\s*\d*:"
TITLES = r"(?i)(^|[^A-Za-z0-9_])(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St)\."
TWO_SENTENCES = r"""[.!?]["']? +["']?[A-Z]"""
FINISHED = r"""[.!?]["']?$"""


def with_rejection_reason(items: DataFrame, text: str = "text", *, least: int = 5, most: int = 35) -> DataFrame:
    """``items`` with ``reason``, the first reason to reject a text, or null, and ``clean_text``.

    A null text has neither. Cleaning and words are columns of their own, so that each is computed once a row rather
    than in every branch of the cascade.
    """
    raw = T.collapse(F.regexp_replace(T.unescape(F.col(text)), T.TAG, " "))
    rows = items.withColumns({"_raw": raw, "clean_text": T.clean(F.col(text))})
    rows = rows.withColumn("_words", T.all_words(F.col("clean_text")))
    cleaned, words = F.col("clean_text"), F.col("_words")
    n = F.size(words)
    different = F.size(F.array_distinct(F.transform(words, F.lower)))
    digits = F.length(F.regexp_replace(cleaned, "[^0-9]", ""))
    quotes = F.length(F.regexp_replace(cleaned, '[^"]', ""))
    reason = (
        F.when(F.col(text).isNull(), None)
        .when(F.col("_raw").rlike(SUBTITLE), "subtitle_metadata")
        .when(F.col("_raw").rlike(STAGE_DIRECTION), "stage_direction")
        .when(F.col("_raw").rlike(SPEAKER), "speaker_label")
        .when(n < least, "too_short")
        .when(n > most, "too_long")
        .when(~cleaned.rlike(FINISHED), "incomplete")
        .when(cleaned.rlike(SENSITIVE_PATTERN), "sensitive")
        .when(quotes % 2 == 1, "unbalanced_quotes")
        .when(F.regexp_replace(cleaned, TITLES, "$1").rlike(TWO_SENTENCES), "multiple_sentences")
        .when(digits > F.length(cleaned) * 0.2, "mostly_numeric")
        .when(different < F.greatest(F.lit(4), F.floor(n / 3)), "low_quality")
    )
    return rows.withColumn("reason", reason).drop("_raw", "_words")


def clean_stage(items: DataFrame, *, text: str = "text", protected: str = "protected") -> tuple[DataFrame, DataFrame]:
    """(accepted with ``clean_text``, rejected with ``reason``). Protected items pass whatever their text."""
    spared = F.coalesce(F.col(protected), F.lit(False))
    judged = with_rejection_reason(items, text).withColumn("reason", F.when(~spared, F.col("reason")))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).drop("clean_text")


def reason_counts(items: DataFrame, *, text: str = "text", protected: str = "protected") -> DataFrame:
    """(reason, n) over the unprotected items. Nulls go after the aggregation, by its output: a filter on the key would
    be pushed below the cascade and compute it twice."""
    judged = with_rejection_reason(items.filter(~F.coalesce(F.col(protected), F.lit(False))), text)
    n = judged.groupBy(F.col("reason").alias("_key")).agg(F.max("reason").alias("reason"), F.count("*").alias("n"))
    return n.filter(F.col("reason").isNotNull()).select("reason", "n")
