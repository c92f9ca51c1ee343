"""Rule classification of sentences into scenes, with evidence.

A lexicon is a table (scene, kind, term): ``keyword`` and ``phrase`` are strong signals worth two points each,
``context`` words are weak, ``single`` words suffice alone if nothing else speaks, ``blocked`` phrases forbid that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import broadcast_if_small


def lexicon(spark: SparkSession, scenes: dict[str, dict[str, list[str]]]) -> DataFrame:
    rows = [(scene, kind, term) for scene, kinds in scenes.items() for kind, terms in kinds.items() for term in terms]
    return spark.createDataFrame(rows, "scene string, kind string, term string")


def _canonical(terms: DataFrame) -> DataFrame:
    words = F.transform(F.split(F.lower("term"), " +"), T.canonical_word)
    return terms.select("scene", "kind", F.array_join(words, " ").alias("term"), F.size(words).alias("width")).distinct()


def _runs(tokens: Column, width: int) -> Column:
    """Runs of ``width`` tokens, each joined by spaces."""
    joined = F.transform(F.sequence(F.lit(1), F.size(tokens) - width + 1), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(F.size(tokens) >= width, joined).otherwise(F.array().cast("array<string>"))


def evidence(items: DataFrame, terms: DataFrame, *, text: str = "text") -> DataFrame:
    """(id, scene, kind, term): every lexicon entry that a text holds.

    Texts are turned into their distinct runs of one to four canonical words, which meet the lexicon in an equality
    join; no text is compared with terms it does not hold.
    """
    known = broadcast_if_small(_canonical(terms))
    widths = [r["width"] for r in known.select("width").distinct().collect()] or [1]
    tokens = items.select("id", T.canonical_tokens(F.col(text)).alias("t"))
    runs = [_runs(F.col("t"), w) for w in sorted(widths)]
    each = tokens.select("id", F.explode(F.array_distinct(F.concat(*runs))).alias("term"))
    return each.join(known, "term").select("id", "scene", "kind", "term")


def scene_scores(found: DataFrame) -> DataFrame:
    """(id, scene, score, keywords, phrases) of every scene with a strong signal."""
    strong = found.filter(F.col("kind").isin("keyword", "phrase")).groupBy("id", "scene").agg(
        F.count_if(F.col("kind") == "keyword").alias("keywords"), F.count_if(F.col("kind") == "phrase").alias("phrases"))
    return strong.withColumn("score", 2.0 * (F.col("keywords") + F.col("phrases")))


def signals(found: DataFrame) -> DataFrame:
    """(id, strong, context, single): what a text's evidence says, from one aggregation by text.

    ``strong`` lists the scenes with keywords or phrases, best first, as (minus score, scene, keywords, phrases); ``context``
    those with context words, most first, as (minus count, scene); ``single`` is the scene of the only sufficient word, if
    there is just one and no blocked or strong evidence speaks against it. A text's list is bounded by the lexicon.
    """
    lists = found.groupBy("id").agg(F.collect_list(F.struct("scene", "kind")).alias("_f"))
    n = lambda scene, kind: F.size(F.filter("_f", lambda x: (x["scene"] == scene) & (x["kind"] == kind)))
    scenes = F.array_distinct(F.transform("_f", lambda x: x["scene"]))
    counted = lists.withColumn("_s", F.transform(scenes, lambda c: F.struct(c.alias("scene"), *(n(c, k).alias(k) for k in ("keyword", "phrase", "context", "single", "blocked")))))
    strong = F.transform(F.filter("_s", lambda x: x["keyword"] + x["phrase"] > 0), lambda x: F.struct((-2.0 * (x["keyword"] + x["phrase"])).alias("minus"), x["scene"], x["keyword"], x["phrase"]))
    context = F.transform(F.filter("_s", lambda x: x["context"] > 0), lambda x: F.struct((-x["context"]).alias("minus"), x["scene"]))
    sole = F.filter("_s", lambda x: x["single"] > 0)
    counted = counted.select("id", F.sort_array(strong).alias("strong"), F.sort_array(context).alias("context"), F.when((F.size(sole) == 1) & (F.get(sole, F.lit(0))["single"] == 1) & (F.get(sole, F.lit(0))["blocked"] == 0), F.get(sole, F.lit(0))["scene"]).alias("_sole"))
    against = F.exists("strong", lambda x: (x["scene"] != F.col("_sole")) | (x["phrase"] > 0))
    return counted.select("id", "strong", "context", F.when(~against, F.col("_sole")).alias("single"))


def _keyword_class(rows: DataFrame) -> DataFrame:
    """``rows`` with ``k_scene`` and ``k_conf`` by their strong evidence: the best scene is qualified by two keywords or a
    phrase and a lead of 0.75. Ties go to the smaller scene key."""
    rows = rows.withColumns({"_best": F.try_element_at("strong", F.lit(1)), "_next": F.try_element_at("strong", F.lit(2))})
    score = -F.coalesce(F.col("_best.minus"), F.lit(0.0))
    rows = rows.withColumns({"_score": score, "_margin": score + F.coalesce(F.col("_next.minus"), F.lit(0.0))})
    qualified = F.coalesce((F.col("_best.phrase") > 0) | (F.col("_best.keyword") >= 2), F.lit(False)) & (F.col("_score") >= 2) & (F.col("_margin") >= 0.75)
    confidence = F.least(F.lit(1.0), (F.col("_score") + F.col("_margin")) / 6.0)
    return rows.withColumns({"k_scene": F.when(qualified, F.col("_best.scene")), "k_conf": confidence})


def classify(items: DataFrame, terms: DataFrame, *, text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(id, scene, confidence, method): ``keyword`` if strong evidence qualifies a scene, else ``llm_required``."""
    of = signals(found if found is not None else evidence(items, terms, text=text))
    rows = _keyword_class(items.select("id").join(of, "id", "left"))
    method = F.when(F.col("k_scene").isNotNull(), "keyword").otherwise("llm_required")
    return rows.select("id", F.col("k_scene").alias("scene"), F.col("k_conf").alias("confidence"), method.alias("method"))


def classify_candidates(items: DataFrame, terms: DataFrame, scenes: DataFrame, *, text: str = "text", source_scenes: dict[str, str] | None = None) -> DataFrame:
    """(id, scene, confidence, method) with all fallbacks, in order: a consistent scene given by the source, protected
    items left to review, keywords, context words, the source's default scene, a single sufficient word.

    ``items`` has id, text, source_name, top_scene, sub_scene, protected; ``scenes`` has scene_key and top_key.
    """
    given = broadcast_if_small(scenes.select(F.col("scene_key").alias("sub_scene"), F.col("top_key").alias("g_top")))
    every = items.select("id", "source_name", "top_scene", "sub_scene", "protected").join(given, "sub_scene", "left")
    every = _keyword_class(every.join(signals(evidence(items, terms, text=text)), "id", "left"))
    first, second = F.try_element_at("context", F.lit(1)), F.try_element_at("context", F.lit(2))
    every = every.withColumns({"_c": first, "_c2": F.coalesce(second["minus"], F.lit(0))})
    clear = (F.col("_c.minus") <= -2) & (F.col("_c.minus") < F.col("_c2"))
    every = every.withColumns({"c_scene": F.when(clear, F.col("_c.scene")), "c_conf": F.least(F.lit(0.85), 0.5 - 0.05 * F.col("_c.minus"))})
    default = F.lit(None).cast("string")
    for source, scene in (source_scenes or {}).items():
        default = F.when(F.col("source_name") == source, scene).otherwise(default)
    every = every.withColumn("d_scene", default)
    explicit = F.col("g_top").isNotNull() & (F.col("top_scene").isNull() | (F.col("top_scene") == F.col("g_top")))
    cases = [
        (explicit, F.col("sub_scene"), F.lit(1.0), "source_explicit"),
        (F.coalesce("protected", F.lit(False)), F.lit(None), F.col("k_conf"), "llm_required"),
        (F.col("k_scene").isNotNull(), F.col("k_scene"), F.col("k_conf"), "keyword"),
        (F.col("c_scene").isNotNull(), F.col("c_scene"), F.col("c_conf"), "context_keywords"),
        (F.col("d_scene").isNotNull(), F.col("d_scene"), F.lit(0.45), "candidate_source"),
        (F.col("single").isNotNull(), F.col("single"), F.lit(0.51), "single_keyword_whitelist"),
    ]
    scene = confidence = method = None
    for condition, s, c, m in cases:
        scene = F.when(condition, s) if scene is None else scene.when(condition, s)
        confidence = F.when(condition, c) if confidence is None else confidence.when(condition, c)
        method = F.when(condition, m) if method is None else method.when(condition, m)
    return every.select("id", scene.alias("scene"), confidence.otherwise(F.col("k_conf")).alias("confidence"), method.otherwise("out_of_candidate_pool").alias("method"))


def categories(items: DataFrame, words: dict[str, list[str]], *, text: str = "text") -> DataFrame:
    """(id, category): the category with most of its words in the text; ties and none go to the first listed."""
    tokens = items.select("id", F.array_distinct(T.canonical_tokens(F.col(text))).alias("t"))
    hits = [F.size(F.array_intersect("t", F.array(*[F.lit(x) for x in ws]))) for ws in words.values()]
    best = F.greatest(*hits)
    pick = F.lit(None).cast("string")
    for name, hit in reversed(list(zip(words, hits))):
        pick = F.when(hit == best, name).otherwise(pick)
    return tokens.select("id", pick.alias("category"))
