"""Queries for duplicates, classification and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import classify as C
from corpusloom.operators import dedupe as D
from corpusloom.operators import select as P
from corpusloom.tables import broadcast_if_small, cut_lineage, table

from . import sqltext as S
from .registry import query

#: A probe lexicon over words of the test tables; any (scene, kind, term) table can take its place.
PROBE = {
    "class_lecture": {"keyword": ["lesson", "sentence", "passage"], "phrase": ["second sentence"], "context": ["read", "hear", "depends"], "single": ["learners"]},
    "class_quiz": {"keyword": ["answer", "question", "missing"], "phrase": ["missing word"], "context": ["write", "down", "number"], "single": ["picture"]},
    "ride_ferry": {"keyword": ["harbour", "ferry", "storm"], "phrase": ["ferry ticket"], "context": ["walked", "road", "between"], "single": ["harbour"]},
    "ride_tram": {"keyword": ["tram", "station", "timetable"], "phrase": ["tram map", "last tram"], "context": ["drove", "back"], "single": ["station"]},
    "home_kitchen": {"keyword": ["bread", "knife", "teapot", "thermos"], "phrase": ["bread knife"], "context": ["recipe", "card"], "single": ["teapot"]},
    "body_dispensary": {"keyword": ["pharmacy", "prescription", "syrup"], "phrase": ["cough syrup"], "context": ["nurse", "clinic"], "single": ["prescription"]},
    "desk_memos": {"keyword": ["office", "notice", "contract", "invoice"], "phrase": ["court notice"], "context": ["wrote", "send", "forward"], "single": ["contract"]},
    "stage_choir": {"keyword": ["choir", "score", "rehearsal"], "phrase": ["choir score"], "context": ["sing", "heard", "only"], "blocked": ["points"], "single": ["rehearsal"]},
}
CATEGORIES = {"news": ["storm", "market", "court"], "study": ["lesson", "library", "thesi", "exam"], "travel": ["tram", "ferry", "station", "hostel"], "daily": ["bread", "supper", "family"]}


def distinct_texts(spark: SparkSession, d: str, hash_name: str) -> DataFrame:
    prints = D.fingerprints(table(spark, d, "raw_items").filter("text IS NOT NULL"), hash_name=hash_name)
    return prints.groupBy("hash").agg(F.min("id").alias("id"), F.min_by("words", "id").alias("words"), F.min_by("bands", "id").alias("bands"))


_SQL_TEXTS = f"""texts AS (SELECT min(id) AS id, any_value(w) AS w FROM (SELECT id, {S.normalized('text')} AS t, {S.content_words('text')} AS w FROM raw_items WHERE text IS NOT NULL) GROUP BY t),
sh AS (SELECT id, unnest({S.shingles('w')}) AS s FROM texts), hv AS (SELECT id, CAST('0x' || substr(sha256(s), 1, 16) AS UBIGINT) AS v FROM sh),
bits AS (SELECT id, b, 2 * sum(CAST((v >> b) & 1 AS INT)) >= count(*) AS one FROM hv CROSS JOIN range(64) r(b) GROUP BY id, b),
bands AS (SELECT id, CAST(b // 16 AS INT) AS band, CAST(sum(CASE WHEN one THEN 1 << CAST(b % 16 AS INT) ELSE 0 END) AS INT) AS value FROM bits GROUP BY id, b // 16)"""


@query(f"WITH {_SQL_TEXTS} SELECT id, list(value ORDER BY band) AS bands FROM bands GROUP BY id")
def simhash_bands(spark: SparkSession, d: str) -> DataFrame:
    return distinct_texts(spark, d, "sha256").filter(F.size("words") > 0).select("id", "bands")


@query(
    f"""WITH {_SQL_TEXTS}, p AS (SELECT DISTINCT l.id AS id_l, r.id AS id_r FROM bands l JOIN bands r USING (band, value) WHERE l.id < r.id)
SELECT id_l, id_r FROM p JOIN texts a ON a.id = id_l JOIN texts b ON b.id = id_r WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.76"""
)
def near_dup_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.near_edges(cut_lineage(distinct_texts(spark, d, "sha256")))  # fingerprints are made once


@query(
    f"""WITH RECURSIVE {_SQL_TEXTS}, p AS (SELECT DISTINCT l.id AS a, r.id AS b FROM bands l JOIN bands r USING (band, value) WHERE l.id <> r.id),
edge AS (SELECT p.a, p.b FROM p JOIN texts x ON x.id = p.a JOIN texts y ON y.id = p.b WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 0.76),
item AS (SELECT id, coalesce(protected, false) AS safe, min(id) OVER (PARTITION BY {S.normalized('text')}) AS t FROM raw_items WHERE text IS NOT NULL),
near AS (SELECT a AS t, list(b) AS ts FROM edge GROUP BY a), linked AS (SELECT i.*, n.ts, row_number() OVER (ORDER BY i.id) AS k FROM item i JOIN near n USING (t)),
walk(k, kept, id, exact_of, near_of, safe) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, t BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL
SELECT l.k, CASE WHEN l.safe OR (e IS NULL AND m IS NULL) THEN list_append(w.kept, {{'id': l.id, 't': l.t}}) ELSE w.kept END, l.id, e, m, l.safe FROM walk w JOIN linked l ON l.k = w.k + 1,
LATERAL (SELECT list_min([x.id for x in w.kept if x.t = l.t]) AS e, list_min([x.id for x in w.kept if list_contains(l.ts, x.t)]) AS m)),
done AS (SELECT id, safe, exact_of, near_of FROM walk WHERE id IS NOT NULL UNION ALL SELECT id, safe, CASE WHEN t < id THEN t END, NULL FROM item WHERE t NOT IN (SELECT t FROM near))
SELECT id, CASE WHEN safe THEN 'accepted' WHEN exact_of IS NOT NULL THEN 'exact_duplicate' WHEN near_of IS NOT NULL THEN 'near_duplicate' ELSE 'accepted' END AS decision, CASE WHEN NOT safe THEN coalesce(exact_of, near_of) END AS duplicate_of FROM done"""
)
def dedupe_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The greedy decision on every item."""
    return D.dedupe(table(spark, d, "raw_items").filter("text IS NOT NULL"), hash_name="sha256")


@query(f"SELECT s.id, min(r.id) AS base_id FROM (SELECT id, sha256({S.normalized('text')}) AS h FROM sentences WHERE random_key % 2 = 1) s JOIN (SELECT id, sha256({S.normalized('text')}) AS h FROM sentences WHERE random_key % 2 = 0) r USING (h) GROUP BY s.id")
def dedupe_against_base(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that an earlier release, here the sentences with even keys, has already."""
    s = table(spark, d, "sentences")
    return D.against_base(s.filter("random_key % 2 = 1"), s.filter("random_key % 2 = 0"))


_TERMS = ", ".join(f"('{s}', '{k}', '{t}')" for s, kinds in PROBE.items() for k, ts in kinds.items() for t in ts)
_CANON = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END"
_SQL_EVIDENCE = f"""lex AS (SELECT scene, kind, array_to_string([{_CANON} for w in string_split(term, ' ')], ' ') AS term FROM (VALUES {_TERMS}) v(scene, kind, term)),
tok AS (SELECT id, ' ' || array_to_string([{_CANON} for w in regexp_extract_all(lower(text), '[a-z]+')], ' ') || ' ' AS t FROM raw_items WHERE text IS NOT NULL),
found AS (SELECT DISTINCT id, scene, kind, term FROM tok JOIN lex ON contains(t, ' ' || term || ' ')),
scored AS (SELECT id, scene, count(*) FILTER (WHERE kind = 'keyword') AS keywords, count(*) FILTER (WHERE kind = 'phrase') AS phrases, CAST(2 * count(*) AS DOUBLE) AS score FROM found WHERE kind IN ('keyword', 'phrase') GROUP BY id, scene),
ranked AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS nxt FROM scored WINDOW w AS (PARTITION BY id ORDER BY score DESC, scene)),
best AS (SELECT r.id, scene, coalesce(score, 0) AS score, coalesce(score - nxt, 0) AS margin, (phrases > 0 OR keywords >= 2) AND score >= 2 AND score - nxt >= 0.75 AS ok FROM (SELECT id FROM raw_items WHERE text IS NOT NULL) r LEFT JOIN (SELECT * FROM ranked WHERE n = 1) USING (id)),
plain AS (SELECT id, CASE WHEN ok THEN scene END AS scene, round(CAST(least(1.0, (score + margin) / 6.0) AS DOUBLE), 6) AS confidence, CASE WHEN ok THEN 'keyword' ELSE 'llm_required' END AS method FROM best)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_items").filter("text IS NOT NULL")


@query(f"WITH {_SQL_EVIDENCE} SELECT id, scene, score FROM scored")
def scene_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.scene_scores(C.evidence(_items(spark, d), C.lexicon(spark, PROBE))).select("id", "scene", "score")


@query(f"WITH {_SQL_EVIDENCE} SELECT id, scene, kind, string_agg(term, '|' ORDER BY term) AS terms FROM found GROUP BY ALL")
def signal_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = C.evidence(_items(spark, d), C.lexicon(spark, PROBE))
    return found.groupBy("id", "scene", "kind").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"))


@query(f"WITH {_SQL_EVIDENCE} SELECT * FROM plain")
def scene_classify(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(_items(spark, d), C.lexicon(spark, PROBE)).withColumn("confidence", F.round("confidence", 6))


_SQL_CANDIDATES = f"""{_SQL_EVIDENCE},
ctx AS (SELECT id, scene, c FROM (SELECT *, row_number() OVER w AS n, coalesce(lead(c) OVER w, 0) AS nxt FROM (SELECT id, scene, count(*) AS c FROM found WHERE kind = 'context' GROUP BY ALL) WINDOW w AS (PARTITION BY id ORDER BY c DESC, scene)) WHERE n = 1 AND c >= 2 AND c > nxt),
sing AS (SELECT id, min(scene) AS scene FROM found WHERE kind = 'single' GROUP BY id HAVING count(*) = 1),
sole AS (SELECT s.id, s.scene FROM sing s WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.id = s.id AND b.scene = s.scene AND b.kind = 'blocked') AND NOT EXISTS (SELECT 1 FROM scored o WHERE o.id = s.id AND (o.scene <> s.scene OR o.phrases > 0))),
cand AS (SELECT r.id, CASE WHEN sub.top_key IS NOT NULL AND (r.top_scene IS NULL OR r.top_scene = sub.top_key) THEN 'source_explicit' WHEN coalesce(r.protected, false) THEN 'llm_required' WHEN p.method = 'keyword' THEN 'keyword'
 WHEN c.scene IS NOT NULL THEN 'context_keywords' WHEN r.source_name = 'Quarry Sentence Bank' THEN 'candidate_source' WHEN s.scene IS NOT NULL THEN 'single_keyword_whitelist' ELSE 'out_of_candidate_pool' END AS method,
 r.sub_scene, p.scene AS ps, p.confidence AS pc, c.scene AS cs, c.c, s.scene AS ss FROM raw_items r JOIN plain p USING (id) LEFT JOIN sub_scenes sub ON sub.scene_key = r.sub_scene LEFT JOIN ctx c USING (id) LEFT JOIN sole s USING (id))"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_candidates(_items(spark, d), C.lexicon(spark, PROBE), table(spark, d, "sub_scenes"), source_scenes={"Quarry Sentence Bank": "class_vocab"})


@query(
    f"""WITH {_SQL_CANDIDATES} SELECT id, CASE method WHEN 'source_explicit' THEN sub_scene WHEN 'keyword' THEN ps WHEN 'context_keywords' THEN cs WHEN 'candidate_source' THEN 'class_vocab' WHEN 'single_keyword_whitelist' THEN ss END AS scene,
round(CAST(CASE method WHEN 'source_explicit' THEN 1.0 WHEN 'context_keywords' THEN least(0.85, 0.5 + 0.05 * c) WHEN 'candidate_source' THEN 0.45 WHEN 'single_keyword_whitelist' THEN 0.51 ELSE pc END AS DOUBLE), 6) AS confidence, method FROM cand"""
)
def scene_classify_candidate(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_SQL_CANDIDATES} SELECT method, count(*) AS n FROM cand GROUP BY method")
def classification_methods(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("method").agg(F.count("*").alias("n"))


_HIT = {k: f"len(list_intersect(t, [{', '.join(repr(w) for w in ws)}]))" for k, ws in CATEGORIES.items()}


@query(
    f"""SELECT id, CASE {' '.join(f"WHEN {h} = greatest({', '.join(_HIT.values())}) THEN '{k}'" for k, h in _HIT.items())} END AS category
FROM (SELECT id, [{_CANON} for w in regexp_extract_all(lower(text), '[a-z]+')] AS t FROM raw_items WHERE text IS NOT NULL)"""
)
def category_classify(spark: SparkSession, d: str) -> DataFrame:
    return C.categories(_items(spark, d), CATEGORIES)


# selection


def selection_pool(spark: SparkSession, d: str) -> DataFrame:
    """One row per known scene and item among the candidates, with the scene's quota."""
    dims = table(spark, d, "sub_scenes").filter("quota > 0").select(F.col("scene_key").alias("sub_scene"), F.col("top_key").alias("top_scene"), F.col("quota").cast("bigint").alias("quota"))
    score = F.when(F.isnan("confidence") | F.col("confidence").isNull(), 0.0).otherwise(F.col("confidence"))
    author = T.collapse(F.coalesce("source_author", F.lit("")))
    author = F.when(author == "\\N", "").otherwise(author)
    rows = table(spark, d, "candidates").join(broadcast_if_small(dims), ["sub_scene", "top_scene"]).select(
        F.col("sub_scene").alias("scene"), "id", "run_id", F.coalesce("source_name", F.lit("")).alias("source_name"), author.alias("source_author"),
        score.alias("confidence"), F.coalesce("protected", F.lit(False)).alias("protected"), F.coalesce("tie_hash", F.lit("")).alias("tie_hash"), "quota")
    w = Window.partitionBy("scene", "id").orderBy(F.desc("confidence"), "run_id", "source_name", "source_author")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "run_id")


_SQL_AUTHOR = f"replace({S.collapse("coalesce(source_author, '')")}, '\\N', '')"
_SQL_POOL = f"""pool AS (SELECT scene, id, source_name, source_author, confidence, protected, tie_hash, quota, greatest(1, CAST(floor(quota * 0.45) AS BIGINT)) AS sl, greatest(1, CAST(floor(quota * 0.08) AS BIGINT)) AS al,
 CASE WHEN trim(source_author) = '' THEN 'blank:' || id ELSE 'author:' || source_author END AS ak FROM (
 SELECT *, row_number() OVER (PARTITION BY scene, id ORDER BY confidence DESC, run_id, source_name, source_author) AS n FROM (
 SELECT c.sub_scene AS scene, c.id, c.run_id, coalesce(source_name, '') AS source_name, {_SQL_AUTHOR} AS source_author, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END AS confidence,
 coalesce(protected, false) AS protected, coalesce(tie_hash, '') AS tie_hash, CAST(quota AS BIGINT) AS quota FROM candidates c JOIN sub_scenes s ON s.scene_key = c.sub_scene AND s.top_key = c.top_scene WHERE s.quota > 0)) WHERE n = 1)"""


@query(
    f"""WITH {_SQL_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY scene, source_name ORDER BY confidence DESC, id) AS sr, row_number() OVER (PARTITION BY scene, ak ORDER BY confidence DESC, id) AS ar, count(*) FILTER (WHERE protected) OVER (PARTITION BY scene) AS np FROM pool),
k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY protected DESC, confidence DESC, id) AS place FROM r WHERE protected OR (sr <= 2 * sl AND ar <= 2 * al)) SELECT scene, id, CAST(sr AS INT) AS source_rank, CAST(ar AS INT) AS author_rank FROM k WHERE place <= np + quota * 16"""
)
def selection_candidates_bounded(spark: SparkSession, d: str) -> DataFrame:
    return P.bounded_candidates(selection_pool(spark, d)).select("scene", "id", "source_rank", "author_rank")


_O = "ORDER BY confidence DESC, tie_hash, CAST(id AS VARCHAR)"
_SQL_KERNEL = f"""{_SQL_POOL}, a AS (SELECT *, row_number() OVER (PARTITION BY scene {_O}) - 1 AS selection_rank, row_number() OVER (PARTITION BY scene, source_name, ak {_O}) AS pr FROM pool WHERE NOT protected),
b AS (SELECT *, row_number() OVER (PARTITION BY scene, source_name {_O}) AS sr FROM a WHERE pr <= CASE WHEN starts_with(ak, 'blank:') THEN sl ELSE least(sl, al) END),
c AS (SELECT *, row_number() OVER (PARTITION BY scene, ak {_O}) AS ar FROM b WHERE sr <= quota + sl),
e AS (SELECT *, row_number() OVER (PARTITION BY scene {_O}) AS gr FROM c WHERE starts_with(ak, 'blank:') OR ar <= quota + al),
kernel AS (SELECT scene, id, CAST(NULL AS INT) AS selection_rank FROM pool WHERE protected UNION ALL SELECT scene, id, CAST(selection_rank AS INT) FROM e WHERE gr <= quota + (quota // sl) * (quota + sl) + (quota // al) * (quota + al))"""


@query(f"WITH {_SQL_KERNEL} SELECT * FROM kernel")
def selection_kernel(spark: SparkSession, d: str) -> DataFrame:
    return P.kernel(selection_pool(spark, d)).select("scene", "id", "selection_rank")


@query()
def selection_flow(spark: SparkSession, d: str) -> DataFrame:
    """The selection of every scene; tested against all subsets on small inputs."""
    return P.select_quotas(selection_pool(spark, d))


@query()
def selection_flow_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many scenes, sources and authors exceed what the rules allow them in the selection, protected rows aside: none."""
    pool = selection_pool(spark, d)
    rows = P.select_quotas(pool).select("scene", "id").join(pool, ["scene", "id"]).withColumns(P.limits(F.col("quota")))
    n = F.count("*").alias("n")
    free = F.count_if(~F.col("protected")).alias("free")
    scenes = rows.groupBy("scene", "quota").agg(n).agg(F.count_if(F.col("n") > F.col("quota")).alias("broken")).select(F.lit("over_quota").alias("rule"), "broken")
    sources = rows.groupBy("scene", "source_name", "source_limit").agg(n, free).agg(F.count_if((F.col("n") > F.col("source_limit")) & (F.col("free") > 0)).alias("broken")).select(F.lit("over_source").alias("rule"), "broken")
    named = rows.withColumn("author", F.trim("source_author")).filter("author <> ''")
    authors = named.groupBy("scene", "author", "author_limit").agg(n, free).agg(F.count_if((F.col("n") > F.col("author_limit")) & (F.col("free") > 0)).alias("broken")).select(F.lit("over_author").alias("rule"), "broken")
    return scenes.unionByName(sources).unionByName(authors)


def _largest(key: str, where: str = "true") -> str:
    return f"(SELECT scene, {key} AS who, n FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n DESC, {key}) AS p FROM (SELECT scene, {key}, count(*) AS n FROM pool WHERE {where} GROUP BY ALL)) WHERE p = 1)"


@query(
    f"""WITH {_SQL_POOL} SELECT t.scene, total, s.who AS max_source, s.n AS max_source_count, coalesce(a.who, '') AS max_author, coalesce(a.n, 0) AS max_author_count, round(s.n / total, 6) AS max_source_share, round(coalesce(a.n, 0) / total, 6) AS max_author_share
FROM (SELECT scene, count(*) AS total FROM pool GROUP BY scene) t JOIN {_largest('source_name')} s USING (scene) LEFT JOIN {_largest('source_author', "trim(source_author) <> ''")} a USING (scene)"""
)
def concentration_report(spark: SparkSession, d: str) -> DataFrame:
    return P.concentration(selection_pool(spark, d))


@query(
    f"""WITH {_SQL_POOL}, f AS (SELECT *, trim(source_author) AS au FROM pool WHERE protected),
s AS (SELECT scene, 'source' AS kind, source_name AS name, count(*) AS n, sl AS allowed FROM f GROUP BY ALL HAVING count(*) > sl), a AS (SELECT scene, 'author' AS kind, au AS name, count(*) AS n, al AS allowed FROM f WHERE au <> '' GROUP BY ALL HAVING count(*) > al)
SELECT scene, 'quota' AS kind, '' AS name, count(*) AS n, quota AS allowed FROM f GROUP BY scene, quota HAVING count(*) > quota UNION ALL
SELECT scene, kind, name, n, allowed FROM (SELECT *, row_number() OVER (PARTITION BY scene, kind ORDER BY n DESC, name) AS p FROM (SELECT * FROM s UNION ALL SELECT * FROM a)) WHERE p <= 8"""
)
def protected_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return P.protected_conflicts(selection_pool(spark, d))


@query(
    f"""WITH {_SQL_POOL}, x AS (SELECT * FROM pool WHERE confidence >= 0.9), t AS (SELECT scene, greatest(1, CAST(floor(count(*) * 0.02) AS BIGINT)) AS allowed FROM x GROUP BY scene)
SELECT scene, author, n, allowed FROM (SELECT scene, trim(source_author) AS author, count(*) AS n FROM x WHERE trim(source_author) <> '' GROUP BY ALL) JOIN t USING (scene) WHERE n > allowed"""
)
def author_share_gate(spark: SparkSession, d: str) -> DataFrame:
    """Authors with more than a fiftieth of a scene's best candidates; the published limit of 8 % is broken by none here."""
    return P.author_share_violations(selection_pool(spark, d).filter("confidence >= 0.9"), share=0.02)


@query(
    f"""SELECT category, id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hash, id) AS place FROM (SELECT sub_scene AS category, id, sha256({S.normalized('text')}) AS hash FROM raw_items WHERE sub_scene IS NOT NULL AND text IS NOT NULL)) WHERE place <= 40"""
)
def balanced_reservoir(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_items").filter("sub_scene IS NOT NULL AND text IS NOT NULL").select(F.col("sub_scene").alias("category"), "id", T.normalized_hash(F.col("text")).alias("hash"))
    return P.balanced_reservoir(rows, quota=5).select("category", "id", "place")
