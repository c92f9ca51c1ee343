"""Queries for recall, review, translation checks, variants, the question store and learner progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import classify as C
from corpusloom.operators import progress as G
from corpusloom.operators import recall as R
from corpusloom.operators import review as V
from corpusloom.operators import store as Q
from corpusloom.operators import translate as L
from corpusloom.operators import variants as W
from corpusloom.tables import table

from . import sqltext as S
from .registry import query
from .selection_plans import _SQL_EVIDENCE, PROBE, _items

# recall


def _prototypes(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, d, "embeddings").withColumn("n", place).filter("n <= 3").drop("n")


_SQL_RECALL = """protos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3),
sims AS (SELECT p.label, e.vec_id, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS sim FROM embeddings e, protos p WHERE e.vec_id NOT IN (SELECT vec_id FROM protos) GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS place FROM sims)"""


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    p = _prototypes(spark, d)
    return R.vector_top_k(table(spark, d, "embeddings"), p, k, exclude=p.select("vec_id"))


@query(f"WITH {_SQL_RECALL} SELECT label, vec_id, CAST(place AS INT) AS rank FROM near WHERE place <= 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10).select("label", "vec_id", "rank")


@query(
    """WITH protos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 3),
sims AS (SELECT p.label, e.vec_id, max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) AS sim FROM embeddings e, protos p WHERE e.label <> p.label GROUP BY ALL)
SELECT label, vec_id, CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS place FROM sims) WHERE place <= 10"""
)
def semantic_topk_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of each label, without those that carry the label."""
    e = table(spark, d, "embeddings")
    return R.vector_top_k(e, _prototypes(spark, d), 10, exclude=e.select("label", "vec_id")).select("label", "vec_id", "rank")


@query(
    f"""WITH {_SQL_EVIDENCE}, trig AS (SELECT id, string_agg(DISTINCT term, '|' ORDER BY term) AS triggers, bool_or(kind = 'phrase') AS phrase FROM found WHERE scene = 'ride_tram' AND ((kind = 'keyword' AND term IN ('tram', 'station', 'timetable')) OR (kind = 'phrase' AND term = 'tram map')) GROUP BY id),
riv AS (SELECT id, scene, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, scene) AS n FROM scored WHERE scene <> 'ride_tram') WHERE n = 1)
SELECT p.id, r.scene AS competing_scene, t.triggers, round(CAST(CASE WHEN phrase THEN 0.75 ELSE 0.25 END AS DOUBLE) + least(s.score, 100) / 1000 - least(r.score, 100) / 100000, 6) AS confidence
FROM plain p JOIN trig t USING (id) JOIN scored s ON s.id = p.id AND s.scene = 'ride_tram' JOIN riv r ON r.id = p.id WHERE p.method = 'llm_required'"""
)
def lexical_conflicts(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    found = C.evidence(items, C.lexicon(spark, PROBE))
    plain = C.classify(items, C.lexicon(spark, PROBE), found=found)
    return R.lexical_conflicts(plain, C.scene_scores(found), found, "ride_tram", ["tram", "station", "timetable"], ["tram map"])


# review


@query(f"WITH {_SQL_RECALL}, s AS (SELECT vec_id AS item_id, label, sim FROM near WHERE place <= 40) SELECT item_id, arg_max(label, (sim, -label)) AS family, string_agg(label, ',' ORDER BY sim DESC, label) AS scenes, CAST(count(*) AS INT) AS n FROM s GROUP BY item_id")
def review_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _near(spark, d, 40).select(F.col("vec_id").alias("item_id"), F.col("label").alias("scene"), "similarity")
    return V.merge_suggestions(s).withColumn("scenes", F.array_join(F.transform("scenes", lambda x: x.cast("string")), ","))


@query("SELECT item_id, family, CAST(floor((row_number() OVER (PARTITION BY family ORDER BY item_id) - 1) / 100) AS INT) AS batch FROM (SELECT id AS item_id, source_name AS family FROM raw_items)")
def review_batches(spark: SparkSession, d: str) -> DataFrame:
    return V.batches(table(spark, d, "raw_items").select(F.col("id").alias("item_id"), F.col("source_name").alias("family")), 100)


@query(
    """WITH a AS (SELECT DISTINCT id AS item_id FROM candidates), r AS (SELECT item_id, count(*) AS n FROM rejections GROUP BY item_id)
SELECT item_id, CASE WHEN n IS NULL THEN 'missing' WHEN a.item_id IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM (SELECT item_id, true AS asked FROM a) a FULL JOIN r USING (item_id) WHERE n IS NULL OR asked IS NULL OR n > 1""".replace("a.item_id IS NULL", "asked IS NULL")
)
def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Requests (items of all runs) against results (rejections)."""
    asked = table(spark, d, "candidates").select(F.col("id").alias("item_id"))
    return V.coverage(asked, table(spark, d, "rejections"))


@query(
    """WITH dec AS (SELECT DISTINCT source_name, text, sub_scene AS scene FROM candidates WHERE confidence >= 0.8), live AS (SELECT source_name, text, count(*) AS matches, min(id) AS id FROM raw_items GROUP BY ALL),
m AS (SELECT d.scene, l.matches, l.id FROM dec d LEFT JOIN live l ON l.source_name IS NOT DISTINCT FROM d.source_name AND l.text IS NOT DISTINCT FROM d.text)
SELECT CASE WHEN matches IS NULL THEN 'unmatched' WHEN matches > 1 THEN 'ambiguous' WHEN m.id IN (SELECT item_id FROM rejections) THEN 'skipped_rejected' WHEN r.sub_scene IS NOT DISTINCT FROM m.scene THEN 'noop' WHEN r.sub_scene IS NOT NULL THEN 'conflict' ELSE 'applied' END AS outcome, count(*) AS n
FROM m LEFT JOIN raw_items r ON r.id = m.id GROUP BY 1"""
)
def replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of confident earlier decisions on the live items, matched by source and text."""
    decisions = table(spark, d, "candidates").filter("confidence >= 0.8").select("source_name", "text", F.col("sub_scene").alias("scene"))
    items = table(spark, d, "raw_items")
    done = V.replay(decisions, items, items.select("id", F.col("sub_scene").alias("scene")), table(spark, d, "rejections"), ["source_name", "text"])
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    """WITH dec AS (SELECT source_name, text, min(sub_scene) AS scene FROM candidates WHERE confidence >= 0.8 AND sub_scene IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sub_scene) = 1), live AS (SELECT source_name, text, min(id) AS id FROM raw_items GROUP BY ALL HAVING count(*) = 1),
new AS (SELECT l.id, d.scene FROM dec d JOIN live l ON l.source_name IS NOT DISTINCT FROM d.source_name AND l.text IS NOT DISTINCT FROM d.text WHERE l.id NOT IN (SELECT item_id FROM rejections WHERE item_id IS NOT NULL))
SELECT r.id, CASE WHEN r.sub_scene IS NULL AND n.id IS NOT NULL THEN n.scene ELSE r.sub_scene END AS scene, CASE WHEN r.sub_scene IS NULL AND n.id IS NOT NULL THEN 'review' ELSE 'source' END AS method FROM raw_items r LEFT JOIN new n USING (id)"""
)
def review_applied(spark: SparkSession, d: str) -> DataFrame:
    """The items' scenes after confident earlier decisions that agree have been applied."""
    confident = table(spark, d, "candidates").filter("confidence >= 0.8 AND sub_scene IS NOT NULL").select("source_name", "text", F.col("sub_scene").alias("scene"))
    agreed = confident.groupBy("source_name", "text").agg(F.min("scene").alias("scene"), F.countDistinct("scene").alias("ways")).filter("ways = 1").drop("ways")
    items = table(spark, d, "raw_items")
    now = items.select("id", F.col("sub_scene").alias("scene"), F.lit("source").alias("method"))
    done = V.replay(agreed, items, now, table(spark, d, "rejections"), ["source_name", "text"])
    return V.apply_decisions(now, done, {})[0]


@query("SELECT source_name, text, count(DISTINCT coalesce(sub_scene, chr(0))) AS ways FROM candidates GROUP BY ALL HAVING count(DISTINCT coalesce(sub_scene, chr(0))) > 1")
def replay_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("source_name", "text", F.col("sub_scene").alias("scene"))
    return V.conflicting_decisions(rows, ["source_name", "text"])


# translation


def _sql_currencies(x: str) -> str:
    m = lambda p, of=x: f"regexp_matches({of}, {S.lit(p)})"
    has = {k: m(p) for k, p in L.CURRENCIES.items()}
    has["GBP"] += f" AND ({m(L.EXPLICIT['GBP'])} OR NOT {m(L.WEIGHT)})"
    has["JPY"] += f" AND ({m(L.EXPLICIT['JPY'])} OR NOT {m(L.YEN_NAME, S.sub(x, 'Japanese +Yen', ''))})"
    has["EUR"] += f" AND NOT {m(L.EUR_NAME)}"
    has["CNY"] += f" OR {m(L.GENERIC_YUAN, S.sub(x, L.FOREIGN_YUAN, ''))}"
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in has.items()) + "], lambda c: c IS NOT NULL))"


def _sql_numbers(x: str) -> str:
    for pattern, to in L.NUMBER_RULES:
        x = S.sub(x, pattern, to.replace("$", "\\"))
    scale = " ".join(f"WHEN '{k}' THEN {n}" for k, n in L.SCALES.items())
    digits = "regexp_replace(regexp_extract(v, '^[0-9., ]+'), '[, ]', '', 'g')"
    product = f"CAST(CAST(TRY_CAST({digits} AS DECIMAL(27, 8)) * CAST(CASE lower(regexp_extract(v, '{L._SCALE}$')) {scale} ELSE 1 END AS DECIMAL(10, 0)) AS DECIMAL(38, 8)) AS VARCHAR)"
    value = f"CASE WHEN regexp_matches({digits}, '\\..*\\.') THEN 'version:' || {digits} ELSE coalesce(regexp_replace(regexp_replace({product}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), {digits}) END"
    return f"[{value} for v in flatten([string_split(w, ':') for w in regexp_extract_all({x}, {S.lit(L.NUMBER)})])]"


def _sql_issues() -> str:
    n = lambda c: f"translate(coalesce({c}, ''), {S.lit(L._WIDE)}, {S.lit(L._NARROW)})"
    m = lambda x, p: f"regexp_matches({x}, {S.lit(p)})"
    return f"""WITH a AS (SELECT id, {n('text')} AS s, trim({n('translation_zh')}) AS t FROM sentences), b AS (SELECT *, [lower(w) for w in regexp_extract_all(s, '{L.LATIN}')] AS known,
regexp_extract_all({S.sub(S.sub('t', L.URL, ''), L.CODE, '')}, '{L.LATIN}') AS lat, len(regexp_extract_all(t, {S.lit(L.HAN)})) AS han, length({S.sub('s', L.SPACE + '+', '')}) AS ls, length({S.sub('t', L.SPACE + '+', '')}) AS lt,
{_sql_numbers('s')} AS asked, {_sql_numbers('t')} AS got FROM a),
c AS (SELECT *, list_filter(lat, lambda w: NOT (list_contains(known, lower(w)) AND lower(w) <> w)) AS res FROM b), e AS (SELECT *, coalesce(list_sum([length(w) for w in res]), 0) AS latin FROM c)
SELECT id, CASE WHEN t = '' THEN 'empty_translation' ELSE array_to_string(list_filter([CASE WHEN han / greatest(han + latin, 1) < 0.35 THEN 'low_chinese_ratio' END,
CASE WHEN len(list_filter(asked, lambda k: len(list_filter(asked, lambda x: x = k)) > len(list_filter(got, lambda x: x = k)))) > 0 THEN 'number_mismatch' END, CASE WHEN {_sql_currencies('s')} <> {_sql_currencies('t')} THEN 'currency_mismatch' END,
CASE WHEN {m('s', L.PERCENT)} <> {m('t', L.PERCENT)} THEN 'percentage_mismatch' END, CASE WHEN len(res) >= 2 OR len(list_filter(res, lambda w: length(w) >= 8)) > 0 THEN 'english_residue' END,
CASE WHEN ls > 0 AND (lt < 0.12 * ls OR (lt > 3 * ls AND (ls >= 20 OR lt > 24))) THEN 'abnormal_length' END], lambda x: x IS NOT NULL), '|') END AS issues FROM e"""


@query(_sql_issues())
def translation_checks(spark: SparkSession, d: str) -> DataFrame:
    """The issues of every translation; none is an empty text."""
    rows = L.with_issues(table(spark, d, "sentences").select("id", "text", "translation_zh"))
    return rows.select("id", F.array_join("issues", "|").alias("issues"))


@query(f"SELECT * FROM ({_sql_issues()}) WHERE issues <> ''")
def translation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Translations that have issues."""
    return translation_checks(spark, d).filter("issues <> ''")


# variants


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sentences").select("id", T.clean(F.col("text")).alias("text"))


_SQL_OF_SENTENCES = f"SELECT id, max({S.clean('text')}) AS t FROM sentences GROUP BY id"


def sql_variants(texts: str = _SQL_OF_SENTENCES) -> str:
    """Variants of the texts of a query of (id, t)."""
    listed = lambda ws: ", ".join(map(S.lit, sorted(ws)))
    points = f"least({6 * W.UNIT}, {W.UNIT * 3 // 2} + length(w) * {W.UNIT * 17 // 100} + CASE WHEN regexp_matches(w, '({'|'.join(W.HARD_ENDINGS)})$') THEN {W.UNIT * 6 // 10} ELSE 0 END)"
    runs = "\nUNION ALL ".join(
        f"""SELECT id, i, n AS words, s, e, p // n + {W.UNIT * 14 // 10} + n * {W.UNIT * 55 // 100} + CASE WHEN known THEN {W.UNIT * 5 // 4} ELSE 0 END AS points, known FROM (
  SELECT id, i, {n} AS n, s, lead(e, {n - 1}) OVER w AS e, {' + '.join(f'lead(p, {k}) OVER w' for k in range(n))} AS p, {' AND '.join(f'lead(cont, {k}) OVER w' for k in range(1, n))} AS joined,
  {' AND '.join(f'lead(stop, {k}) OVER w' for k in range(n))} AS silent, stop AND w NOT IN ({listed(W.STARTERS)}) AS bad_start, lead(stop, {n - 1}) OVER w AS bad_end,
  concat_ws(' ', {', '.join(f'lead(w, {k}) OVER w' for k in range(n))}) IN ({listed(W.PHRASES | set(W.CONTRACTIONS))}) AS known FROM tok WINDOW w AS (PARTITION BY id ORDER BY i))
  WHERE joined AND NOT silent AND (known OR NOT (bad_start OR bad_end))""" for n in (2, 3, 4))
    picks = ", ".join(
        f"""left{i} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points, s, e) - 1 AS place, count(*) OVER (PARTITION BY id) AS n FROM {'span' if i == 1 else f'(SELECT x.* EXCLUDE (place, n) FROM left{i - 1} x JOIN pick{i - 1} y USING (id) WHERE x.said <> y.said)'}),
pick{i} AS (SELECT * FROM left{i} WHERE place = CAST(round_even((n - 1) * {share}, 0) AS INT))""" for i, (_, share) in enumerate(W.LEVELS, 1))
    return f"""WITH txt AS ({texts}), raw AS (SELECT id, t, regexp_extract_all(t, {S.lit(T.WORD)}) AS ws, string_split_regex(t, {S.lit(T.WORD)}) AS gs FROM txt),
ex AS (SELECT id, t, unnest(ws) AS w0, unnest(gs[1:len(ws)]) AS g, unnest(range(len(ws))) AS i FROM raw), pos AS (SELECT *, sum(length(w0) + length(g)) OVER (PARTITION BY id ORDER BY i) AS e, lower(w0) AS w FROM ex),
tok AS (SELECT id, t, i, w, e - length(w0) AS s, e, {points} AS p, w IN ({listed(W.STOP_WORDS)}) AS stop, regexp_matches(g, {S.lit(W.BETWEEN)}) AS cont FROM pos),
runs AS (SELECT id, i, 1 AS words, s, e, p AS points, false AS known FROM tok WHERE NOT stop AND length(w) >= 3 UNION ALL {runs}),
span AS (SELECT r.*, substr(t, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS answer, lower(answer) AS said, MAP {{{', '.join(f'{S.lit(k)}: {S.lit(v)}' for k, v in W.ALIASES.items())}}}[said] AS alias FROM runs r JOIN txt USING (id)),
{picks}, three AS (SELECT *, 1 AS k FROM pick1 UNION ALL BY NAME SELECT *, 2 AS k FROM pick2 UNION ALL BY NAME SELECT *, 3 AS k FROM pick3),
forced AS (SELECT id FROM three GROUP BY id HAVING count(*) = 3 AND count(alias) = 0), last AS (SELECT * FROM span WHERE alias IS NOT NULL AND id IN (FROM forced) QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, s DESC, e DESC) = 1),
chosen AS (SELECT * FROM three WHERE k < 3 OR id NOT IN (SELECT id FROM last) UNION ALL BY NAME SELECT * FROM last),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points, s, e) - 1 AS o, count(*) OVER (PARTITION BY id) AS c FROM chosen)
SELECT id, ['easy', 'medium', 'hard'][o + 1] AS difficulty, CAST(s AS INT) AS answer_start, CAST(e AS INT) AS answer_end, answer AS canonical_answer, words AS answer_word_count,
(max((points * 50 + 3) // 6 - o) OVER (PARTITION BY id ORDER BY o) + o) / 10000.0 AS difficulty_score, CASE WHEN known THEN 'set phrase' WHEN words = 1 THEN 'word' ELSE words || ' words' END AS rationale, coalesce(alias, '') AS alias FROM ordered WHERE c = 3"""


@query(sql_variants())
def variants(spark: SparkSession, d: str) -> DataFrame:
    """Three gaps of every sentence, one row each."""
    made = W.with_variants(_sentences(spark, d)).select("id", F.explode("variants").alias("v")).select("id", "v.*")
    return made.withColumn("alias", F.array_join("aliases", "|")).drop("aliases")


@query(f"WITH v AS ({sql_variants()}) SELECT difficulty, count(*) AS variants, count(*) FILTER (WHERE alias <> '') AS aliased, CAST(0 AS BIGINT) AS broken FROM v GROUP BY difficulty")
def variant_violations(spark: SparkSession, d: str) -> DataFrame:
    """Variants by difficulty, and how many of them are in a set that breaks a rule: none may."""
    texts = _sentences(spark, d)
    made = W.with_variants(texts)
    bad = W.violations(made, texts).select("id", F.lit(1).alias("bad"))
    each = made.join(bad, "id", "left").select(F.explode("variants").alias("v"), "bad")
    return each.groupBy("v.difficulty").agg(F.count("*").alias("variants"), F.count_if(F.size("v.aliases") > 0).alias("aliased"), F.count("bad").alias("broken"))


# store


@query("SELECT t.top_key, t.label, string_agg(s.scene_key, ',' ORDER BY s.sort_order, s.scene_key) AS scenes FROM top_scenes t JOIN sub_scenes s USING (top_key) GROUP BY t.top_key, t.label")
def scene_tree(spark: SparkSession, d: str) -> DataFrame:
    return Q.scene_tree(table(spark, d, "top_scenes"), table(spark, d, "sub_scenes")).withColumn("scenes", F.array_join("scenes", ","))


@query("SELECT id, sub_scene_key, random_key FROM sentences WHERE sub_scene_key IN ('ride_tram', 'ride_ferry', 'desk_memos') AND id <> 's_000be74a719d53ff' ORDER BY CAST(random_key < 4611686018427387904 AS INT), random_key, id LIMIT 30")
def circular_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty sentences of three scenes, from the middle of the key range on."""
    rows = table(spark, d, "sentences").select("id", "sub_scene_key", "random_key")
    return Q.circular_sample(rows, seed=1 << 62, limit=30, scenes=["ride_tram", "ride_ferry", "desk_memos"], exclude=["s_000be74a719d53ff"])


#: Identifiers of sentences, as an application asks for them; they are in the test tables of every size.
ASKED = ["s_000a291d1e2a4bee", "s_000937e70ad4d40a", "s_0008d78116ec02e0", "s_000828a0979d47b0", "s_00055836a43d5579", "s_000498320581cc7d", "s_00035bda05c9a367", "s_00028f47ab8c7c4b"]
ASKED += [*ASKED[:2], "s_missing"]


@query(f"SELECT CAST(position - 1 AS INT) AS position, id, text FROM (SELECT unnest({ASKED}) AS id, unnest(range(1, {len(ASKED)} + 1)) AS position) JOIN sentences USING (id)")
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by a list of ids, in its order, with repeated and unknown ids."""
    return Q.ordered_lookup(table(spark, d, "sentences").select("id", "text"), ASKED).select("position", "id", "text")


@query(
    f"""WITH v AS ({sql_variants()}) SELECT 'scene' AS dimension, scene_key AS key, count(s.id) AS n FROM sub_scenes d LEFT JOIN sentences s ON s.sub_scene_key = d.scene_key GROUP BY scene_key UNION ALL
SELECT 'licence', license_name, count(*) FROM sentences WHERE license_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source_name, count(*) FROM sentences WHERE source_name IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'difficulty', difficulty, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'words', CAST(answer_word_count AS VARCHAR), count(*) FROM v GROUP BY 2"""
)
def publish_reports(spark: SparkSession, d: str) -> DataFrame:
    """Published rows by scene, licence, source, difficulty and number of answer words."""
    s = table(spark, d, "sentences").select("id", F.col("sub_scene_key").alias("scene_key"), "license_name", "source_name")
    out = Q.distribution(s, "scene_key", table(spark, d, "sub_scenes"), "scene")
    for column, name in (("license_name", "licence"), ("source_name", "source")):
        out = out.unionByName(Q.distribution(s, column, s.filter(F.col(column).isNotNull()), name))
    v = W.with_variants(_sentences(spark, d)).select(F.explode("variants").alias("v")).select("v.difficulty", F.col("v.answer_word_count").cast("string").alias("words"))
    each = v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("key")) for c in ("difficulty", "words")])).alias("of"))
    return out.unionByName(each.select("of.*").groupBy("dimension", "key").agg(F.count("*").alias("n")))


_BLANK = {c: f"{S.sub(f"coalesce({c}, '')", T.SPACE, '')} = ''" for c in ("text", "translation_zh", "source_name", "license_name")}


@query(
    f"""SELECT id, CASE WHEN {_BLANK['text']} THEN 'text' WHEN {_BLANK['translation_zh']} THEN 'translation' WHEN {_BLANK['source_name']} OR {_BLANK['license_name']} THEN 'provenance'
WHEN NOT coalesce(source_url LIKE 'https://%', false) THEN 'url' WHEN random_key < 0 THEN 'random_key' END AS problem FROM sentences WHERE problem IS NOT NULL"""
)
def publish_problems(spark: SparkSession, d: str) -> DataFrame:
    return Q.publish_problems(table(spark, d, "sentences"))


@query("SELECT s.id AS own_id, coalesce(l.legacy_id, s.id) AS id FROM sentences s LEFT JOIN (SELECT normalized_hash, min(id) AS legacy_id FROM sentences WHERE random_key % 2 = 0 GROUP BY 1) l USING (normalized_hash)")
def legacy_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers kept from an earlier release, here the sentences with even keys."""
    s = table(spark, d, "sentences")
    rows = s.select(F.col("id").alias("own_id"), "id", "normalized_hash")
    return Q.legacy_ids(rows, s.filter("random_key % 2 = 0").select("id", "normalized_hash")).select("own_id", "id")


@query(f"SELECT count(*) AS texts, count(DISTINCT h) AS different, round(1 - count(DISTINCT h) / greatest(count(*), 1), 6) AS rate FROM (SELECT sha256({S.normalized('text')}) AS h FROM sentences)")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicate_rate(table(spark, d, "sentences").select(T.normalized_hash(F.col("text")).alias("hash")))


# progress

_ACTIONS = {"purchase": "correct", "error": "wrong", "click": "replay", "view": "view"}
_SQL_LOG = "log AS (SELECT user_id AS question, ts, event_id, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'wrong' WHEN 'click' THEN 'replay' WHEN 'view' THEN 'view' END AS action FROM events WHERE event_type <> 'signup')"
_SQL_FOLD = f"""{_SQL_LOG}, f AS (SELECT question, arg_min(action = 'correct', (ts, event_id)) FILTER (WHERE action IN ('correct', 'wrong', 'view')) AS first_correct, count(*) FILTER (WHERE action IN ('correct', 'wrong')) AS attempts,
count(*) FILTER (WHERE action = 'replay') AS replays, count(*) FILTER (WHERE action = 'view') AS views, min(ts) FILTER (WHERE action IN ('correct', 'wrong', 'view')) AS first_answered_at, max(ts) AS updated_at FROM log GROUP BY question)"""


def attempts(events: DataFrame) -> DataFrame:
    action = F.lit(None).cast("string")
    for event, name in _ACTIONS.items():
        action = F.when(F.col("event_type") == event, name).otherwise(action)
    return events.select(F.col("user_id").alias("question"), "ts", "event_id", action.alias("action")).filter("action IS NOT NULL")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return attempts(table(spark, d, "events"))


@query(f"WITH {_SQL_FOLD} SELECT question, first_correct, attempts, replays, views, CAST(first_answered_at AS VARCHAR) AS first_answered_at FROM f")
def progress_fold(spark: SparkSession, d: str) -> DataFrame:
    done = G.fold(_log(spark, d))
    return done.select("question", "first_correct", "attempts", "replays", "views", F.col("first_answered_at").cast("string").alias("first_answered_at"))


@query(f"WITH {_SQL_FOLD} SELECT count(*) FILTER (WHERE first_correct IS NOT NULL) AS practised, count(*) FILTER (WHERE NOT first_correct) AS pending, count(*) AS total FROM f")
def learning_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(G.fold(_log(spark, d)))


@query(f"WITH {_SQL_FOLD} SELECT question, CAST(CASE WHEN first_correct IS NULL THEN 3 WHEN NOT first_correct THEN 9 ELSE 0.25 END AS DOUBLE) AS weight FROM f")
def selection_weights(spark: SparkSession, d: str) -> DataFrame:
    return G.fold(_log(spark, d)).select("question", G.selection_weight(F.col("first_correct")).alias("weight"))


@query(
    f"""WITH {_SQL_LOG}, r AS (SELECT question, action = 'correct' AS ok, sum(CASE WHEN action = 'wrong' THEN 1 ELSE 0 END) OVER (PARTITION BY question ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM log WHERE action IN ('correct', 'wrong'))
SELECT question, coalesce(max(n), 0) AS longest FROM (SELECT question, island, count(*) FILTER (WHERE ok) AS n FROM r GROUP BY ALL) GROUP BY question"""
)
def longest_streaks(spark: SparkSession, d: str) -> DataFrame:
    return G.longest_streaks(_log(spark, d))


@query(
    f"""WITH {_SQL_LOG}, a AS (SELECT question, action = 'correct' AS ok, sum(CASE WHEN action = 'wrong' THEN 1 ELSE 0 END) OVER (PARTITION BY question ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM log WHERE action IN ('correct', 'wrong')),
g AS (SELECT question, island, count(*) FILTER (WHERE ok) AS n, count(*) AS c, count(*) FILTER (WHERE NOT ok) AS w FROM a GROUP BY ALL)
SELECT question, CAST(sum(c) AS BIGINT) AS completed, CAST(sum(w) AS BIGINT) AS wrong, round((sum(c) - sum(w)) * 100.0 / sum(c), 1) AS accuracy, max(n) AS longest, ['easy', 'medium', 'hard'][least(3, max(n) // 5 + 1)] AS highest FROM g GROUP BY question"""
)
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.session_stats(_log(spark, d))


@query(f"WITH {_SQL_LOG} SELECT question, event_id, coalesce(lag(action, 1) OVER w = action, false) OR coalesce(lag(action, 2) OVER w = action, false) OR coalesce(lag(action, 3) OVER w = action, false) AS repeats FROM log WINDOW w AS (PARTITION BY question ORDER BY ts, event_id)")
def recent_repeats(spark: SparkSession, d: str) -> DataFrame:
    return G.repeats_recent(_log(spark, d), "action").select("question", "event_id", "repeats")


@query("SELECT event_type AS mode, arg_max(event_id, (ts, event_id)) AS session_id FROM events WHERE value < 20 GROUP BY event_type")
def latest_open_session(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each type that counts as open, here those of a value under 20."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.col("event_type").alias("mode"), F.col("ts").alias("updated_at"), (F.col("value") >= 20).alias("completed"))
    return G.latest_open_session(rows)


@query(
    f"""WITH RECURSIVE {_SQL_LOG}, a AS (SELECT question, action = 'correct' AS ok, row_number() OVER (PARTITION BY question ORDER BY ts, event_id) AS i FROM log WHERE action IN ('correct', 'wrong') AND question IS NOT NULL),
walk(question, i, level, good, bad) AS (SELECT question, 1, 0, CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN 0 ELSE 1 END FROM a WHERE i = 1 UNION ALL
SELECT question, w.i + 1, CASE WHEN ok AND good = 4 THEN least(level + 1, 2) WHEN NOT ok AND bad = 4 THEN greatest(level - 1, 0) ELSE level END, CASE WHEN ok AND good < 4 THEN good + 1 ELSE 0 END, CASE WHEN NOT ok AND bad < 4 THEN bad + 1 ELSE 0 END
FROM walk w JOIN a USING (question) WHERE a.i = w.i + 1)
SELECT question, ['easy', 'medium', 'hard'][arg_max(level, i) + 1] AS level FROM walk GROUP BY question"""
)
def endless_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level each learner ends at."""
    return G.final_levels(_log(spark, d))


@query()
def weighted_questions(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions drawn by weight."""
    weights = G.fold(_log(spark, d)).select("question", G.selection_weight(F.col("first_correct")).alias("weight"))
    return G.weighted_pick(weights, 20, seed=7)
