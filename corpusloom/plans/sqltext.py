"""DuckDB SQL fragments that mirror the text expressions."""

from __future__ import annotations

from corpusloom.functions import text as T
from corpusloom.functions.names import _NARROW, _WIDE
from corpusloom.operators import gate


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescape(x: str) -> str:
    for entity, plain in T.ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(plain)})"
    return x


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({sub(x, T.SPACE + '+', ' ')})"


def clean(x: str) -> str:
    plain = sub(unescape(x), T.TAG, " ")
    return collapse(sub(f"translate({plain}, {lit(_WIDE + T.QUOTES_FROM)}, {lit(_NARROW + T.QUOTES_TO)})", T.INVISIBLE, ""))


def normalized(x: str) -> str:
    return f"lower({clean(x)})"


def words(cleaned: str, pattern: str = T.WORD) -> str:
    return f"regexp_extract_all({cleaned}, {lit(pattern)})"


def content_words(x: str) -> str:
    return f"list_filter({words(normalized(x), T.LOWER_WORD)}, lambda w: w NOT IN ({', '.join(map(lit, T.IGNORED_WORDS))}))"


def shingles(ws: str) -> str:
    runs = f"[array_to_string({ws}[i:i+2], ' ') for i in range(1, len({ws}) - 1)]"
    return f"(CASE WHEN len({ws}) >= 3 THEN {runs} WHEN len({ws}) > 0 THEN [array_to_string({ws}, ' ')] ELSE [] END)"


def sentences(x: str) -> str:
    marked = sub(collapse(x), r"""([.!?]["']?) (["']?[A-Z])""", "\\1" + T.MARK + "\\2")
    return f"list_filter(string_split({marked}, {lit(T.MARK)}), lambda s: s <> '')"


def reason(x: str) -> str:
    raw, c = collapse(sub(unescape(x), T.TAG, " ")), clean(x)
    n = f"len({words(c)})"
    safe = sub(c, gate.TITLES, "\\1")
    return f"""CASE WHEN {x} IS NULL THEN NULL
 WHEN regexp_matches({raw}, {lit(gate.SUBTITLE)}) THEN 'subtitle_metadata'
 WHEN regexp_matches({raw}, {lit(gate.STAGE_DIRECTION)}) THEN 'stage_direction'
 WHEN regexp_matches({raw}, {lit(gate.SPEAKER)}) THEN 'speaker_label'
 WHEN {n} < 5 THEN 'too_short' WHEN {n} > 35 THEN 'too_long'
 WHEN NOT regexp_matches({c}, {lit(gate.FINISHED)}) THEN 'incomplete'
 WHEN regexp_matches({c}, {lit(gate.SENSITIVE_PATTERN)}) THEN 'sensitive'
 WHEN length(regexp_replace({c}, '[^"]', '', 'g')) % 2 = 1 THEN 'unbalanced_quotes'
 WHEN regexp_matches({safe}, {lit(gate.TWO_SENTENCES)}) THEN 'multiple_sentences'
 WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) > length({c}) * 0.2 THEN 'mostly_numeric'
 WHEN len(list_distinct([lower(w) for w in {words(c)}])) < greatest(4, {n} // 3) THEN 'low_quality' END"""
