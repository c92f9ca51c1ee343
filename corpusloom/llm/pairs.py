"""Broken prompt and response pairs: each defective pair with its type of defect.

Tokens of prompt and response are aligned. A response whose tokens are contained, by shingles and in order (longest
common subsequence), in the prompt and cover it is a copy; one whose parts (apology, speaker, inability, act, object) align
with a refusal template and explain nearly all of it is a refusal; one whose tokens outside the prompt are of another script
or language is in the wrong language. Whether a response in the right language stops early is decided by how it ends: names
are masked to their shape, and the last segments must be an ending that the corpus also shows before final punctuation.
Masks and endings are learned from all rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.pytext import _DROP, words
from corpusloom.tables import broadcast_if_small, cut_lineage

#: Most endings that are broadcast; more are joined by shuffle, with the same result.
MOST_ENDINGS = 200_000

# Parts of refusals: ways to apologise, the one who speaks, that something cannot be done, that it is declined, what cannot
# be done, and to what. Words are written as they are compared, without apostrophes; scripts without word gaps go by
# substring. They are general vocabulary of declining, no sentences.
APOLOGY = (
    "im sorry|i am sorry|sorry|apologies|apologi[sz]e|unfortunately|regrettably|regret|forgive me|pardon|im afraid|i am afraid|excuse me",
    "désolée?|navrée?|regrette|malheureusement|excuses|pardon|tut mir leid|leider|entschuldigung|entschuldigen|verzeihung|bedauere?|lo siento|siento|lamento|disculp[ae]n?|perdón|lamentablemente|desculpe|infelizmente|mi dispiace|purtroppo|scusa|извините|простите|к сожалению|сожалею",
    "抱歉|对不起|遗憾|不好意思|谅解|见谅|原谅|请理解|恕我?|歉意|申し訳|すみません|ごめん|残念|죄송|미안|유감|안타깝",
)
SPEAKER = (
    "i|we|as an?|assistant|language model|model|ai|translator|je|nous|en tant que|ich|wir|als|yo|como|eu|я|мы",
    "我们|我|本人|助手|模型|人工智能|机器人|作为|私|저는|제가",
)
INABILITY = (
    "cannot|cant|can not|could not|couldnt|unable|not able|wont|will not|would not|wouldnt|rather not|am not|im not|not going|not allowed|not permitted|not possible|not comfortable|not in a position|impossible|beyond|outside|against|no translation|do not|dont",
    "ne peux pas|ne peut pas|ne pouvons pas|ne suis pas|impossible|incapable|ne souhaite pas|kann|können|nicht|nicht möglich|unmöglich|außerstande|no puedo|no podemos|no poder|no se puede|no es posible|no me es posible|no estoy|imposible|incapaz|não posso|não consigo|non posso|non riesco|не могу|не можем|невозможно",
    "无法|不能|不会|没办法|没法|不便|不方便|不可以|难以|未能|不予|不愿|不适合|不支持|不提供|超出|无权|做不到|不了|できません|できかね|いたしかね|しかねます|できない|수 없|없습니다|못합니다|불가|어렵습니다",
)
DECLINING = (
    "declin(?:e|es|ed|ing)|refus(?:e|es|ed|ing|al)|refusons|décliner|refuser|ablehnen|lehne|verweigere|me niego|negarme|rechazar|recuso|rifiuto|отказываюсь",
    "拒绝|谢绝|婉拒|お断り|거절",
)
ACT = (
    "translat(?:e|ed|ing|ions?)|render(?:ed|ing)?|help(?:ing)?|assist(?:ance|ing)?|provid(?:e|ed|ing)|offer(?:ed|ing)?|give|comply|process(?:ed|ing)?|complet(?:e|ed|ing)|fulfill?(?:ed)?|answer(?:ed|ing)?|respond|handled?|produced?|tradui(?:re|s)|traduction|aider|répondre|fournir|traiter|übersetzen|übersetzung|helfen|beantworten|bearbeiten|bereitstellen",
    "traduc(?:ir|irlo|irla|ción)|ayudar(?:te|le|lo)?|responder|proporcionar|ofrecer|procesar|tradu[zç](?:ir|ão)|ajudar|tradur(?:re|lo)|traduzione|aiutare|перевести|перевод|помочь|ответить",
    "翻译|译文|译出|译成|翻成|回答|处理|完成|提供|协助|帮助|帮忙|帮到|满足|答复|回应|执行|给出|作答|解答|翻訳|訳す|訳文|対応|手伝い|번역|도와|답변|제공|처리",
)
OBJECT = (
    "this|that|these|those|it|sentence|text|request|content|line|passage|message|phrase|input|question|material|paragraph|one|cette|cet|ce|ces|phrase|texte|demande|contenu|diese[nrsm]?|satz|text|anfrage|inhalt|frage|est[aeo]s?|frase|texto|solicitud|contenido|oración|pregunta|quest[ao]|richiesta|pedido|это|эт(?:от|ой|ом|им|у)|текст\\w*|предложени\\w|запрос\\w*",
    "这句话?|这个|这段|这条|这篇|这类|这些|句子|句话|内容|文本|请求|问题|要求|原文|文字|任务|材料|此条|该条|该句|该段|この|文章|テキスト|内容|リクエスト|質問|依頼|문장|텍스트|내용|요청|질문",
)
FILLER = (
    "with|to|for|of|an?|the|about|but|and|at|in|so|please|kindly|from|into|any|on|due|must|have|be|been|being|my|your|you|abilit(?:y|ies)|scope|capabilit(?:y|ies)|policy|guidelines|moment|time|currently|another|chinese|able|do|that|such|feel|comfortable|willing|allowed|permitted|capable|restrictions?|right now|for now",
    "mais|de|la|le|les|à|une?|avec|pour|vous|suis|es|aber|der|die|das|bei|zu|mit|den|dabei|bin|muss|mir|ist|pero|con|el|una?|para|por|en|que|con|eso|y|но|с|на|в",
    "很|非常|十分|因此|所以|暂时|目前|其他|请|的|涉及|能力|范围|您|你|为|对|把|将|了|并|敬|和|与|继续|给|进行|现在|由于|政策|规定|再|换|一|个|试|内|到|以|在|中文|也|都|吧|该|此|话|条|段|ありません|ございません|ます|ことは|こと|その|する|ご|お|が|を|は|に|の|で|습니다|합니다|하지만|지만|드릴|입니다|스럽게도|깝게도|하여|으로|은|는|해|할|을|를|이",
)
#: Orders in which the parts come: A apology, S speaker, N inability, D declining, V act, O object.
REFUSAL_TEMPLATES = ("ASNVO", "SNVO", "ANVO", "NVO", "SNVOA", "AOSNV", "OSNVOA", "ONV", "OSNV", "ASOVN", "ASOV", "AOVN", "SOVN", "OVN", "ASNV", "SDO", "SDVO", "ASDO", "ASDVO", "DVO", "SDV", "ASNO", "SNDVO", "OVD", "ADVO", "AON", "ONVA", "AOV", "VD", "OD", "ANV", "NVA", "VNA", "AVN", "VN", "SNOA", "ONSA", "SNVA", "ASV")
#: Words by which a prompt itself is about translating a text or declining a request.
_ABOUT = re.compile(r"\b(?:translat\w*|sentences?|texts?|requests?|contents?|passages?|questions?|paragraphs?)\b", re.I)
PLACEHOLDERS = frozenset("na none null nil nan tbd todo tba untranslated empty missing 无 空 暂无 略 待译 待翻译 未翻译 暂无翻译 无翻译 暂无译文 无译文 暂缺 缺失 译文 翻译".split())
_LABEL = re.compile(r"^\s*(?:译文|翻译|中文翻译|中文|译|translation|chinese)\s*[:：]\s*", re.I)
_THANKS = re.compile(r"[\s。．.!！,，]*(?:谢谢|感谢|thank you|thanks)[\s。．.!！]*$", re.I)
_ENDS_IN_THANKS = re.compile(r"谢|thank", re.I)
_NOTE = re.compile(r"\s*[（(【\[]\s*[译註注编][^（(【\[）)】\]]*[）)】\]]\s*$")
_CLOSERS = "\"'”’」』）)】］]》 \t\r\n　\xa0"
_FINAL = "。！？!?｡."
_DANGLING = re.compile(r"(?:…|\.\.+|。。+|[，、；：,;:—-])$")
_TRAIL = re.compile(r"[\W_]+$")
_HAN = r"㐀-䶿一-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_HANS = re.compile(rf"[{_HAN}]")
_KANA_HANGUL = re.compile(r"[぀-ヿㇰ-ㇿ가-힯ᄀ-ᇿ]")


def visible(text: str | None) -> str:
    """Text in compatibility form without invisible characters and entities."""
    text = text or ""
    if "&" in text:
        text = html.unescape(text)
    return unicodedata.normalize("NFKC", text).translate(_INVISIBLE)


_INVISIBLE = {c: None for c in _DROP if chr(c) not in "'‘’ʼ′"}


def tokens(text: str) -> list[str]:
    """Words in order, each Han character being one."""
    out = []
    for w in words(text):
        out += _TOKEN.findall(w)
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one big-integer step per token of b."""
    place: dict[str, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & place.get(y, 0)
        row = (row + hit) | (row - hit)
    return (~row & full).bit_count()


_KINDS = {"A": APOLOGY, "D": DECLINING, "N": INABILITY, "V": ACT, "O": OBJECT, "S": SPEAKER, "F": FILLER}


def _part_pattern() -> re.Pattern[str]:
    """One pattern for all parts: words of scripts with gaps as a whole, others anywhere; longer phrases first."""
    spaced: list[tuple[str, str]] = []
    joined: list[tuple[str, str]] = []
    for kind, lists in _KINDS.items():
        for phrase in re.split(r"[|](?![^(]*[)])", "|".join(lists)):
            (joined if re.search(r"[぀-ヿ㐀-鿿가-힯]", phrase) else spaced).append((kind, phrase))
    arms = []
    for phrases, form in ((spaced, r"(?<!\w)(?:{})(?!\w)"), (joined, "(?:{})")):
        for kind in _KINDS:
            of = sorted((p for k, p in phrases if k == kind), key=lambda p: (-len(p), p))
            if of:
                arms.append(f"(?P<{kind}{len(arms)}>{form.format('|'.join(of))})")
    return re.compile("|".join(arms))


_PARTS = _part_pattern()
#: A quick test that any refusal passes.
_MAY_REFUSE = re.compile("|".join((*INABILITY, *DECLINING)), re.I)
_SPACES = re.compile(r"\s+")
#: The stretches of one script in a word, as a name in Latin letters may stand beside Han characters.
_SCRIPTS = re.compile(rf"[{_HAN}]+|[^{_HAN}]+")
_FIRST_PERSON = frozenset("i im ive id we our us my me".split())


def refusal_parts(said: list[str]) -> tuple[str, int, int]:
    """(kinds of the parts in order, characters in parts, characters in all) of a response's words."""
    text = " ".join(said)
    kinds, covered = "", 0
    for m in _PARTS.finditer(text):
        covered += len(_SPACES.sub("", m.group()))
        kind = m.lastgroup[0]
        if kind != "F" and kinds[-1:] != kind:
            kinds += kind
    return kinds, covered, len(_SPACES.sub("", text))


def is_refusal(prompt: str | None, body: str, names: re.Pattern[str]) -> bool:
    """Whether the response's parts align with a refusal template and explain nearly all that it says besides names.

    A response to a prompt that is itself about translating or requests, and that repeats the prompt's names, tells of it
    and is no refusal, unless it speaks in the first person and the prompt does not.
    """
    if not _MAY_REFUSE.search(body.replace("'", "").replace("’", "")):
        return False
    asked = words(prompt)
    gap = {w for w in asked if not _PARTS.fullmatch(w)}
    bare = names.sub(" ", body)
    said = [w for run in words(bare) for w in _SCRIPTS.findall(run) if w not in gap]
    kinds, covered, whole = refusal_parts(said)
    if not ("D" in kinds or "N" in kinds and ("V" in kinds or "A" in kinds)) or covered < 0.75 * whole:
        return False
    best = max(lcs(list(t), list(kinds)) / len(t) for t in REFUSAL_TEMPLATES)
    if best < 0.8 or not ({"A", "S", "O"} & set(kinds) or kinds in ("VD", "DV")):
        return False
    if not _ABOUT.search(prompt or "") or "S" in kinds and _FIRST_PERSON.isdisjoint(asked):
        return True
    return bare == body and len(asked) > 8 and gap.isdisjoint(w for run in words(body) for w in _SCRIPTS.findall(run))


def shingles(ts: list[str], n: int = 2) -> set[tuple[str, ...]]:
    return {tuple(ts[i : i + n]) for i in range(len(ts) - n + 1)}


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """Whether the response gives back the prompt: contained in it by pairs of words or in order, and covering half of it."""
    if not response or not prompt:
        return False
    inside = shingles(response)
    held = len(inside & shingles(prompt)) / len(inside) if inside else 0.0
    common = lcs(prompt, response)
    return common >= 0.5 * len(prompt) and (common >= 0.75 * len(response) or held >= 0.75)


class Endings:
    """How responses end, names masked to their shape.

    An ending is the text before the last run of name or digit characters, the run, and the text after it. A run with
    text after it is masked to the number of its parts. A run that is itself last is masked to the lengths of its
    parts, so that half a name ends otherwise than a whole one; whole Latin names, which must be words of the prompt,
    stand for transliterated ones of the usual shape and the other way round.
    """

    def __init__(self, name_characters: str):
        self.names = re.compile(rf"[{name_characters or chr(0)}·]{{2,}}")
        self.run = re.compile(rf"[{name_characters or chr(0)}·]+|[A-Za-zÀ-ɏ'’-]+(?:[ \xa0·]+[A-Za-zÀ-ɏ'’-]+)*|[0-9]+(?:[.,:][0-9]+)*")

    def of(self, response: str) -> tuple[str, str, str, str, str]:
        """(text before, number of parts, shape if the run is last, text after, last Latin word if the run is last)."""
        text = response if response.endswith("·") else _TRAIL.sub("", _NOTE.sub("", response))
        runs = list(self.run.finditer(text))
        if not runs:
            return text[-12:], "", "", "", ""
        last = runs[-1]
        got, start = last.group(), runs[-2].end() if len(runs) > 1 else 0
        before, after = text[max(start, last.start() - 5) : last.start()], text[last.end() :][-8:]
        if got[0].isdigit():
            return before, "9", "" if after else "9", after, ""
        parts = re.split(r"[ \xa0·]+", got)
        arity = str(len(parts))
        if after:
            return before, arity, "", after, ""
        if got[0] < "Ⰰ":
            return before, arity, "E" + arity, "", parts[-1]
        return before, arity, "N" + ".".join(str(len(x)) for x in parts), "", ""

    @staticmethod
    def key(before: str, arity: str, shape: str, after: str) -> str:
        return f"{before}|{shape or arity}|{after}"


def body_of(response: str | None) -> str:
    """The response proper: visible text without a label before it and thanks after it."""
    text = _LABEL.sub("", visible(response)).strip()
    return text if not _ENDS_IN_THANKS.search(text[-24:]) else _THANKS.sub(lambda m: "。" if re.match(r"\s*[。．.!！]", m.group()) else "", text).strip()


def is_empty(response: str) -> bool:
    said = "".join(words(response))
    return not said or said in PLACEHOLDERS


def finished(response: str) -> bool:
    """Whether the response ends with final punctuation, closing quotes, brackets and notes aside."""
    text = (_NOTE.sub("", response) if response[-1:] in ")）]】" else response).rstrip(_CLOSERS)
    return text[-1:] in tuple(_FINAL) and not _DANGLING.search(text)


def kind_of(prompt: str | None, body: str, names: re.Pattern[str]) -> str:
    """``empty``, ``refusal``, ``copied``, ``wrong_language``, ``names`` (prompt words only) or ``target``."""
    han = len(_HANS.findall(body))
    if han >= 4 and 2 * han > sum(map(str.isalnum, body)) and not _KANA_HANGUL.search(body):  # mostly Han: neither a copy nor another language
        if is_refusal(prompt, body, names):
            return "refusal"
        return "empty" if han <= 8 and is_empty(body) else "target"
    if is_empty(body):
        return "empty"
    asked, said = tokens(prompt or ""), tokens(body)
    if is_copy(asked, said):
        return "copied"
    if is_refusal(prompt, body, names):
        return "refusal"
    known = set(asked)
    foreign = 0
    for w in said:
        if w not in known and not w.isdigit() and not _HANS.match(w):
            foreign += sum(unicodedata.category(c)[0] == "L" for c in w)
    if not han:
        partial = len(said) <= 4 and all(w in known or any(k.startswith(w) for k in known) for w in said)
        return "names" if partial or not foreign else "wrong_language"
    own = len(_HANS.findall(names.sub("", body)))  # Han characters outside transliterated names
    other = len(_KANA_HANGUL.findall(body))
    if other >= 4 and 2 * other >= own:
        return "wrong_language"
    return "wrong_language" if foreign > 12 and foreign > 3 * own else "target"


def _learn_names(rows: DataFrame) -> str:
    """Han characters that stand next to the dot between the parts of transliterated names, each in at least 1/2000 of
    all places there. Counted over all rows; at most 4,000 characters come back."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for b in batches:
            for z in b["_response"].to_pylist():
                if z and "·" in z:
                    for m in re.finditer(rf"([{_HAN}])·(?=([{_HAN}]))", z):
                        count.update(m.groups())
        yield pa.RecordBatch.from_pydict({"c": list(count), "n": list(count.values())}, pa.schema([("c", pa.string()), ("n", pa.int64())]))

    found = cut_lineage(rows.select("_response").mapInArrow(task, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    return "".join(sorted(r["c"] for r in found.filter(F.col("n") * 2000 >= total).collect()))


def judge(prompt: str | None, response: str | None, endings: Endings) -> tuple[str | None, tuple[str, str, str, str] | None, bool]:
    """(defect or None, ending, whether the ending is one before final punctuation) of a pair.

    Where a pair has no defect but an ending that is none before final punctuation, that ending must be a known one.
    """
    body = body_of(response)
    kind = kind_of(prompt, body, endings.names)
    if kind == "names":
        return "truncated", None, False
    if kind != "target":
        return kind, None, False
    if _DANGLING.search(_NOTE.sub("", body).rstrip(_CLOSERS)):
        return "truncated", None, False
    if finished(body):
        return None, endings.of(body)[:4], True
    if _NOTE.search(body):
        return None, None, False
    before, arity, shape, after, word = endings.of(body)
    own = words(word)
    if own and own[-1] not in words(prompt):  # half a name
        return "truncated", None, False
    return None, (before, arity, shape, after), False


_ENDING = ("_before", "_arity", "_shape", "_after")
#: Different endings that a task counts before it hands the counts on.
COUNTED = 100_000


def _judged(rows: DataFrame, kind: str, names: str) -> DataFrame:
    """One pass over all pairs: defective ones (with _defect), undecided ones (with their ending, _n null) and the counted
    endings before final punctuation (with _n)."""
    schema = pa.schema([("_ident", pa.int64()), ("_defect", pa.string()), *((c, pa.string()) for c in _ENDING), ("_n", pa.int64())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings(names)
        count: Counter[tuple[str, str, str, str]] = Counter()
        nulls = None

        def counted() -> pa.RecordBatch:
            parts = list(zip(*count)) or [()] * 4
            columns = [nulls.take(pa.array([None] * len(count), pa.int64())), pa.nulls(len(count), pa.string()), *(pa.array(p, pa.string()) for p in parts), pa.array(count.values(), pa.int64())]
            count.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for b in batches:
            nulls = b["_ident"]
            at, found = [], []
            for i, (p, z) in enumerate(zip(b["_prompt"].to_pylist(), b["_response"].to_pylist())):
                defect, ending, sound = judge(p, z, endings)
                if sound:
                    count[ending] += 1
                elif defect or ending:
                    at.append(i)
                    found.append((defect, *(ending or (None,) * 4)))
            columns = [pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.nulls(0, pa.string())] * 5
            yield pa.RecordBatch.from_arrays([b["_ident"].take(pa.array(at, pa.int64())), *columns, pa.nulls(len(at), pa.int64())], schema.names)
            if len(count) > COUNTED:
                yield counted()
        if count:
            yield counted()

    return rows.mapInArrow(task, f"_ident {kind}, _defect string, {', '.join(f'{c} string' for c in _ENDING)}, _n bigint")


def _key(before: str, arity: str, shape: Column, after: str) -> Column:
    return F.concat_ws("|", F.col(before), F.when(shape != "", shape).otherwise(F.col(arity)), F.col(after))


def usual_shapes(endings: DataFrame) -> DataFrame:
    """(_arity, _usual): the most frequent shape of a transliterated name that comes last, by its number of parts."""
    shapes = endings.filter(F.col("_shape").startswith("N")).groupBy("_arity", "_shape").agg(F.sum("_n").alias("n"))
    return shapes.groupBy("_arity").agg(F.min(F.struct((-F.col("n")).alias("minus"), "_shape"))["_shape"].alias("_usual"))


def broken_pairs(rows: DataFrame, *, ident: str = "id", prompt: str = "text", response: str = "translation_zh") -> DataFrame:
    """(ident, defect) of every defective pair: empty, truncated, refusal, copied or wrong_language.

    Two passes: one learns the characters of names, one judges all pairs and counts the endings of finished responses. A
    response without final punctuation is whole if one of its two possible endings (a name in Latin letters ends as a
    transliterated one of the usual shape does) is seen at least twice before final punctuation.

    Defined results: a null response is empty; a null prompt can be copied by nothing; each row is judged by itself, so
    repeated rows come out each; very long texts are aligned whole; an empty table gives no rows. Only the three named
    columns are read, so other columns play no part. No shuffle but of counts and, with more than MOST_ENDINGS endings,
    of the undecided rows.
    """
    kind = rows.schema[ident].dataType.simpleString()
    read = rows.select(F.col(ident).alias("_ident"), F.col(prompt).alias("_prompt"), F.col(response).alias("_response"))
    judged = cut_lineage(_judged(read, kind, _learn_names(read)))
    counts = judged.filter(F.col("_n").isNotNull()).groupBy(*_ENDING).agg(F.sum("_n").alias("_n"))
    known = counts.groupBy(_key("_before", "_arity", F.col("_shape"), "_after").alias("_known")).agg(F.sum("_n").alias("_n"))
    known = broadcast_if_small(known.filter("_n >= 2").select("_known"), MOST_ENDINGS)
    defects = judged.filter(F.col("_defect").isNotNull()).select("_ident", "_defect")
    open_ = judged.filter(F.col("_defect").isNull() & F.col("_n").isNull()).join(broadcast_if_small(usual_shapes(counts)), "_arity", "left")
    latin = F.concat(F.lit("E"), F.col("_arity"))
    either = (F.col("_shape") == latin) | F.coalesce(F.col("_shape") == F.col("_usual"), F.lit(False))
    open_ = open_.withColumns({
        "_own": _key("_before", "_arity", F.col("_shape"), "_after"),
        "_other": F.when(either & (F.col("_shape") != ""), _key("_before", "_arity", F.when(F.col("_shape") == latin, F.col("_usual")).otherwise(latin), "_after"))})
    for end in ("_own", "_other"):
        open_ = open_.join(known, open_[end] == known["_known"], "left_anti")
    return defects.unionByName(open_.select("_ident", F.lit("truncated").alias("_defect"))).toDF(ident, "defect")
