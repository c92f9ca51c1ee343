"""Text expressions that run whole in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import _NARROW, _WIDE

#: Unicode white space, as one class that Java and RE2 read alike.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Invisible characters, tags, and quotes and dashes with their plain forms.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
TAG = r"<[^>]+>"
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„‟–—", "''''\"\"\"\"--"
#: The entities that occur in practice; the Arrow kernel knows all of them.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
LOWER_WORD = r"[a-z]+(?:'[a-z]+)?"
#: Words that say nothing about a text's content.
IGNORED_WORDS = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "the", "this", "to", "with")
#: Separates the sentences of a text; no text holds it after cleaning.
MARK = "\x01"


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean(text: Column) -> Column:
    """Entities, tags, width, quotes and dashes, invisible characters and white space normalised."""
    plain = F.regexp_replace(unescape(text), TAG, " ")
    narrow = F.translate(plain, _WIDE + QUOTES_FROM, _NARROW + QUOTES_TO)
    return collapse(F.regexp_replace(narrow, INVISIBLE, ""))


def normalized(text: Column) -> Column:
    return F.lower(clean(text))


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def all_words(cleaned: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(0))


def content_words(text: Column) -> Column:
    """Lower-case words in order, without the ignored ones."""
    return F.filter(all_words(normalized(text), LOWER_WORD), lambda w: ~w.isin(*IGNORED_WORDS))


def shingles(words: Column, n: int = 3) -> Column:
    """Overlapping runs of n words; texts with fewer words are one shingle, texts without words none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    short = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= n, runs).otherwise(short)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column) -> Column:
    """A text's sentences: cut after final punctuation, a closing quote perhaps, before an upper-case letter."""
    marked = F.regexp_replace(collapse(text), r"""([.!?]["']?) (["']?[A-Z])""", f"$1{MARK}$2")
    return F.filter(F.split(marked, MARK), lambda s: s != "")


def abbreviation_safe_sentences(text: Column) -> Column:
    """Like ``sentences``, but titles and initials ("Dr. A. Smith") do not end a sentence."""
    safe = F.regexp_replace(collapse(text), r"(^|[^A-Za-z])(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|[A-Z])\.", "$1$2\x02")
    return F.transform(sentences(safe), lambda s: F.replace(s, F.lit("\x02"), F.lit(".")))


def terminal_punctuation(text: Column) -> Column:
    """A full stop before closing quotes, where the text ends without final punctuation."""
    return F.regexp_replace(text, r"""([^.?!"'”’])(["'”’]*)$""", "$1.$2")


def stable_id(text: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(normalized_hash(text), 1, 16))


def random_key(digest: Column) -> Column:
    """The first eight bytes of a hex digest as a non-negative 63-bit number."""
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (value % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")


def canonical_word(word: Column) -> Column:
    """A lower-case word with its plural ending off."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("s") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def canonical_tokens(text: Column) -> Column:
    return F.transform(all_words(F.lower(text), "[a-z]+"), canonical_word)


def phrase_present(tokens: Column, phrase: Column) -> Column:
    """Whether the space-joined canonical phrase occurs in the tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def normalize_answer(answer: Column) -> Column:
    return F.lower(collapse(F.translate(answer, QUOTES_FROM, QUOTES_TO)))


def parse_tags(value: Column) -> Column:
    """The tags of a forum post, written ``<a><b>`` or ``|a|b|``."""
    return F.regexp_extract_all(value, F.lit("[^<>|]+"), F.lit(0))


def licence_key(value: Column) -> Column:
    """One spelling per licence: upper case, single dashes, version kept ("cc by-sa 4.0" and "CC-BY-SA-4.0" agree)."""
    return F.regexp_replace(F.upper(collapse(value)), "[ _-]+", "-")


def exam_level(path: Column) -> Column:
    """The level an exam file is of, by the folder or file name; null if none is named."""
    low = F.lower(path)
    return F.when(low.rlike("cet[-_ ]?6|level[-_ ]?6"), "6").when(low.rlike("cet[-_ ]?4|level[-_ ]?4"), "4")
