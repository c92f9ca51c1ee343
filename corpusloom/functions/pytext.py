"""Text kernels in Python for what Spark has no built-in: entities, compatibility forms, full case folding."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Apostrophes join the letters around them: "can't" is one word.
_APOSTROPHES = "'‘’ʼʹ′＇`´"
_INVISIBLE = "".join(
    chr(c)
    for r in ((0x0000, 0x0009), (0x000E, 0x001C), (0x007F, 0x0085), (0x0086, 0x00A0), (0x00AD, 0x00AE), (0x034F, 0x0350), (0x061C, 0x061D), (0x180B, 0x180F), (0x200B, 0x2010), (0x202A, 0x202F), (0x2060, 0x2070), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFFF9, 0xFFFC))
    for c in range(*r)
)
_DROP = dict.fromkeys(map(ord, _APOSTROPHES + _INVISIBLE))


def fold(text: str) -> str:
    """Text without tags, entities, invisible or control characters and apostrophes, in compatibility form and case-folded."""
    text = text.translate(_DROP)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).translate(_DROP)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP)
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Runs of letters or digits of the folded text, in order; none for null."""
    return _WORD.findall(fold(text)) if text else []
