"""Spelling-independent keys of names, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that introduce a name and are no part of it.
INTRODUCERS = ("by",)

#: Full-width forms of the printable ASCII characters, and the characters themselves.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def fold_width_and_case(text: Column) -> Column:
    """Lower-cased text with full-width ASCII made narrow and invisible (format) characters dropped."""
    visible = F.regexp_replace(text, r"[\p{Cf}\p{Cc}­͏ᅟᅠ᠎&&[^\t\n\r\f\x0B\x85]]", "")
    return F.lower(F.translate(visible, _WIDE, _NARROW))


_PART = r"[\p{L}\p{N}\p{M}]"


def name_key(name: Column, introducers: tuple[str, ...] = INTRODUCERS) -> Column:
    """A key that is equal for all spellings of one name.

    Only the name's letters and digits count: case, width, invisible characters, punctuation, separators, the order of
    its parts ("Last, First") and an introducing word ("by X") do not. Parts are sorted and joined by one space. Null,
    blank and letterless names give null. All of it is generated code without lambdas, so the parts are made once.
    """
    gap = f"[^{_PART[1:]}"
    own = F.regexp_replace(fold_width_and_case(name), rf"^{gap}*(?:{'|'.join(introducers)}){gap}+(?={_PART})", "")
    parts = F.regexp_extract_all(own, F.lit(f"{_PART}+"), F.lit(0))
    none_if_empty = F.left(F.array_min(parts), F.lit(0))
    return F.concat(F.array_join(F.sort_array(parts), " "), none_if_empty)
