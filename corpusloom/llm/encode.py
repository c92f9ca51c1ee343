"""Encoding of a whole corpus with a public byte-level BPE tokenizer, without replaying merges.

Token bytes are mapped to Latin-1 strings for an Aho-Corasick automaton, which finds the longest token starting at each
byte of a piece in one pass. Tokens are then chosen from the left, the longest first; a token may follow another only
if BPE itself would leave the two apart, which is decided by undoing their merges along the boundary and remembered for
each pair. Where no token fits, the last one is taken back and its next shorter prefix tried; positions that failed are
never tried again, so the time is linear. Of all ways to cut a piece only BPE's own has compatible neighbours
throughout, hence the ids are exact.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published pattern that cuts text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairEncoder:
    """BPE over the bytes of pieces. ``ranks`` maps token bytes to ids that grow in the order of the merges."""

    #: Remembered pieces and pairs; both are forgotten when they reach this size.
    MEMORY = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        self.pattern = regex.compile(PIECES)
        size = max(ranks.values()) + 1
        self.length = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size  # the two tokens a token was merged from
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.length[i] = len(token)
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.automaton.make_automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            left = self.shorter[i]
            while left != -1:
                right = ranks.get(token[self.length[left] :])
                if right is not None and left < i and right < i and self._stay_apart(left, right):
                    self.parts[i] = (left, right)
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b unmerged when they stand next to each other.

        Undoes the merges of both, the later one first, and looks at each stage for a merge across the boundary that
        would have come before the one undone.
        """
        undone = len(self.length)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < undone:
                return False
            pa_, pb = self.parts[a], self.parts[b]
            if pa_[0] == -1 and pb[0] == -1:
                return True
            if pb[0] == -1 or (pa_[0] != -1 and a > b):
                undone, a = a, pa_[1]  # the left token's last merge is the later one
            else:
                # of equal merges the left comes first, so one across the boundary with b's own rank would come before b's
                undone, b = b + 1, pb[0]

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        fits = self.apart.get(key)
        if fits is None:
            if len(self.apart) >= self.MEMORY:
                self.apart.clear()
            fits = self.apart[key] = self._stay_apart(a, b)
        return fits

    def piece(self, text: str) -> list[int]:
        """The ids of one piece, given as the Latin-1 view of its bytes."""
        longest = [-1] * (len(text) + 1)
        for end, (i, n) in self.automaton.iter(text):
            longest[end - n + 1] = i
        ids: list[int] = []
        at, token = 0, longest[0]
        open_ = bytearray(b"\1" * (len(text) + 1))
        while at < len(text):
            while token != -1:
                end = at + self.length[token]
                if open_[end] and (not ids or self._fit(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token != -1:
                ids.append(token)
                at = end
                token = longest[at]
            else:  # dead end: take the last token back and shorten it
                open_[at] = 0
                token = ids.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        known = self.known
        out = []
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = array("i", self.piece(p.encode("utf-8").decode("latin-1"))).tobytes()
                if len(p) <= 64:
                    if len(known) >= self.MEMORY:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to id from a rank file: a line per token, base64 bytes and id."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


_ENCODERS: dict[int, BytePairEncoder] = {}


def encode_corpus(df: DataFrame, *, ident: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(ident, ids): the token ids of every text, without special tokens.

    The vocabulary is read on the driver and broadcast: a file of a fixed size. Defined results: a null or empty text
    gives an empty list; blank text, control characters and strings that look like special tokens are encoded as
    ordinary text; repeated rows come out each; a null identifier stays null. One row out per row in, no shuffle.
    """
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, BytePairEncoder(read_ranks(content.value)))
        for b in batches:
            for part in (b.slice(i, 1_000) for i in range(0, b.num_rows, 1_000)):
                encoded = [encoder.encode(t) if t else b"" for t in part["_text"].to_pylist()]
                offsets = np.zeros(len(encoded) + 1, dtype=np.int64)
                np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
                ids = pa.array(np.frombuffer(b"".join(encoded), dtype=np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([part["_ident"], lists], ["_ident", "_ids"])

    read = df.select(F.col(ident).alias("_ident"), F.col(text).alias("_text"))
    kind = read.schema["_ident"].dataType.simpleString()
    return read.mapInArrow(task, f"_ident {kind}, _ids array<int>").toDF(ident, "ids")
