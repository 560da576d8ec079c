"""Byte-level BPE: exact merges in time linear in the text, by backtracking over longest matches.

A sequence of tokens is what the merges make of a text if and only if every pair of neighbours is compatible, that is, if
the merges leave the two apart when they stand side by side. So a piece of text is covered from the left with the longest
token that matches (all matches come from one pass of an Aho-Corasick automaton over the bytes as Latin-1 characters); a
token that doesn't go with the one before it, or that leads nowhere, gives way to its next shorter prefix. Places that lead
nowhere are marked, so each is left at most once. Compatibility is memoised, as are the ids of what recurs between spaces.

Null texts count as empty and give no ids. Repeated rows and null ids stay as they are; an empty table gives no rows. Very
long texts are encoded whole, with arrays that grow with the text. Memos are bounded and emptied when full, which only costs
time. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cuemill.llm.common import small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a worker's memos: where encoding is all that a job does, and where it is a step of several.
MEMO, SMALL_MEMO = 600_000, 150_000
_RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class _Spaced(Exception):
    """A stretch between spaces whose ids depend on what is around it."""


class Stretches(dict):
    """Packed ids of ' ' + stretch; the pattern never joins a stretch to what is before its space."""

    def __init__(self, pieces: Pieces, memo: int):
        super().__init__()
        self.pieces, self.memo = pieces, memo

    def __missing__(self, stretch: str) -> bytes:
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            raise _Spaced
        if len(self) >= self.memo:
            self.clear()
        packed = self.pieces.packed(" " + stretch)
        if len(stretch) <= 64:
            self[stretch] = packed
        return packed


class Pieces(dict):
    """Packed ids of one match of the pattern."""

    def __init__(self, merges: Merges, pattern: str, memo: int):
        super().__init__()
        self.merges, self.find, self.memo = merges, regex.compile(pattern).findall, memo

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memo:
            self.clear()
        packed = array("I", self.merges.ids(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


class Merges:
    """Encoding of one piece under ranks, a dict of bytes to ids; ids are in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int], memo: int = SMALL_MEMO):
        self.ranks, self.most = ranks, memo
        self.tokens = {i: b for b, i in ranks.items()}
        self.memo: dict[tuple[int, int], bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (i, len(token)))
        self.matches.make_automaton()
        for i in sorted(self.tokens):
            self._split(i)

    def _split(self, i: int) -> None:
        """The two tokens whose merge made i: the only cut into earlier tokens that go together."""
        token = self.tokens[i]
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], i), self.ranks.get(token[k:], i)
            if a < i and b < i and self._apart(a, b):
                self.halves[i], self.whole[a, b] = (a, b), i
                return

    def _apart(self, a: int, b: int) -> bool:
        """Do the merges that build a and b, side by side, never join across the border?

        Undo the merges latest first. The two tokens at the border at any moment must not have had a merge of their own
        that came before the one just undone.
        """
        before = len(self.tokens) + 1
        while True:
            if self.whole.get((a, b), before) < before:
                return False
            left, right = self.halves.get(a), self.halves.get(b)
            if left is None and right is None:
                return True
            # Undo the later merge of the two; of equal ones the right, since the left one is made first.
            if left is not None and (right is None or a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]

    def together(self, a: int, b: int) -> bool:
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            known = self.memo[a, b] = self._apart(a, b)
        return known

    def shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of i, or -1."""
        known = self.shorter_of.get(i)
        if known is None:
            token = self.tokens[i]
            known = self.shorter_of[i] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)
        return known

    def ids(self, piece: bytes) -> list[int]:
        if (one := self.ranks.get(piece)) is not None:
            return [one]
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (i, length) in self.matches.iter(piece.decode("latin-1")):
            if length > size[at := end - length + 1]:
                longest[at], size[at] = i, length
        tokens, lost, at = self.tokens, bytearray(n + 1), 0
        out: list[int] = []
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + len(tokens[token])
                if not lost[end] and (not out or self.together(out[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif out:
                lost[at] = 1
                token = out.pop()
                at -= len(tokens[token])
                token = self.shorter(token)
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out


class Coder:
    def __init__(self, vocabulary: bytes, pattern: str, memo: int = SMALL_MEMO):
        self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, memo)
        self.pieces = Pieces(self.merges, pattern, memo)
        self.stretches = Stretches(self.pieces, memo)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.pieces.packed(first) + b"".join(map(self.stretches.__getitem__, rest))
            except _Spaced:
                pass
        return self.pieces.packed(text)

    def decoded(self, packed: bytes) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_coders: dict[tuple[bytes, str, int], Coder] = {}


def coder(vocabulary: bytes, pattern: str, memo: int = SMALL_MEMO) -> Coder:
    """One coder a worker."""
    key = (hashlib.sha256(vocabulary).digest(), pattern, memo)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary, pattern, memo)
    return _coders[key]


def vocabulary_of(path: str | None = None) -> bytes:
    return Path(path or public_tokenizers.path(VOCABULARY)).read_bytes()


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a row for each row of docs (doc_id, text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shipped.value, pattern, memo)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1):
                packed = code.packed(text.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(sha(packed))
                back.append(sha(code.decoded(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(digests, _RESULT)


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, memo: int = SMALL_MEMO) -> DataFrame:
    """doc_id, ids (array of int), text: ids and the text that they decode to, as a user of the tokens wants them."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shipped.value, pattern, memo)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                packed = [code.packed(t.as_py() or "") for t in part.column(1)]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype("int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([code.decoded(p).decode() for p in packed], pa.string())], names=["doc_id", "ids", "text"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(coded, "doc_id bigint, ids array<int>, text string")
