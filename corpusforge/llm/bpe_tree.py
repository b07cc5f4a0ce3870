"""Byte-level BPE over whole texts as a reduction of a tree.

A text is halved until its parts are short. Each part is encoded by itself, and neighbours are joined by
re-encoding a window around the cut. The window grows to both sides until what lies outside provably stays:

* between texts, when it ends where white space follows other text: no match of the splitting pattern crosses
  such a place, so the tokens before and after it depend on their own side alone;
* inside one long match, when the window's outer tokens come back unchanged: a sequence of tokens is the
  encoding of its bytes if every two neighbours are the encoding of theirs, so the outer pairs, which stood
  before, and the window's pairs make up the whole.

Joining is associative with the empty text as its identity, so the tree's shape doesn't alter the result.
Decoding concatenates the bytes of blocks of ids up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusforge.llm.common import map_texts

#: A part of at most this many characters is a leaf.
LEAF_CHARS = 768
#: A single match of more bytes than this is encoded by halves too.
LONG_PIECE = 256
#: Ids in a leaf of the decoding tree.
LEAF_IDS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeCodec:
    """Encodes and decodes by one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, long_piece: int = LONG_PIECE):
        import tiktoken

        self.base = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ranks, self.leaf_chars, self.long_piece = ranks, leaf_chars, long_piece
        self.cut_back = regex.compile(r"(?r)(?<=\S)\s")
        self.cut_on = regex.compile(r"(?<=\S)\s")

    # texts -----------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        parts = [text[i : i + self.leaf_chars] for i in range(0, len(text), self.leaf_chars)]
        return self._reduce([(part, self._leaf(part)) for part in parts])[1]

    def _leaf(self, text: str) -> list[int]:
        return self.base.encode_ordinary(text)

    def _reduce(self, parts: list[tuple[str, list[int]]]) -> tuple[str, list[int]]:
        """Joins neighbours level by level, from the leaves to the root."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """(text, ids) of two neighbouring texts."""
        (a, ids_a), (b, ids_b) = left, right
        if not a or not b:
            return (a + b, ids_a + ids_b)
        size = 32
        while True:  # the window's ends: safe cuts within ``size`` of the join, or the texts' own ends
            p = self._last_cut(a, max(0, len(a) - size))
            q = self._first_cut(b, min(len(b), size))
            if (p or size >= len(a)) and (q or size >= len(b)):
                break
            size *= 4
        q = q or len(b)
        tail, head = a[p:], b[:q]
        kept_a = len(ids_a) - len(self._window(tail))
        kept_b = len(self._window(head))
        return a + b, ids_a[:kept_a] + self._window(tail + head) + ids_b[kept_b:]

    def _last_cut(self, text: str, low: int) -> int:
        found = self.cut_back.search(text, low)
        return found.start() if found and found.start() > 0 else 0

    def _first_cut(self, text: str, high: int) -> int:
        found = self.cut_on.search(text, 0, high)
        return found.start() if found else 0

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        ids: list[int] = []  # no place to cut for a long way: match by match, long ones by halves
        for found in self.pattern.finditer(text):
            ids += self.encode_piece(found[0].encode("utf-8"))
        return ids

    # one match of the pattern ------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= self.long_piece:
            return self.base._encode_single_piece(piece)
        middle = len(piece) // 2
        return self._join_ids(self._half(piece[:middle]), self._half(piece[middle:]))

    def _half(self, piece: bytes) -> list[int]:
        if len(piece) <= self.long_piece:
            return self.base._encode_single_piece(piece)
        middle = len(piece) // 2
        return self._join_ids(self._half(piece[:middle]), self._half(piece[middle:]))

    def _join_ids(self, a: list[int], b: list[int]) -> list[int]:
        size = 2
        while True:
            tail, head = a[-size:], b[:size]
            window = self.base._encode_single_piece(self.base.decode_bytes(tail + head))
            left_stays = len(tail) == len(a) or window[0] == tail[0]
            right_stays = len(head) == len(b) or window[-1] == head[-1]
            if left_stays and right_stays:
                return a[: len(a) - len(tail)] + window + b[len(head) :]
            size *= 2

    # back --------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: blocks of them, concatenated up a tree."""
        parts = [self.base.decode_bytes(ids[i : i + LEAF_IDS]) for i in range(0, len(ids), LEAF_IDS)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


_codecs: dict[tuple[str, str], TreeCodec] = {}


def _codec(path: str, pattern: str) -> TreeCodec:
    """The worker's codec, kept from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = TreeCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 of every row; with
    ``keep_ids`` also the ids themselves as ``token_ids``.

    A null text is the empty one (0 tokens, digests of no bytes); a very long one is a deeper tree; null ids stay; an
    empty table gives an empty one; repeated rows give repeated
    results; other columns of ``docs`` are ignored. ``path`` must be readable on every executor. A scan and one
    map: nothing is shuffled, and a lost executor costs its running tasks alone.
    """

    def work(texts: list[str]) -> dict[str, pa.Array]:
        codec = _codec(path, pattern)
        n, sums, back, kept = [], [], [], []
        for text in texts:
            ids = codec.encode(text)
            n.append(len(ids))
            sums.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if keep_ids:
                kept.append(ids)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sums, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        return out | ({"token_ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {})

    return map_texts(docs, id_col, text_col, work, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``bpe_round_trip`` with the ids kept, for writing a tokenised table."""
    return bpe_round_trip(docs, path, pattern, keep_ids=True)
