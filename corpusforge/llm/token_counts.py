"""Exact token counts by a map-side two-tier lookup.

A text falls into pre-tokens, each of which the tokenizer encodes by itself, so a text's count is the sum of
its pre-tokens' counts. The first tier is a broadcast table with the counts of the frequent pre-tokens: those that a
bounded sample of rows holds most often, ``TABLE_ENTRIES`` at most, packed as one string, the entries' sizes and their
counts. The second tier is a cache in each Python worker, which learns what the table lacks by encoding it once. What
is in the table changes no result. No pre-token is shuffled: the plan is a scan and one map, after a map over the
sample.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm.common import by_chunks, map_texts, only

#: The pattern of the byte-level pre-tokenizer (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the first tier at most; rows of the sample that it is made from, about, and tasks that read it.
TABLE_ENTRIES, SAMPLE_ROWS, SAMPLE_TASKS = 1 << 16, 4_000, 4
#: Entries that a worker learns before it starts its cache anew.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded when met and not kept.
CACHED_CHARS = 48


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class PackedTable:
    """Pre-tokens with their token counts: all of them in one string, the bytes of each, the tokens of each."""

    text: bytes
    sizes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, int]) -> PackedTable:
        raw = [w.encode("utf-8") for w in counts]
        return cls(b"".join(raw), np.array([len(w) for w in raw], np.uint8), np.array(list(counts.values()), np.uint8))

    def unpacked(self) -> dict[str, int]:
        ends = np.cumsum(self.sizes, dtype=np.int64).tolist()
        return {self.text[a:b].decode("utf-8"): n for a, b, n in zip([0, *ends], ends, self.counts.tolist())}


def frequent_lengths(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES, text_col: str = "text") -> dict[str, int]:
    """Token counts of the ``entries`` commonest short pre-tokens in about ``rows`` rows; ties in the words' order."""
    texts = only(docs, text_col)
    n = texts.count()
    some = (texts.sample(rows / n, 11) if n > rows else texts).coalesce(SAMPLE_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(BYTE_LEVEL).findall, Counter()
        for batch in batches:
            for _, part in by_chunks(batch, 0):
                for t in part:
                    seen.update(w for w in find(t) if len(w) <= CACHED_CHARS)
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([k for _, k in best], pa.int64())], names=["word", "n"])

    total: Counter[str] = Counter()
    for r in some.mapInArrow(run, "word string, n long").collect():  # SAMPLE_TASKS x entries rows at most
        total[r["word"]] += r["n"]
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    encoded = _tokenizer(path).encode_batch(words, add_special_tokens=False)
    return {w: len(e) for w, e in zip(words, encoded, strict=True)}


class TwoTierCounter:
    """Counts tokens of texts; ``table`` is the shared first tier."""

    def __init__(self, path: str, table: dict[str, int], cache_entries: int = CACHE_ENTRIES):
        self.tokenizer = _tokenizer(path)
        self.table, self.cache_entries = table, cache_entries
        self.known = dict(table)
        self.find = regex.compile(BYTE_LEVEL).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many special strings it holds, each of which is one token."""
        if not self.special or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1

    def _learn(self, missing: list[str]) -> None:
        for i in range(0, len(missing), 4096):
            block = missing[i : i + 4096]
            self.known.update(zip(block, map(len, self.tokenizer.encode_batch(block, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._pieces(t) for t in texts]
        missing = set().union(*[p for p, _ in cut]).difference(self.known)
        if len(self.known) + len(missing) > len(self.table) + self.cache_entries:
            self.known = dict(self.table)
            missing = set().union(*[p for p, _ in cut]).difference(self.known)
        self._learn(list(missing))
        of = self.known.__getitem__
        counts = [sum(map(of, p)) + n for p, n in cut]
        for long in [m for m in missing if len(m) > CACHED_CHARS]:
            del self.known[long]
        return counts


_counters: dict[str, TwoTierCounter] = {}


def _counter(path: str, shared: Broadcast) -> TwoTierCounter:
    """The worker's counter, kept from task to task."""
    if path not in _counters:
        _counters[path] = TwoTierCounter(path, shared.value.unpacked())
    return _counters[path]


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as the empty one (0 tokens); a very long one is counted whole; a null id stays null; repeated
    rows give repeated results; an empty table gives an empty one. Other columns of ``docs`` are ignored, whatever their names. ``path`` must be readable on every executor.
    """
    shared = spark.sparkContext.broadcast(PackedTable.of(frequent_lengths(docs, path, text_col=text_col)))  # TABLE_ENTRIES at most

    def work(texts: list[str]) -> dict[str, list]:
        counts = _counter(path, shared).count(texts)
        sizes = pc.binary_length(pa.array(texts, pa.string()))
        return {"n_bytes": sizes.cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())}

    return map_texts(docs, id_col, text_col, work, "n_bytes long, n_tokens long, over_limit boolean")
