"""Scores of word pairs over whole corpora, with pairs counted in packed form.

What ``style.ppmi(style.window_pairs(...))`` gives for pairs of ``least`` or more, without a row for each pair of each
task: the commonest words have numbers, a pair of them is one number, and a task sends sorted numbers as compressed
differences, a block for each bucket. Pairs with a word beyond those are counted as rows. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.session import shared_folder

#: The commonest words that get numbers (they are sent to every worker); the others stay strings.
NUMBERED = 1 << 19
#: Words of a batch that are paired at a time, different pairs that a task holds before it sends them.
SLICE, HELD = 500_000, 4_000_000
#: Bits of a count beside its pair's number, in a task.
COUNT_BITS = 24
PACKED = "bucket int, size int, block binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(different words, the words' places among them, each word's number in its list and how many follow it) of some
    whole lists at a time."""
    for batch in batches:
        lists = batch.column(0)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = sizes.cumsum()
        begin = 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
            size = sizes[begin:end]
            total = int(size.sum())
            if total:
                encoded = lists.slice(begin, end - begin).flatten().dictionary_encode()
                pos = np.arange(total) - np.repeat(size.cumsum() - size, size)
                yield encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.stack([pos, np.repeat(size, size) - pos])
            begin = end


def _beside(places: np.ndarray, reach: int, chunk: int, stride: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, numbers of words that have a neighbour so far ahead, chunks that hold both)."""
    pos, left = places
    for d in range(1, reach + 1):
        at = np.flatnonzero(left > d)
        p = pos[at]
        c = p // stride - np.maximum(-((chunk - 1 - d - p) // stride), 0) + 1
        yield d, at[c > 0], c[c > 0]


def word_totals(texts: DataFrame, words_col: str = "words", reach: int = 5, chunk: int = 24, stride: int = 12) -> DataFrame:
    """word, n, nx: how often each word occurs and stands in a pair of ``window_pairs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, places in _slices(batches):
            pairs = np.zeros(len(codes), np.int64)
            for d, at, c in _beside(places, reach, chunk, stride):
                pairs[at] += c
                pairs[at + d] += c
            yield pa.record_batch([words, np.bincount(codes, minlength=len(words)), np.bincount(codes, pairs, len(words)).astype(np.int64)], ["word", "n", "nx"])

    return texts.select(words_col).mapInArrow(run, "word string, n long, nx long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("nx").alias("nx"))


def _summed(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, sorted, and the sums of their counts."""
    packed.sort()
    numbers = packed >> COUNT_BITS
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[first], np.add.reduceat(packed & ((1 << COUNT_BITS) - 1), first) if len(first) else first


def _block(values: np.ndarray) -> bytes:
    """Unsigned numbers of 32 bits, byte by byte."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(block: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(block.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _numbered_pairs(texts: DataFrame, words: list[str], totals: np.ndarray, buckets: int, least: int, reach: int, chunk: int, stride: int) -> DataFrame:
    """x, y, n, nx, ny of pairs of ``words`` (a broadcast array), in both orders."""
    sent = texts.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), totals))
    k, wide = len(words), -(-len(words) // buckets)

    def blocks(numbers: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        ends = np.searchsorted(numbers, np.arange(buckets + 1) * (k * wide))
        used = np.flatnonzero(np.diff(ends))
        out = [codec.compress(_block(np.diff(numbers[ends[b] : ends[b + 1]], prepend=b * k * wide)) + _block(counts[ends[b] : ends[b + 1]]), asbytes=True) for b in used]
        if out:
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(np.diff(ends)[used].astype(np.int32)), pa.array(out, pa.binary())], ["bucket", "size", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = sent.value
        held = np.zeros(0, np.int64)
        for names, codes, places in _slices(batches):
            code = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            parts = [held]
            for d, at, c in _beside(places, reach, chunk, stride):
                one, two = code[at], code[at + d]
                both = (one >= 0) & (two >= 0)
                a, b = np.minimum(one, two)[both], np.maximum(one, two)[both]
                parts.append(((((b % buckets) * k + a) * wide + b // buckets) << COUNT_BITS) | c[both])
            numbers, counts = _summed(np.concatenate(parts))
            if len(numbers) > HELD or counts.max(initial=0) >= 1 << (COUNT_BITS - 1):
                yield from blocks(numbers, counts)
                held = np.zeros(0, np.int64)
            else:
                held = (numbers << COUNT_BITS) | counts
        yield from blocks(*_summed(held))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        known, nx = sent.value
        codec = pa.Codec("zstd")
        numbers, counts = [], []
        for size, block in zip(table["size"].to_pylist(), table["block"].to_pylist(), strict=True):
            raw = np.frombuffer(codec.decompress(block, 8 * size), np.uint8)
            numbers.append(_numbers(raw[: 4 * size]).cumsum())
            counts.append(_numbers(raw[4 * size :]))
        number, count = np.concatenate(numbers), np.concatenate(counts)
        order = np.argsort(number, kind="stable")  # sorted runs
        number, count = number[order], count[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        number, n = number[first], np.add.reduceat(count, first)
        a, b = number // wide, number % wide * buckets + key[0].as_py()
        n = np.where(a == b, 2 * n, n)
        keep = n >= least
        a, b, n = a[keep], b[keep], n[keep]
        two = a != b
        x, y, n = np.concatenate([a, b[two]]), np.concatenate([b, a[two]]), np.concatenate([n, n[two]])
        return pa.table({"x": known.take(pa.array(x)), "y": known.take(pa.array(y)), "n": n, "nx": nx[x], "ny": nx[y]})

    return texts.mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(joined, "x string, y string, n long, nx long, ny long")


def _other_pairs(texts: DataFrame, words: list[str], totals: DataFrame, least: int, reach: int, chunk: int, stride: int) -> DataFrame:
    """x, y, n, nx, ny of pairs with a word that isn't one of ``words``, in both orders."""
    sent = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, codes, places in _slices(batches):
            other = pc.is_null(pc.index_in(names, value_set=sent.value)).to_numpy(zero_copy_only=False)
            parts = []
            for d, at, c in _beside(places, reach, chunk, stride):
                one, two = codes[at], codes[at + d]
                some = other[one] | other[two]
                parts.append(((np.minimum(one, two)[some] * len(names) + np.maximum(one, two)[some]) << COUNT_BITS) | c[some])
            numbers, counts = _summed(np.concatenate(parts))
            one, two = names.take(pa.array(numbers // len(names))), names.take(pa.array(numbers % len(names)))
            ordered = pc.less(one, two)
            yield pa.record_batch([pc.if_else(ordered, one, two), pc.if_else(ordered, two, one), pa.array(counts)], ["x", "y", "n"])

    n = F.sum("n") * F.when(F.col("x") == F.col("y"), 2).otherwise(1)
    counted = texts.mapInArrow(run, "x string, y string, n long").groupBy("x", "y").agg(n.alias("n")).where(F.col("n") >= least)
    one = counted.join(totals.select(F.col("word").alias("x"), "nx"), "x").join(totals.select(F.col("word").alias("y"), F.col("nx").alias("ny")), "y")
    turned = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y", "nx", "ny"))).otherwise(F.array(F.struct("x", "y", "nx", "ny"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("ny").alias("nx"), F.col("nx").alias("ny"))))
    return one.select("n", F.explode(turned).alias("p")).select("p.x", "p.y", "n", "p.nx", "p.ny")


def pair_scores(texts: DataFrame, words_col: str = "words", least: int = 1, among: list[str] | None = None, numbered: int = NUMBERED, smoothing: float = 0.75, reach: int = 5, chunk: int = 24, stride: int = 12) -> DataFrame:
    """x, y, n, ppmi: the positive pointwise mutual information of ``style.ppmi(style.window_pairs(texts))``, of pairs
    with n of ``least`` or more. ``among``: only of pairs of these words (some thousands), with the totals
    of all words."""
    shared_folder(texts.sparkSession)
    lists = texts.select(words_col)
    totals = word_totals(lists, words_col, reach, chunk, stride).checkpoint()  # read three times
    whole = totals.agg(F.sum("nx").alias("tx"), F.sum(F.pow(F.col("nx").cast("double"), F.lit(smoothing))).alias("ty"), F.sum("n").alias("n"), F.count("*").alias("words")).first()
    common = totals.orderBy(F.desc("n"), "word").limit(numbered) if among is None else totals.join(F.broadcast(texts.sparkSession.createDataFrame([(w,) for w in among], "word string").distinct()), "word")
    top = common.select("word", "nx").toPandas()
    words, nx = top["word"].tolist(), top["nx"].to_numpy(np.int64)
    buckets = max(64, (whole["n"] or 0) // 250_000)
    pairs = _numbered_pairs(lists, words, nx, buckets, least, reach, chunk, stride)
    if among is None and whole["words"] > len(words):
        pairs = pairs.unionByName(_other_pairs(lists, words, totals, least, reach, chunk, stride))
    tx, ty = F.lit(float(whole["tx"] or 0)), F.lit(float(whole["ty"] or 0))
    score = F.log((F.col("n") / tx) / ((F.col("nx") / tx) * (F.pow(F.col("ny").cast("double"), F.lit(smoothing)) / ty)))
    return pairs.select("x", "y", "n", score.alias("ppmi")).where("ppmi > 0")
