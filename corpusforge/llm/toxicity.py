"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, decomposes letters (accents, full-width and mathematical forms) and drops marks and invisible
format characters, maps look-alike letters of other scripts to Latin ones, and digits and signs that stand for
letters to those letters in words that have a letter. The lexicon holds whole words and word beginnings
with weights; exception phrases take back the hits they cover: some everyday ones, and those learned, which are
pairs of neighbouring words that hold an entry but stand in clean texts. A word counts with its
heaviest entry. The score is a logistic function of the hits' weight, also by the text's length in words, so a
single hit in a long text counts for less.

Lexicon, exceptions and the logistic's coefficients are learned from a bounded sample of labelled rows. One row
of each group of near copies counts, so copies of one text can't make its rare words look toxic.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from math import exp, log1p
from unicodedata import normalize

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import by_chunks, held_out, map_texts
from corpusforge.session import workers_import

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏвкмнтαορνικτυχε", "aeopcyxijsdhlbkmhtaopviktuxe", strict=True))
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Everyday phrases that hold lexicon words (fixed values).
EXCEPTION_PHRASES = ("trash can", "trash bin", "class clown", "clown fish", "stupid question")
#: Labelled rows to learn from, about; all of them if there are fewer.
SAMPLE_ROWS = 16_000
#: Texts of the sample that an entry or a learned exception must have been in. The sample's rows and the letters of
#: beginnings and words bound the lexicon.
LEAST_TEXTS = 6
#: Least weight of an entry, a logarithm of odds, and of an exception, negative. Weaker entries are frequent words.
LEAST_WEIGHT, LEAST_EXCEPTION = 2.0, 1.0
PREFIX_CHARS = range(3, 13)
WORD_CHARS = 48

_FOLD = {ord(c): w for c, w in LOOKALIKES.items()} | {ord(c.upper()): w for c, w in LOOKALIKES.items() if len(c.upper()) == 1}
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_RUN = regex.compile(r"(?<![\p{L}0-9@$])\p{L}*+[0-9@$][\p{L}0-9@$]*+")  # begins at a run's beginning alone: linear
_LETTER = regex.compile(r"\p{L}")
_WORD = regex.compile(r"\p{L}+")
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}]+")
_SIGN = regex.compile(r"[0-9@$]\p{L}|\p{L}[0-9@$]")


def fold(text: str) -> str:
    """The folded text: words of lower-case letters, each after one space, and a space at the end."""
    if not text.isascii():
        text = _UNSEEN.sub("", normalize("NFKD", text)).translate(_FOLD)
    text = text.lower()
    if _SIGN.search(text):
        text = _RUN.sub(lambda m: m[0].translate(_SUBSTITUTE) if _LETTER.search(m[0]) else m[0], text)
    text = text.replace("l", "i")  # one sign for l, i and 1, which stand for each other
    return f" {' '.join(_WORD.findall(text))} "


@dataclass
class Model:
    """weights: entries as they stand in folded text, ' stem' for word beginnings and ' word ' for whole words."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.5, 1.0])

    def dumps(self) -> str:
        return json.dumps([self.weights, self.exceptions, self.coefficients])


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: Model):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.coefficients = model.coefficients

    def features(self, text: str) -> tuple[float, float, int]:
        """Weight of all hits; the same per 100 words; number of hits."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not words or not len(self.automaton):
            return 0.0, 0.0, 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (n, weight) in self.automaton.iter(folded):
            start = last - n + 1
            if weight is None:
                spared.append((start, last))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared and best:
            reach = np.maximum.accumulate([b for _, b in sorted(spared)])
            begins = sorted(a for a, _ in spared)
            best = {s: w for s, w in best.items() if not (k := bisect_right(begins, s)) or reach[k - 1] <= s}
        total = sum(best.values())
        return total, 100 * total / words, len(best)

    def score(self, text: str) -> tuple[float, int]:
        """The score from 0 to 1, and the number of hits."""
        total, rate, hits = self.features(text)
        a, b, c = self.coefficients
        return 1 / (1 + exp(-(a + b * log1p(total) + c * log1p(rate)))), hits


# Learning ------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """text and label of about ``rows`` labelled rows outside the held-out fold, chosen by their ids' hash.

    The labels of one id are its highest. Only the sample's ids and labels are broadcast; their number is
    bounded by ``rows``.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id")))
    usable = usable.groupBy("_id").agg(F.max("_label").alias("_label"))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(usable), "_id").select("text", F.col("_label").alias("label"))


def _copy_key(words: list[str]) -> int:
    """Equal for most near copies: the least hash of five words in a row."""
    grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(g) for g in grams) >> 1


def _candidates(words: list[str]) -> set[str]:
    """Possible entries of a folded text: its words and their beginnings."""
    out = set()
    for w in set(words):
        if len(w) <= WORD_CHARS:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIX_CHARS if n <= len(w))
    return out


def _pairs_with_hits(model: Model, words: list[str]) -> set[str]:
    """Possible exceptions of a folded text: neighbouring words of which one starts with an entry."""
    hit = [any(f" {w} "[:n] in model.weights for n in range(2, len(w) + 3)) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if (x or y) and len(a) + len(b) <= WORD_CHARS}


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """folded and label of one text of each group of near copies."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_chunks(batch, 0):
                folded = [fold(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([_copy_key(f.split()) for f in folded], pa.int64()), pa.array(folded), part.column(1).cast(pa.int32())], names=["key", "folded", "label"])

    return sample.mapInArrow(keyed, "key long, folded string, label int").groupBy("key").agg(F.min_by("folded", F.xxhash64("folded")).alias("folded"), F.max("label").alias("label")).select("folded", "label")


def _counted(once: DataFrame, entries_of: Callable[[list[str]], set[str]]) -> DataFrame:
    """entry, toxic, clean: in how many toxic and other texts of ``once`` each entry is that ``entries_of`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(entries_of(text.split()))
            for side, n in ((toxic, 1), (clean, 0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(side), pa.string()), pa.array([c * n for c in side.values()], pa.int64()), pa.array([c * (1 - n) for c in side.values()], pa.int64())], names=["entry", "toxic", "clean"])

    return once.mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[str, ...] = EXCEPTION_PHRASES) -> Model:
    """A model from the labelled rows outside the held-out fold; about ``rows`` of them are used.

    Without labelled rows, or with one label only, the lexicon is empty and every score is the same low value.
    """
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col).persist()
    try:
        n_toxic, n_clean = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
        if not n_toxic or not n_clean:
            return Model()
        odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
        once = _one_of_copies(sample).persist()
        scored = _counted(once, _candidates).withColumn("weight", odds).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") > LEAST_WEIGHT))
        found = {r["entry"]: (r["weight"], r["toxic"], r["clean"]) for r in scored.collect()}  # what the sample's toxic texts share
        model = Model({e: found[e][0] for e in sorted(_telling(found))}, [f" {fold(p).strip()} " for p in phrases])
        spared = _counted(once, partial(_pairs_with_hits, model)).withColumn("weight", odds).where((F.col("clean") >= LEAST_TEXTS) & (F.col("weight") < -LEAST_EXCEPTION))
        model.exceptions += sorted(r["entry"] for r in spared.select("entry").collect())
        once.unpersist()
        features = sample.select("text", "label").mapInArrow(_feature_rows(model), "total double, rate double, label int")
        x = np.array([tuple(r) for r in features.collect()])  # at most about ``rows`` rows of three numbers
        model.coefficients = _logistic(np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1])]), x[:, 2])
        return model
    finally:
        sample.unpersist()


def _telling(found: dict[str, tuple[float, int, int]]) -> list[str]:
    """The entries without word beginnings that say no more than a longer one: " idi" beside " idiot"."""
    longer: dict[str, int] = {}
    for entry, (_, toxic, _) in found.items():
        stem = entry.rstrip()
        for n in range(2, len(stem)):
            longer[stem[:n]] = max(longer.get(stem[:n], 0), toxic)
    return [e for e, (_, toxic, _) in found.items() if e.endswith(" ") or longer.get(e, 0) < 0.9 * toxic]


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            for part, texts in by_chunks(batch, 0):
                made = [matcher.features(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.float64()), part.column(1).cast(pa.int32())], names=["total", "rate", "label"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Coefficients by Newton's steps with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


_matchers: dict[str, Matcher] = {}


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (1 if score >= 0.5), hits of every row.

    A null or empty text has no hit and the lowest score of the model; a very long one is matched whole; a null id is
    treated as the empty id when the fold is told; repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty one. A scan and one map.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.dumps(), model))  # bounded by the sample

    def work(texts: list[str]) -> dict[str, pa.Array]:
        key, own = shared.value
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(own)
        matcher = _matchers[key]
        made = [matcher.score(t) for t in texts]
        return {"score": pa.array([s for s, _ in made], pa.float64()), "hits": pa.array([h for _, h in made], pa.int32())}

    scored = map_texts(docs, id_col, text_col, work, "score double, hits int")
    return scored.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns, whatever their names; null and empty
    texts stay, repeated rows stay or go together."""
    workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.dumps(), model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value[1])
        for batch in batches:
            for part, texts in by_chunks(batch, at):
                yield part.filter(pa.array([not t or matcher.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
