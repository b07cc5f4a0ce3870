"""Text quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a document. Each task sums
its rows' normal equations; the sums, one small matrix for each task, are added and solved. A part of the sample
that the fit doesn't see calibrates the scores by pool-adjacent-violators, so a score is a share of good texts.
Statistics, fit and calibration see a bounded sample of labelled rows; scoring is one scan and one map.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import by_chunks, held_out, map_texts
from corpusforge.llm.toxicity import labelled_sample

#: Labelled rows to learn from, about; all of them if there are fewer.
SAMPLE_ROWS = 24_000
#: Random features; the kernel's width in standard deviations; the ridge.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1.0
SEED = 20_240_917
#: Tasks that sum the normal equations.
SUM_TASKS = 8
STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "bar", "exclaim", "stop", "space", "other", "entropy", "distinct", "commonest", "repeats", "line_length", "line_repeats", "capitalised")

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",;:'\"()-", b"*#$%&@^~+=<>{}[]\\/_`", b"|", b"!?", b".", b" \t\n\r\v\f"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of STATISTICS; all 0 for a text without characters."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    total = int(counts.sum())
    share = np.bincount(_CLASS, weights=counts, minlength=10) / total
    p = counts[counts > 0] / total
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = text.split("\n")
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        *share[1:10],
        float(-(p * np.log2(p)).sum()),
        np.log1p(len(seen)) / np.log1p(n),
        max(seen.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(map(str.istitle, words)) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a constant."""
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos((x - self.mean) / self.scale @ directions + phases)
        return np.column_stack([z, np.ones(len(x))])

    def ridge_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge_scores(x), self.raw, self.calibrated)


def _sample_statistics(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_chunks(batch, 0):
                made = [statistics(t) for t in texts]
                # a third of the distinct texts calibrates; equal texts fall to the same side
                side = [hash_of(t) % 3 == 0 for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), part.column(1).cast(pa.float64()), pa.array(side)], names=["x", "y", "calibrates"])

    return sample.mapInArrow(run, "x array<double>, y double, calibrates boolean")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: summed in each task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz = np.zeros((FEATURES + 1, FEATURES + 1))
        zy = np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist()))
                zz += z.T @ z
                zy += z.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()], pa.binary()), pa.array([zy.tobytes()], pa.binary())], names=["zz", "zy"])

    parts = rows.select("x", "y").mapInArrow(run, "zz binary, zy binary").collect()  # SUM_TASKS rows
    zz = sum(np.frombuffer(r["zz"]).reshape(FEATURES + 1, -1) for r in parts)
    return zz, sum(np.frombuffer(r["zy"]) for r in parts)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' mean places and values, both rising."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([s / n for s, _, n in blocks]), np.array([t / n for _, t, n in blocks])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about ``rows`` labelled rows outside the held-out fold.

    Without labelled rows every score is 0.5; with one label only, that label's value.
    """
    sample = _sample_statistics(labelled_sample(docs, labels, label, rows, id_col, text_col)).repartition(SUM_TASKS).persist()
    try:
        n = len(STATISTICS)
        moments = sample.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(n)], *[F.stddev_pop(F.col("x")[i]) for i in range(n)]).first()
        if not moments[0]:
            return Model(np.zeros(n), np.ones(n), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
        scale = np.array([s if s > 1e-9 else 1.0 for s in moments[n + 1 :]])
        model = Model(np.array(moments[1 : n + 1]), scale, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
        zz, zy = _sums(sample.where("not calibrates"), model)
        model.weights = np.linalg.solve(zz + RIDGE * np.eye(FEATURES + 1), zy)
        if kept := sample.where("calibrates").select("x", "y").collect():  # about a third of the sample's rows
            raw = model.ridge_scores(np.array([r["x"] for r in kept]))
            model.raw, model.calibrated = isotonic(raw, np.array([r["y"] for r in kept]))
        return model
    finally:
        sample.unpersist()


def quality(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row.

    A null text is the empty one, whose statistics are all 0; a very long one is measured whole; a null id is treated
    as the empty id when the fold is told; repeated rows give repeated results; equal raw scores give equal scores;
    other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return {"score": pa.array(np.clip(shared.value.scores(x), 0.0, 1.0), pa.float64())}

    scored = map_texts(docs, id_col, text_col, work, "score double")
    return scored.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
