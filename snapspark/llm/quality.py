"""Quality scores by random Fourier features of document statistics, ridge regression and isotonic calibration.

Each document is put into some twenty statistics of its bytes, words and lines (none of labels, lang, source or ids).
Standardised, they go through cosines with random frequencies, whose inner products approximate a Gaussian kernel. The
normal equations of the ridge are sums over documents: every task sums up its rows and the sums are added in a tree, so
the driver gets matrices of `FEATURES` x `FEATURES` whatever the number of labelled documents. Raw scores are counted
in `BINS` bins with their labels on a part of the training documents that the ridge has not seen, and pooling adjacent
violators over the bins gives a monotone map to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored, text_or_empty
from .words import SPACES, Piece, scan

FEATURES = 256
RIDGE = 1.0
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
BINS = 200
SEED = 3

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "long_words", "distinct_words", "repeated_next", "commonest_word",
    "upper", "digits", "signs", "non_ascii", "line_ends", "log_lines", "stops", "commas", "bars", "upper_words", "sign_ended", "distinct_lines",
)

_KINDS = np.zeros((7, 256), dtype=bool)
_KINDS[0, 65:91] = True
_KINDS[1, 48:58] = True
_KINDS[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
_KINDS[3, 128:] = True
_KINDS[4, 10] = True
_KINDS[5, [ord(c) for c in ".!?"]] = True
_KINDS[6, ord(",")] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[ord("|")] = True
_ENDING = _KINDS[2].copy()
_ENDING[[ord(c) for c in ".,;:?\"')"]] = False
_NO_LINE_END = np.array([b == 10 for b in range(256)])


def _word_measures(piece: Piece) -> tuple[np.ndarray, ...]:
    upper = np.concatenate([[0], np.cumsum(_KINDS[0][piece.data])])
    length = piece.ends - piece.starts
    return piece.hashes(), length, upper[piece.ends] - upper[piece.starts] >= np.maximum(2, 0.6 * length), _ENDING[piece.data[piece.ends - 1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, all finite; an empty text has zeros."""
    from .words import text_bytes

    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    share = {name: i for i, name in enumerate(STATISTICS)}
    for row in range(n):
        size = int(offsets[row + 1] - offsets[row])
        if not size:
            continue
        counts = np.zeros(256, dtype=np.int64)
        for at in range(int(offsets[row]), int(offsets[row + 1]), 1 << 20):
            counts += np.bincount(data[at : min(at + (1 << 20), int(offsets[row + 1]))], minlength=256)
        kinds = _KINDS @ counts
        out[row, share["log_bytes"]] = np.log1p(size)
        for name, value in zip(("upper", "digits", "signs", "non_ascii", "line_ends", "stops", "commas"), kinds):
            out[row, share[name]] = value / size
        out[row, share["bars"]] = counts[_BAR].sum() / size
        out[row, share["log_lines"]] = np.log1p(kinds[4])
    for first, _, bounds, hashes, length, upper, ending in scan(column, SPACES, _word_measures):
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if a == b:
                continue
            row, words, long = first + i, b - a, length[a:b]
            _, times = np.unique(hashes[a:b], return_counts=True)
            out[row, share["log_words"]] = np.log1p(words)
            out[row, share["word_bytes"]] = np.log1p(long.mean())
            out[row, share["word_bytes_spread"]] = np.log1p(long.std())
            out[row, share["long_words"]] = (long > 20).mean()
            out[row, share["distinct_words"]] = len(times) / words
            out[row, share["repeated_next"]] = (hashes[a + 1 : b] == hashes[a : b - 1]).mean() if words > 1 else 0
            out[row, share["commonest_word"]] = times.max() / words
            out[row, share["upper_words"]] = upper[a:b].mean()
            out[row, share["sign_ended"]] = ending[a:b].mean()
    for first, _, bounds, hashes in scan(column, _NO_LINE_END, lambda p: (p.hashes(),)):
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b > a:
                out[first + i, share["distinct_lines"]] = len(np.unique(hashes[a:b])) / (b - a)
    return out


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = statistics(batch.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    places: np.ndarray | None = None  # raw scores, rising, and their probabilities
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.places, self.values)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _normal_equations(model: Model):
    def run(rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = len(model.phases) + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        batch: list = []

        def add() -> None:
            z = model.features(np.array([r[0] for r in batch]))
            left.__iadd__(z.T @ z)
            right.__iadd__(z.T @ np.array([r[1] for r in batch], dtype=float))
            batch.clear()

        for row in rows:
            batch.append(row)
            if len(batch) == 2000:
                add()
        if batch:
            add()
        yield left, right

    return run


def isotonic(places: np.ndarray, good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising values nearest to good / total, by weight."""
    blocks: list[list[float]] = []
    for g, t in zip(good, total):
        blocks.append([float(g), float(t), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, t2, n2 = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    # A half observation of each kind keeps probabilities off 0 and 1.
    return np.concatenate([np.full(int(n), (g + 0.5) / (t + 1)) for g, t, n in blocks])


def fit(measured: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH) -> Model | None:
    """A model from measured documents (doc_id, x) and labels, or None if there are no training labels of both kinds.

    Of the training rows (crc32 mod 5 not 0), those with remainder 4 calibrate and the others fit the ridge.
    """
    known = labels.where(labels["quality"].isin(0, 1) & (fold(labels["doc_id"]) != 0)).select("doc_id", F.col("quality").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = stored(measured.join(known, "doc_id").select("x", "y", (fold(F.col("doc_id")) == 4).alias("calibrates")), "quality-rows")
    fits = rows.where("not calibrates")
    d = len(STATISTICS)
    found = fits.agg(F.count("*"), F.sum("y"), *[f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not found[0] or not found[1] or found[0] == found[1]:
        return None
    moments = np.array(found[2:], dtype=float).reshape(d, 2)
    random = np.random.default_rng(SEED)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6), random.normal(size=(d, features)) / (width * np.sqrt(d / 4)), random.uniform(0, 2 * np.pi, features))
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    left, right = fits.select("x", "y").rdd.mapPartitions(_normal_equations(model)).treeReduce(add, 2)
    model.weights = np.linalg.solve(left + ridge * np.eye(len(right)), right)
    held = rows.sparkSession.sparkContext.broadcast(model)
    counted = rows.where("calibrates").mapInArrow(_raw_scores(held), "raw double, y int")
    bins = counted.groupBy(F.least(F.greatest(F.round(F.col("raw") * BINS), F.lit(-BINS)), F.lit(2 * BINS)).alias("bin")).agg(
        F.avg("raw").alias("raw"), F.sum("y").alias("good"), F.count("*").alias("n")
    ).orderBy("bin").collect()
    if bins:
        model.places = np.array([r["raw"] for r in bins])
        model.values = isotonic(model.places, np.array([r["good"] for r in bins]), np.array([r["n"] for r in bins]))
    else:
        model.places, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _raw_scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.raw(_matrix(batch.column("x")))), batch.column("y")], names=["raw", "y"])

    return run


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """One row per document: doc_id, score (0 to 1).

    Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0; a doc_id with several labels counts as bad
    if one says so; rows with null labels are left out. Null texts are empty, and empty texts are scored like others, by
    statistics that are all 0. Without training labels of both kinds every score is one half. Repeated rows score alike.
    Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    measured = stored(rows.mapInArrow(measure, "doc_id long, x array<double>"), "statistics")
    model = fit(measured, labels, features)
    if model is None:
        return measured.select("doc_id", F.lit(0.5).alias("score"))
    return measured.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
