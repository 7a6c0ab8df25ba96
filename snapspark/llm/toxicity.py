"""Toxicity by a linear-chain conditional random field over words.

Words carry hashed features: the word itself, its first and last 3 to 5 bytes. Two states (plain, toxic) are tagged; the
weights are trained on labelled tokens by gradient steps on the exact log-likelihood, with forward-backward for the
expectations. Document labels become token labels by association: in a toxic document, words with a feature that occurs
in toxic training documents far more often than in others are labelled toxic.

Forward-backward gives every word's marginal of being toxic. A document's score is a logistic function, fitted on the
training documents, of its largest marginal and of the sum of its marginals; runs of words with a marginal of one half or
more are the offending spans.

Forward and backward messages are products of 2 x 2 matrices. They are computed for all words of a batch at once: in
blocks side by side, then over the blocks; a document's first word is a matrix that forgets what stood before.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, prefixed, text_or_empty
from .words import LETTERS, Piece, scan

FIT_ROWS = (3000, 1000)  # labelled documents that training takes at most: plain, toxic
FIT_BYTES = 1 << 16  # a longer document is scored but not trained on
SLOTS = 1 << 18
LEAST_DOCS, LEAST_ODDS = 5, 1.3  # toxic documents with a feature, and its log odds less two standard errors, that make it a mark
STEPS, RATE, RIDGE = 30, 0.5, 1e-4
CHUNK_WORDS = 1 << 17  # words that training holds messages of at once

FEATURES = 7


def features(piece: Piece) -> tuple[np.ndarray, ...]:
    """Feature slots of each word (words x FEATURES), and its byte places. A short word repeats the whole word."""
    starts, ends = piece.starts, piece.ends
    length = ends - starts
    columns = [piece.hashes()]
    for k in (3, 4, 5):
        cut = np.minimum(length, k)
        columns.append(piece.span_hash(starts, starts + cut) + np.uint64(2 * k))
        columns.append(piece.span_hash(ends - cut, ends) * np.uint64(2 * k + 1))
    slots = np.stack([(c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46) for c in columns], axis=1).astype(np.int32)
    return slots, *piece.places()


def _scan_products(steps: np.ndarray) -> np.ndarray:
    """Running products m[0] m[1] ... m[i] of 2 x 2 matrices, each scaled to a sum of one. `steps` is 4 x n: a row for each entry."""
    n = steps.shape[1]
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    padded = np.zeros((4, rows * width))
    padded[[0, 3], n:] = 1.0
    padded[:, :n] = steps
    grid = np.ascontiguousarray(padded.reshape(4, rows, width).transpose(2, 0, 1))
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for column in grid:
        e, f, g, h = column
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        scale = 1.0 / (a + b + c + d)
        a *= scale
        b *= scale
        c *= scale
        d *= scale
        column[0], column[1], column[2], column[3] = a, b, c, d
    before = np.empty((4, rows))
    w, x, y, z = 1.0, 0.0, 0.0, 1.0
    for r, (e, f, g, h) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        before[:, r] = w, x, y, z
        w, x, y, z = w * e + x * g, w * f + x * h, y * e + z * g, y * f + z * h
        total = w + x + y + z
        w, x, y, z = w / total, x / total, y / total, z / total
    e, f, g, h = (grid[:, i, :] for i in range(4))
    p, q, s, t = before
    out = np.stack([p * e + q * g, p * f + q * h, s * e + t * g, s * f + t * h])
    out /= out.sum(axis=0)
    return out.transpose(0, 2, 1).reshape(4, -1)[:, :n]


@dataclass
class Chain:
    """Weights: `emission` of the toxic state by feature slot (the plain state's are 0), `start` and `move` log potentials."""

    emission: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    odds: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0]))  # bias, largest marginal, sum of marginals

    def messages(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the toxic state, pair marginals (4 x n, of the word before and a word; 0 at first words)."""
        score = np.clip(self.emission[slots].sum(axis=1), -30, 30)
        toxic = 1 / (1 + np.exp(-score))
        plain = 1 - toxic
        (m00, m01), (m10, m11) = np.exp(self.move)
        s0, s1 = np.exp(self.start)
        step = np.stack([m00 * plain, m01 * toxic, m10 * plain, m11 * toxic])
        step[:, first] = np.stack([s0 * plain[first], s1 * toxic[first]] * 2)
        a, b, c, d = _scan_products(step)
        f0, f1 = a + c, b + d
        total = f0 + f1
        f0, f1 = f0 / total, f1 / total
        # The message from behind a word is the product of the steps after it; a last word starts anew.
        back = np.ones_like(step)
        back[:, :-1] = step[:, 1:]
        last = np.concatenate([first[1:], [True]])
        back[:, last] = 1.0
        a, b, c, d = _scan_products(back[[0, 2, 1, 3], ::-1])[[0, 2, 1, 3], ::-1]
        b0, b1 = a + b, c + d
        total = f0 * b0 + f1 * b1
        marginal = f1 * b1 / total
        pair = np.zeros_like(step)
        r0, r1 = plain[1:] * b0[1:], toxic[1:] * b1[1:]
        pair[:, 1:] = np.stack([f0[:-1] * m00 * r0, f0[:-1] * m01 * r1, f1[:-1] * m10 * r0, f1[:-1] * m11 * r1])
        pair[:, first] = 0
        total = pair.sum(axis=0)
        np.divide(pair, total, out=pair, where=total > 0)
        return marginal, pair

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        x = _document_features(largest, total) @ self.odds
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _document_features(largest: np.ndarray, total: np.ndarray) -> np.ndarray:
    squeeze = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    return np.stack([np.ones(len(largest)), squeeze(largest), np.log1p(total)], axis=1)


def _per_document(marginal: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest marginal and sum of marginals of each document; without words 0."""
    filled = np.diff(bounds) > 0
    largest, total = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    if filled.any():
        starts = bounds[:-1][filled]
        largest[filled] = np.maximum.reduceat(marginal, starts)
        total[filled] = np.add.reduceat(marginal, starts)
    return largest, total


def _firsts(bounds: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    return first[:n]


def _chunks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `limit` words."""
    row = 0
    while row < len(bounds) - 1:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, end
        row = end


def label_tokens(slots: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of toxic documents carry a feature associated with toxic documents."""
    seen = np.zeros((2, SLOTS), dtype=np.int64)
    for row, end in _chunks(bounds, CHUNK_WORDS):
        docs = np.repeat(np.arange(row, end), np.diff(bounds[row : end + 1]))
        flat = np.unique(np.repeat(docs, FEATURES).astype(np.int64) * SLOTS + slots[bounds[row] : bounds[end]].ravel())
        kinds = toxic[flat // SLOTS]
        for kind in (0, 1):
            seen[kind] += np.bincount(flat[kinds == kind] % SLOTS, minlength=SLOTS)
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    doubt = 2 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    marks = (seen[1] >= LEAST_DOCS) & (odds - doubt >= LEAST_ODDS)
    return marks[slots].any(axis=1) & np.repeat(toxic, np.diff(bounds))


def train(slots: np.ndarray, bounds: np.ndarray, labels: np.ndarray, toxic: np.ndarray) -> Chain:
    """Weights from labelled tokens (AdaGrad on the full log-likelihood), then the document's logistic function."""
    chain = Chain(np.full(SLOTS, -0.5 / FEATURES))
    first = _firsts(bounds, len(slots))
    before = np.concatenate([[0], labels[:-1].astype(int)])
    seen_move = np.bincount(2 * before[~first] + labels[~first], minlength=4).reshape(2, 2)
    seen_start = np.bincount(labels[first].astype(int), minlength=2)
    squares = [np.full(SLOTS, 1e-8), np.full(2, 1e-8), np.full((2, 2), 1e-8)]
    runs = [slice(bounds[row], bounds[end]) for row, end in _chunks(bounds, CHUNK_WORDS) if bounds[end] > bounds[row]]
    for _ in range(STEPS):
        slopes = [-RIDGE * chain.emission, seen_start.astype(float), seen_move.astype(float)]
        for run in runs:
            marginal, pair = chain.messages(slots[run], first[run])
            residual = np.repeat(labels[run] - marginal, FEATURES)
            slopes[0] += np.bincount(slots[run].ravel(), weights=residual, minlength=SLOTS)
            starting = marginal[first[run]].sum()
            slopes[1] -= (first[run].sum() - starting, starting)
            slopes[2] -= pair.sum(axis=1).reshape(2, 2)
        for weight, slope, square in zip((chain.emission, chain.start, chain.move), slopes, squares):
            square += slope**2
            weight += RATE * slope / np.sqrt(square)
    marginal = np.concatenate([chain.messages(slots[run], first[run])[0] for run in runs] or [np.zeros(0)])
    chain.odds = _logistic(_document_features(*_per_document(marginal, bounds)), toxic.astype(float))
    return chain


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a ridge, so that separable classes give finite weights."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (y - p) - 0.1 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int]) -> DataFrame:
    """(text, toxic) of at most `fit_rows` labelled documents (plain, toxic), chosen by a hash of the id; one partition."""
    usable = labels.where(labels["toxic"].isin(0, 1) & (fold(labels["doc_id"]) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(2))
    chosen = [usable.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(fit_rows[kind]) for kind in (0, 1)]
    texts = docs.where(docs["text"].isNotNull() & (F.octet_length(docs["text"]) <= FIT_BYTES)).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").orderBy(order, "doc_id", "text").limit(sum(fit_rows))
    return found.select("text", "toxic")


def train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task that trains: a pickled chain from all its rows, or nothing if they lack one of the classes."""
    slots, sizes, flags = [np.zeros((0, FEATURES), np.int32)], [], []
    for batch in batches:
        flags.append(batch.column("toxic").to_numpy().astype(bool))
        for _, _, bounds, found, _, _ in scan(batch.column("text"), LETTERS, features):
            slots.append(found)
            sizes.append(np.diff(bounds))
    toxic = np.concatenate(flags) if flags else np.zeros(0, dtype=bool)
    if toxic.any() and not toxic.all():
        words, bounds = np.concatenate(slots), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        slots.clear()
        chain = train(words, bounds, label_tokens(words, bounds, toxic), toxic)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> Chain | None:
    """A trained chain, or None if the training labels don't have both classes.

    Training runs in a task over the bounded sample, not in the driver; the driver gets the weights.
    """
    found = training_rows(docs, labels, fit_rows).mapInArrow(train_rows, "chain binary").collect()
    return pickle.loads(found[0]["chain"]) if found else None


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def _spans(marginal: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """Runs of words with a marginal of at least one half, as byte places."""
    hot = marginal >= 0.5
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    if not hot.any():
        return out
    first = _firsts(bounds, len(hot))
    begin = np.flatnonzero(hot & (first | ~np.concatenate([[False], hot[:-1]])))
    stop = np.flatnonzero(hot & (np.concatenate([first[1:], [True]]) | ~np.concatenate([hot[1:], [False]])))
    rows = np.searchsorted(bounds, begin, side="right") - 1
    for a, b, row in zip(begin.tolist(), stop.tolist(), rows.tolist()):
        out[row].append({"start": int(starts[a]), "end": int(ends[b]), "marginal": float(marginal[a : b + 1].max())})
    return out


def tag_batches(model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = model.value
        for batch in batches:
            scores, spans = [], []
            for _, _, bounds, slots, starts, ends in scan(batch.column(column), LETTERS, features, 1 << 18):
                marginal = chain.messages(slots, _firsts(bounds, len(slots)))[0] if len(slots) else np.zeros(0)
                scores.append(chain.score(*_per_document(marginal, bounds)))
                spans += _spans(marginal, bounds, starts, ends)
            yield pa.RecordBatch.from_arrays(
                [*(c for c, name in zip(batch.columns, batch.schema.names) if name != column), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, SPANS)],
                names=[*(name for name in batch.schema.names if name != column), "score", "spans"],
            )

    return run


def tag(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """The `columns` of `docs` (all by default) with score (0 to 1) and spans (start and end as byte places, marginal).

    Labels are learnt only from rows of `labels` whose crc32(doc_id as text) mod 5 is not 0; a doc_id with several labels
    counts as toxic if one says so; rows with null labels are left out. Null, blank and wordless texts score as documents
    without a toxic word. Without training labels of both classes every score is 0 and no span is found. Columns of
    `docs` named score or spans are replaced. Rows are scored one by one, repeated ones alike.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("score", "spans")]
    chain = fit(docs, labels, fit_rows)
    text = fresh(docs, "text_scored")
    rows = docs.select(*[docs[f"`{c}`"] for c in columns], text_or_empty(docs).alias(text))
    if chain is None:
        return rows.drop(text).withColumn("score", F.lit(0.0)).withColumn("spans", F.array().cast("array<struct<start:long,end:long,marginal:double>>"))
    model = docs.sparkSession.sparkContext.broadcast(chain)
    return rows.mapInArrow(tag_batches(model, text), prefixed(rows.drop(text), "score double, spans array<struct<start:long,end:long,marginal:double>>"))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> DataFrame:
    """The rows and columns of `docs` that score below one half."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    work = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()], docs["doc_id"], docs["text"])
    kept = tag(work, labels, fit_rows, list(names.values())).where("score < 0.5")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
