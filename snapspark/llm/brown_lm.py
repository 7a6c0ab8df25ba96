"""Language-model scores by class-based bigrams, with classes from exchange clustering.

Every training word has a class of its own choosing, in a table (word, n, class) of the shared folder. It starts from a
clustering of items: the `WORDS` most frequent words, and `ENDINGS` groups of all other words by a hash of their last three
bytes; an item's class is exchanged for the one that raises the likelihood of the class bigrams most, over and over, until
a pass moves nothing. Then come rounds over words (`refine`): tasks count the classes before and behind each word, these
cells are summed up as they stream by in the order of words, and each word takes the class that makes its own places
likeliest under the class bigrams of the round. A round that lowers the likelihood of the class bigrams is given up; rounds
end with it, when no word moves, or when one gains less than `LEAST_GAIN` of what the rounds before it gained.

    P(word | before) = P(class | class before) * P(word | class)

with class transitions smoothed towards class frequencies and add-half estimates of words. Ending groups only give classes
to words that training lacks: each class has one unseen word for each of its endings. Texts begin behind a start item and
end with an end token.

Counts and classes of the words that occur most, up to `KNOWN` of them (34 MB), are broadcast; the others meet theirs in
joins, once for each distinct word, or pair with such a word, of a document. In the first round all words have their class
by their item, so nothing is joined. A word that occurs once chooses by the classes at its one place, so that wherever it
stands in a training text its class is worked out on the spot; where all words that are not at hand occur once, training
texts join nothing. Bigrams themselves are never written: tasks sum them up to cells or pairs of classes.
Words are 64-bit hashes; cells are gathered by the upper 57 bits, and words that share these choose alike. What the driver
holds is bounded by the numbers of items, classes and known words.
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

WORDS, ENDINGS, CLASSES = 512, 512, 64
KNOWN = 1 << 21
PASSES = 12
ROUNDS, LEAST_GAIN = 1, 0.1
HELD_WORDS = 1 << 19  # counted words a task holds before it passes them on
HELD_CELLS = 5 << 20  # neighbours a task holds before it passes them on
WEIGHT = 20.0  # of class frequencies in smoothed transitions
START, END = WORDS + ENDINGS, WORDS + ENDINGS + 1
ITEMS = WORDS + ENDINGS + 2
END_HASH = np.uint64(0x0E4D)  # stands for the end token among word hashes


def word_measures(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    tail = piece.span_hash(np.maximum(piece.starts, piece.ends - 3), piece.ends)
    return piece.hashes(), (tail % np.uint64(ENDINGS)).astype(np.int32)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending, n), summed up over many texts of a task; every row ends with the end token."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((np.array([END_HASH]), np.array([-1], dtype=np.int32), np.array([batch.num_rows])))
        for _, _, _, found, ending in scan(batch.column("text"), SPACES, word_measures):
            values, first, times = np.unique(found, return_index=True, return_counts=True)
            held.append((values, ending[first], times))
            size += len(values)
            if size > 4 * HELD_WORDS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_WORDS:
                    yield _counted(*held[0])
                    held, size = [], 0
    if held:
        yield _counted(*_summed(held))


def _summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, endings, times = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(values)
    values = values[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[heads], endings[order][heads], np.add.reduceat(times[order], heads)


def _counted(values: np.ndarray, endings: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(endings), pa.array(times.astype(np.int64))], names=["word", "ending", "n"])


def _items(hashes: np.ndarray, endings: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Items of words; `frequent` has the sorted hashes of the frequent words, whose items are their places."""
    items = WORDS + endings.astype(np.int64)
    if len(frequent):
        place = np.searchsorted(frequent, hashes)
        place[place == len(frequent)] = 0
        known = frequent[place] == hashes
        items[known] = place[known]
    return items


def _bigrams(items: np.ndarray, bounds: np.ndarray, start: int = START, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items before and after, and row numbers, of all bigrams from each row's start to its end."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds) + 1
    ends = np.cumsum(sizes)
    after = np.empty(len(items) + rows, dtype=np.int64)
    after[ends - 1] = end
    words = np.ones(len(after), dtype=bool)
    words[ends - 1] = False
    after[words] = items
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[ends - sizes] = start
    return before, after, np.repeat(np.arange(rows), sizes)


def count_bigrams(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ITEMS * ITEMS, dtype=np.int64)
        for batch in batches:
            for _, _, bounds, hashes, endings in scan(batch.column("text"), SPACES, word_measures):
                before, after, _ = _bigrams(_items(hashes, endings, frequent.value), bounds)
                code, times = np.unique(before * ITEMS + after, return_counts=True)
                seen[code] += times
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(seen[code])], names=["code", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Classes of items from their bigram counts; the start and the end item have the last two classes for themselves."""
    free = classes - 2
    totals = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-totals[: ITEMS - 2], kind="stable")
    of = np.empty(ITEMS, dtype=np.int64)
    of[order] = np.arange(ITEMS - 2) % free
    of[START], of[END] = free, free + 1
    into = np.zeros((ITEMS, classes))
    into[np.arange(ITEMS), of] = 1
    right, left = n @ into, n.T @ into  # counts of an item before a class, and behind one
    pairs = into.T @ right
    firsts, seconds = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(passes):
        moved = 0
        for w in order:
            if not totals[w]:
                continue
            own, same = of[w], n[w, w]
            a, b = right[w].copy(), left[w].copy()
            a[own] -= same
            b[own] -= same
            pairs[own] -= a
            pairs[:, own] -= b
            pairs[own, own] -= same
            out, back = a.sum() + same, b.sum() + same
            firsts[own] -= out
            seconds[own] -= back
            rows = (_xlogx(pairs + a) - _xlogx(pairs)).sum(axis=1)
            columns = (_xlogx(pairs + b[:, None]) - _xlogx(pairs)).sum(axis=0)
            middle = np.diagonal(pairs)
            corner = _xlogx(middle + a + b + same) + _xlogx(middle) - _xlogx(middle + a) - _xlogx(middle + b)
            gain = rows + columns + corner - _xlogx(firsts + out) + _xlogx(firsts) - _xlogx(seconds + back) + _xlogx(seconds)
            best = int(np.argmax(gain[:free]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            pairs[best] += a
            pairs[:, best] += b
            pairs[best, best] += same
            firsts[best] += out
            seconds[best] += back
            if best != own:
                moved += 1
                of[w] = best
                right[:, own] -= n[:, w]
                right[:, best] += n[:, w]
                left[:, own] -= n[w]
                left[:, best] += n[w]
        if not moved:
            break
    return of


@dataclass
class Model:
    frequent: np.ndarray  # sorted hashes of the frequent words
    of: np.ndarray  # classes of items
    pairs: np.ndarray  # counts of class bigrams by them
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10 of item given class; for endings also less the denominator of their words
    end_count: int
    tokens: int
    distinct: int


def estimate(n: np.ndarray, of: np.ndarray, words: np.ndarray, tokens_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions in log10 from item bigrams; `words` and `tokens_of` are distinct words and tokens of each ending."""
    into = np.zeros((ITEMS, CLASSES))
    into[np.arange(ITEMS), of] = 1
    pairs = into.T @ n @ into
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    transition = (pairs + WEIGHT * share) / (pairs.sum(axis=1, keepdims=True) + WEIGHT)
    seen = n.sum(axis=0)
    emission = (seen + 0.5) / ((into.T @ seen)[of] + 0.5 * into.sum(axis=0)[of])
    emission[WORDS : WORDS + ENDINGS] /= tokens_of + 0.5 * (words + 1)
    return np.log10(transition), np.log10(emission)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the training documents (`text`), and the counts of all their words (word, ending, n)."""
    context = docs.sparkSession.sparkContext
    counts = stored(
        docs.mapInArrow(count_words, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n")), "counts"
    )
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("word") != int(np.int64(END_HASH))).orderBy(F.desc("n"), "word").limit(WORDS).select("word").toArrow()
    frequent = np.sort(top.column("word").to_numpy().astype(np.int64).view(np.uint64))
    held = context.broadcast(frequent)
    cells = docs.mapInArrow(count_bigrams(held), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(ITEMS * ITEMS)
    n[cells.column("code").to_numpy()] = cells.column("n").to_numpy()
    n = n.reshape(ITEMS, ITEMS)
    rest = counts.where((F.col("ending") >= 0) & ~F.col("word").isin([int(x) for x in frequent.view(np.int64)]))
    words, tokens_of = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in rest.groupBy("ending").agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect():
        words[row["ending"]], tokens_of[row["ending"]] = row["words"], row["tokens"]
    of = exchange(n)
    transition, emission = estimate(n, of, words, tokens_of)
    into = np.zeros((ITEMS, CLASSES))
    into[np.arange(ITEMS), of] = 1
    return Model(frequent, of, into.T @ n @ into, transition, emission, int(n[:, END].sum()), int(tokens), int(distinct)), counts


class Index:
    """Places of hashes in a sorted array, by buckets of their leading bits; -1 for hashes that are not in it."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(1, int(len(known)).bit_length())
        heads = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        edges = np.zeros(len(heads), dtype=np.int64)
        edges[:-1] = np.searchsorted(known, heads[:-1].astype(np.uint64))
        edges[-1] = len(known)
        self.edges = edges.astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.known):
            return out
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.edges[bucket].astype(np.int64), self.edges[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            here = at[open_]
            same = self.known[here] == hashes[open_]
            out[open_[same]] = here[same]
            open_, here = open_[~same], here[~same] + 1
            at[open_] = here
            open_ = open_[here < end[open_]]
        return out


@dataclass
class Classes:
    """Classes of all training words: those of the known ones at hand, all of them in `table` (word, n, class).

    Words of fewer than `cut` occurrences are not at hand.
    """

    table: DataFrame
    cut: int
    index: Index
    counts: np.ndarray
    of: np.ndarray
    pairs: np.ndarray | None = None  # counts of class bigrams
    single: np.ndarray | None = None  # class of a word that occurs once, by the first classes before it, behind it and its own

    def lookup(self, model: Model) -> tuple:
        """What tasks need to find the classes of tokens."""
        return self.index, self.of, model.frequent, model.of, self.single if self.cut <= 2 else None


def first_classes(model):
    """(word, n, class) of counted words, by the classes of their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, of = model.value
        for batch in batches:
            word, ending = batch.column("word").to_numpy(), batch.column("ending").to_numpy()
            own = np.where(ending < 0, of[END], of[_items(word.view(np.uint64), np.maximum(ending, 0), frequent)])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(own.astype(np.int32))], names=["word", "n", "class"])

    return run


def at_hand(table: DataFrame, most: int) -> Classes:
    """The classes of a table with those of the most frequent words, at most `most` of them, in memory."""
    words = table.where(F.col("word") != int(np.int64(END_HASH)))
    # Counts up to 1,024 as they are, above by sixteenths of a doubling: some 2,000 steps at most.
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(864 + F.floor(F.log2("n") * 16)).cast("long")
    taken, cut = 0, None
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        taken += row["words"]
        if taken > most:
            break
        cut = row["least"]
    found = words.where(F.col("n") >= cut).toArrow() if cut is not None else words.limit(0).toArrow()
    hashes = found.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counts, of = (found.column(c).to_numpy()[order] for c in ("n", "class"))
    return Classes(table, cut if cut is not None else 1 << 62, Index(hashes[order]), counts.astype(np.int64), of.astype(np.int8))


class _Tokens:
    """Bigrams of whole rows with the places of known words and classes; -1 for others.

    Classes are those of known words, or without an index those of the items. `learnt` tells which rows are training texts:
    there, if `single` is given, all words that are not known occur once, and their classes follow from their places.
    """

    def __init__(self, hashes: np.ndarray, endings: np.ndarray, bounds: np.ndarray, classes: tuple, learnt: np.ndarray | None = None):
        n = len(hashes)
        index, of, frequent, of_items, single = classes
        self.before, self.after, self.row = _bigrams(np.arange(n), bounds, n + 1, n)
        self.hash = np.concatenate([hashes, [END_HASH, np.uint64(0)]]).view(np.int64)
        self.single = np.zeros(n, dtype=bool)
        outside = [CLASSES - 1, CLASSES - 2]
        if index is None:
            self.place = np.full(n, -1, dtype=np.int64)
            self.own = np.concatenate([of_items[_items(hashes, endings, frequent)], outside])
            return
        self.place = index.find(hashes)
        own = np.where(self.place >= 0, of[self.place] if len(of) else -1, -1).astype(np.int64)
        if single is not None:
            self.single = self.place < 0
            if learnt is not None:
                self.single &= np.repeat(learnt, np.diff(bounds))
            at = np.flatnonzero(self.single)
            first = np.concatenate([of_items[_items(hashes, endings, frequent)], outside])
            behind, ahead = np.empty(n + 2, dtype=np.int64), np.empty(n + 2, dtype=np.int64)
            behind[self.before], ahead[self.after] = self.after, self.before
            own[at] = single[first[ahead[at]], first[behind[at]], first[at]]
        self.own = np.concatenate([own, outside])


CELL_BITS = 7  # side * CLASSES + class
CELL = np.dtype([("cell", "u1"), ("n", ">u4")])


def _packed(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row (key, cells) for each run of equal words; `keys` have the cell in their last bits."""
    words = keys >> np.uint64(CELL_BITS)
    heads = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    packed = np.empty(len(keys), dtype=CELL)
    packed["cell"], packed["n"] = keys & np.uint64((1 << CELL_BITS) - 1), times
    offsets = (np.concatenate([heads, [len(words)]]) * CELL.itemsize).astype(np.int32)
    cells = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(words[heads].astype(np.int64)), cells], names=["key", "cells"])


def neighbours(classes):
    """(key, cells): classes behind (side 0) and before (side 1) words, counted; for neighbours whose class is at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes = classes.value
        low = np.uint64((1 << CELL_BITS) - 1)
        held, size = [], 0
        for batch in batches:
            for _, _, bounds, hashes, endings in scan(batch.column("text"), SPACES, word_measures):
                t = _Tokens(hashes, endings, bounds, own_classes)
                for side, (own, other) in enumerate(((t.before, t.after), (t.after, t.before))):
                    kind = t.own[other]
                    met = (own < len(hashes)) & (kind >= 0)  # the start and the end choose no class
                    held.append((t.hash[own[met]].view(np.uint64) & ~low) | (side * CLASSES + kind[met]).astype(np.uint64))
                    size += len(held[-1])
                if size > HELD_CELLS:
                    yield _packed(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield _packed(*np.unique(np.concatenate(held), return_counts=True))

    return run


def unmet(classes):
    """(word, other, side): places whose neighbour `other` has no class at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes = classes.value
        for batch in batches:
            for _, _, bounds, hashes, endings in scan(batch.column("text"), SPACES, word_measures):
                t = _Tokens(hashes, endings, bounds, own_classes)
                for side, (own, other) in enumerate(((t.before, t.after), (t.after, t.before))):
                    rest = np.flatnonzero((own < len(hashes)) & (t.own[other] < 0))
                    columns = [pa.array(t.hash[own[rest]]), pa.array(t.hash[other[rest]]), pa.array(np.full(len(rest), side, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "other", "side"])

    return run


def smoothed(pairs: np.ndarray) -> np.ndarray:
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    return (pairs + WEIGHT * share) / (pairs.sum(axis=1, keepdims=True) + WEIGHT)


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, less what is the same for all classes of the words."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def _best(gain: np.ndarray, own: np.ndarray) -> np.ndarray:
    best, at = gain[:, : CLASSES - 2].argmax(axis=1), np.arange(len(own))
    return np.where((own >= CLASSES - 2) | (gain[at, best] <= gain[at, own] + 1e-9), own, best)


def single_classes(pairs: np.ndarray) -> np.ndarray:
    """The best class of a word that occurs once, by the class before it, the class behind it and its own."""
    forth, each = np.log(smoothed(pairs)), np.log(pairs.sum(axis=0) + 1)
    gain = (forth[:, None, :] + forth.T[None, :, :] - each).reshape(-1, CLASSES)
    return np.stack([_best(gain, np.full(len(gain), own)) for own in range(CLASSES)], axis=1).reshape(CLASSES, CLASSES, CLASSES).astype(np.int8)


def best_classes(near: np.ndarray, n: np.ndarray, own: np.ndarray, pairs: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Each word's best class under the class bigrams, from the counts of classes behind and before it."""
    forth, each = np.log(smoothed(pairs)), np.log(pairs.sum(axis=0) + 1)
    best = _best(near[:, :CLASSES] @ forth.T + near[:, CLASSES:] @ forth - n[:, None] * each, own)
    # Words of one place by the table that tasks use on the spot, so that both agree to the last bit.
    once = np.flatnonzero((n == 1) & (own < CLASSES - 2))
    best[once] = single[near[once, CLASSES:].argmax(axis=1), near[once, :CLASSES].argmax(axis=1), own[once]]
    return best


def choose(pairs):
    """(word, n, class, moved) with each word's best class; rows (key, word, n, class) and (key, cells) come in the order of keys.

    The cells of one word are summed up as they come; one vector goes over from a batch to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_near, held_words = None, np.zeros((1, 2 * CLASSES)), []
        single = single_classes(pairs.value)

        def chosen(near: np.ndarray, word: np.ndarray, n: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            best = best_classes(near, n, own, pairs.value, single)
            columns = [pa.array(word), pa.array(n), pa.array(best.astype(np.int32)), pa.array((best != own).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", "class", "moved"])

        def done() -> Iterator[pa.RecordBatch]:
            if held_words:
                word, n, own = (np.concatenate(x) for x in zip(*held_words))
                yield chosen(np.repeat(held_near, len(word), axis=0), word, n, own)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, group = np.unique(batch.column("key").to_numpy(), return_inverse=True)
            cells = batch.column("cells")
            parts = cells.drop_null().to_pylist()
            owner = group[~np.asarray(cells.is_null())]
            packed = np.frombuffer(b"".join(parts), dtype=CELL)
            code = np.repeat(owner, [len(x) // CELL.itemsize for x in parts]) * 2 * CLASSES + packed["cell"]
            near = np.bincount(code, weights=packed["n"], minlength=len(keys) * 2 * CLASSES).astype(float).reshape(len(keys), 2 * CLASSES)
            named = np.flatnonzero(np.asarray(batch.column("word").is_valid()))
            some = batch.take(pa.array(named))
            word, n, own = (some.column(c).to_numpy().astype(np.int64) for c in ("word", "n", "class"))
            of = group[named]
            if keys[0] == held_key:
                near[0] += held_near[0]
                last = held_words
            else:
                yield from done()
                last = []
            kept = of == len(keys) - 1
            if len(keys) > 1:
                if last:
                    w, c, o = (np.concatenate(x) for x in zip(*last))
                    word, n, own = np.concatenate([w, word]), np.concatenate([c, n]), np.concatenate([o, own])
                    of, kept = np.concatenate([np.zeros(len(w), np.int64), of]), np.concatenate([np.zeros(len(w), bool), kept])
                last = []
                yield chosen(near[of[~kept]], word[~kept], n[~kept], own[~kept])
            held_key, held_near = keys[-1], near[-1:].copy()
            held_words = [*last, (word[kept], n[kept], own[kept])] if kept.any() else last
        yield from done()

    return run


def count_pairs(classes):
    """(a, of_a, b, of_b, n): counted bigrams of classes at hand, without words; and those with a word without one, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes = classes.value
        seen = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        names = ["a", "of_a", "b", "of_b", "n"]
        for batch in batches:
            for _, _, bounds, hashes, endings in scan(batch.column("text"), SPACES, word_measures):
                t = _Tokens(hashes, endings, bounds, own_classes)
                first, second = t.own[t.before], t.own[t.after]
                closed = (first >= 0) & (second >= 0)
                seen += np.bincount(first[closed] * CLASSES + second[closed], minlength=CLASSES * CLASSES)
                rest = np.flatnonzero(~closed)
                if len(rest):
                    columns = [t.hash[t.before[rest]], first[rest].astype(np.int32), t.hash[t.after[rest]], second[rest].astype(np.int32), np.ones(len(rest), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        code = np.flatnonzero(seen)
        none = pa.nulls(len(code), pa.int64())
        columns = [none, pa.array((code // CLASSES).astype(np.int32)), none, pa.array((code % CLASSES).astype(np.int32)), pa.array(seen[code])]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def class_pairs(docs: DataFrame, classes: Classes, held) -> np.ndarray:
    """Counts of class bigrams in the documents."""
    found = stored(docs.mapInArrow(count_pairs(held), "a long, of_a int, b long, of_b int, n long"), "class-pairs")
    tail = classes.table.where(F.col("n") < classes.cut)
    for word, of in (("a", "of_a"), ("b", "of_b")):
        keyed = found.withColumn("key", F.when(F.col(of) < 0, F.col(word)))
        met = keyed.where("key is not null").join(tail.select(F.col("word").alias("key"), F.col("class").alias("found")), "key")
        found = keyed.where("key is null").drop("key").unionByName(met.withColumn(of, F.col("found")).drop("key", "found"))
    pairs = np.zeros((CLASSES, CLASSES))
    for row in found.groupBy("of_a", "of_b").agg(F.sum("n").alias("n")).collect():
        pairs[row["of_a"], row["of_b"]] = row["n"]
    return pairs


def refine(docs: DataFrame, model: Model, counts: DataFrame, rounds: int = ROUNDS, known: int | None = None) -> Classes:
    """A class for every counted word, from the classes of the model's items."""
    context, known = docs.sparkSession.sparkContext, known or KNOWN
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = counts.mapInArrow(first_classes(context.broadcast((model.frequent, model.of))), "word long, n long, class int")
    held = context.broadcast((None, None, model.frequent, model.of, None))
    found, gained = Classes(table, 0, Index(np.zeros(0, np.uint64)), np.zeros(0, np.int64), np.zeros(0, np.int8), model.pairs), 0.0
    key = F.expr(f"shiftrightunsigned(word, {CELL_BITS})")
    for at in range(rounds):
        cells = docs.mapInArrow(neighbours(held), "key long, cells binary")
        if at:
            others = found.table.where(F.col("n") < found.cut).select(F.col("word").alias("other"), "class")
            met = docs.mapInArrow(unmet(held), "word long, other long, side int").join(others, "other")
            met = met.groupBy("word", (F.col("side") * CLASSES + F.col("class")).alias("cell")).count()
            packed = F.unhex(F.concat(F.lpad(F.hex("cell"), 2, "0"), F.lpad(F.hex("count"), 8, "0")))
            cells = cells.unionByName(met.select(key.alias("key"), packed.alias("cells")))
        rows = found.table.select(key.alias("key"), "word", "n", "class").unionByName(cells, allowMissingColumns=True)
        dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
        chosen = stored(dealt.mapInArrow(choose(context.broadcast(found.pairs)), "word long, n long, class int, moved int"), "classes")
        if not chosen.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]:
            break
        new = at_hand(chosen.drop("moved"), known)
        # Only the first round chooses by classes that every task knows.
        new.single = None if at else single_classes(found.pairs)
        held = context.broadcast(new.lookup(model))
        new.pairs = class_pairs(docs, new, held)
        gain = likelihood(new.pairs) - likelihood(found.pairs)
        if gain <= 0:
            break
        found = new
        if gained and gain < LEAST_GAIN * gained:
            break
        gained += gain
    if len(found.index.known):
        return found
    first = at_hand(stored(table, "classes"), known)
    first.pairs = model.pairs
    first.single = np.broadcast_to(np.arange(CLASSES, dtype=np.int8), (CLASSES, CLASSES, CLASSES))
    return first


def steps_between(classes: Classes, model: Model) -> np.ndarray:
    """log10 of a class behind a class, less the denominator of the words of the class behind."""
    whole = np.bincount(model.of[WORDS : WORDS + ENDINGS], minlength=CLASSES) * 0.5  # a word that training lacks for each ending
    for row in classes.table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        whole[row["class"]] += row["n"] + 0.5 * row["words"]
    whole[CLASSES - 1] = max(whole[CLASSES - 1], 0.5)
    return np.log10(smoothed(classes.pairs)) - np.log10(np.maximum(whole, 0.5))


def score_batches(model):
    """A task that scores rows but for their words that are not `known`, which it lists with their numbers, and bigrams with such words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, classes, counts, steps = model.value
        of_endings = m.of[WORDS : WORDS + ENDINGS]
        for batch in batches:
            done: list[list] = [[] for _ in range(4)]
            words, times, sizes = [], [], []
            open_sizes, opened = [], [[] for _ in range(5)]
            learnt = ~np.asarray(batch.column("held_out"))
            for first_row, end_row, bounds, hashes, endings in scan(batch.column("text"), SPACES, word_measures):
                rows = len(bounds) - 1
                row = np.repeat(np.arange(rows), np.diff(bounds))
                t = _Tokens(hashes, endings, bounds, classes, learnt[first_row:end_row])
                place = t.place
                known, count = (place >= 0) | t.single, t.single.astype(float)
                count[place >= 0] = counts[place[place >= 0]]
                first, second = t.own[t.before], t.own[t.after]
                closed = (first >= 0) & (second >= 0)
                own = np.bincount(t.row[closed], weights=steps[first[closed], second[closed]], minlength=rows)
                # Bigrams with a word without a class at hand, once per row; the class is for words that training lacks.
                left = np.flatnonzero(~closed)
                unseen = np.concatenate([of_endings[endings], t.own[-2:]])
                key_a, key_b = t.hash[t.before[left]], t.hash[t.after[left]]
                order = np.lexsort((key_b, key_a, t.row[left]))
                kept_a, kept_b, at = key_a[order], key_b[order], t.row[left][order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (kept_a[1:] != kept_a[:-1]) | (kept_b[1:] != kept_b[:-1]) | (at[1:] != at[:-1])
                heads = np.flatnonzero(new)
                one = left[order][heads]
                for kept, found in zip(opened, (
                    kept_a[heads], np.where(first[one] >= 0, first[one], -1 - unseen[t.before[one]]),
                    kept_b[heads], np.where(second[one] >= 0, second[one], -1 - unseen[t.after[one]]),
                    np.diff(np.concatenate([heads, [len(order)]])),
                )):
                    kept.append(found)
                open_sizes.append(np.bincount(at[heads], minlength=rows))
                logs = np.where(known, np.log10(count + 0.5), 0.0)
                base = np.bincount(row, weights=logs, minlength=rows) + np.log10(m.end_count + 0.5)
                n_known = np.bincount(row, weights=known, minlength=rows).astype(np.int64) + (m.end_count > 0)
                for kept, found in zip(done, (np.diff(bounds) + 1, n_known, base, own)):
                    kept.append(found)
                # Words without a count at hand, once per row.
                other = np.flatnonzero(~known)
                if len(other):
                    order = other[np.lexsort((hashes[other], row[other]))]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
                    heads = np.flatnonzero(new)
                    words.append(hashes[order][heads])
                    times.append(np.diff(np.concatenate([heads, [len(order)]])))
                    sizes.append(np.bincount(row[order][heads], minlength=rows))
                else:
                    sizes.append(np.zeros(rows, dtype=np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0)]).astype(kind)))
                for x, kind in ((words, np.int64), (times, np.int32))
            ]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(open_sizes or [np.zeros(0, np.int64)]))]).astype(np.int32))
            lists += [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0)]).astype(kind)))
                for x, kind in zip(opened, (np.int64, np.int32, np.int64, np.int32, np.int32))
            ]
            numbers = [pa.array(np.concatenate(x or [np.zeros(0)]), kind) for x, kind in zip(done, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *numbers, *lists],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "words", "times", "a", "of_a", "b", "of_b", "pair_times"],
            )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, words array<long>, times array<int>, a array<long>, of_a array<int>, b array<long>, of_b array<int>, pair_times array<int>"


def open_steps(scored: DataFrame, classes: DataFrame, steps: np.ndarray) -> DataFrame:
    """(row, own): what the listed bigrams add. `of_a` and `of_b` are classes, or -1 less the class in case that training lacks the word."""
    pairs = scored.select("row", F.explode(F.arrays_zip("a", "of_a", "b", "of_b", "pair_times")).alias("p")).select("row", "p.*")
    for word, of in (("a", "of_a"), ("b", "of_b")):
        # Words with a class get a key of their own, so that they don't meet in one task.
        keyed = pairs.withColumn("key", F.when(F.col(of) < 0, F.col(word)).otherwise(F.xxhash64("row", "a", "b")))
        found = keyed.join(classes.select(F.col("word").alias("key"), F.col("class").alias("found")), "key", "left")
        pairs = found.withColumn(of, F.when(F.col(of) >= 0, F.col(of)).otherwise(F.coalesce("found", -1 - F.col(of)))).drop("key", "found")
    cells = [(i, j, float(x)) for i, line in enumerate(steps) for j, x in enumerate(line)]
    table = scored.sparkSession.createDataFrame(cells, "of_a int, of_b int, step double")
    return pairs.join(F.broadcast(table), ["of_a", "of_b"]).groupBy("row").agg(F.sum(F.col("pair_times") * F.col("step")).alias("open"))


def score(docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text).

    Documents whose crc32(doc_id as text) mod 5 is `held_out_fold` are scored but not learnt from. Null text is empty and has
    the end token only. A word that training does not have counts 0 and gets its share of the add-half estimates. Without
    training documents base_score is 0 per token. Repeated rows are documents of their own. Other columns are not read. An
    empty table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == held_out_fold).alias("held_out"), text_or_empty(docs).alias("text"))
    learnt = rows.where("not held_out").select("text")
    model, counts = train(learnt)
    classes = refine(learnt, model, counts)
    steps = steps_between(classes, model)
    held = docs.sparkSession.sparkContext.broadcast((model, classes.lookup(model), classes.counts, steps))
    tail = classes.table.where((F.col("n") < classes.cut) & (F.col("word") != int(np.int64(END_HASH))))  # all others are at hand
    scored = stored(rows.mapInArrow(score_batches(held), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    words = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = words.join(tail.select("word", "n"), "word", "left")
    rest = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met")
    )
    rest_of = F.coalesce("rest", F.lit(0.0))
    opened = open_steps(scored, tail, steps)
    whole = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    return scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "own").join(rest, "row", "left").join(opened, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest_of - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("own") + F.coalesce("open", F.lit(0.0)) + F.col("base") + rest_of).alias("score"),
    )
