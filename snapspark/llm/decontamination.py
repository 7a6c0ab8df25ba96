"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all items go into one automaton, item after item from the root. A document's words are streamed
through it; the automaton's state and the matched length say, at every word, how long the longest stretch is that ends
here and occurs in an item. Where it reaches `n` words, the last `n` are a window of an item. Stretches of hit words
are the spans to remove; a document whose hit share is above a limit goes as a whole.

Items are cut into pieces of bounded length that overlap by n - 1 words, and pieces are dealt to blocks of at most
`block_words` words. One block's automaton is broadcast at a time and all documents are streamed through it; the size
of a block, not that of the benchmark, bounds memory. Between blocks the findings are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prefixed, stored, text_or_empty
from .words import SIGNS, scan

N = 10
BLOCK_WORDS = 100_000
PIECE_WORDS = 5_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Automaton:
    """Suffix automaton over sequences of word numbers, with the items of every window's state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]  # items in which a state's longest string ends, before spreading

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.next) - 1

    def _step(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # a prefix that earlier items contain
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._clone(at, target, word)
        return new

    def _clone(self, at: int, target: int, word: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        self.link[target] = copy
        return copy

    def add(self, words: list[int], item: int) -> int:
        state = 0
        for word in words:
            state = self._step(state, word)
            self.items[state].add(item)
        return state

    def spread(self) -> None:
        """Hand each state's items up its suffix links, longest strings first."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.items[self.link[state]] |= self.items[state]


@dataclass
class Index:
    """What a task needs to stream documents: small arrays and dictionaries of one block."""

    n: int
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    windows: list[tuple[int, ...] | None]  # items of the state's n-word strings, where it has any
    shorts: list[tuple[tuple[int, int], ...]]  # (words, item) of whole short items that end here or at a shorter suffix
    ids: list[str]


def build(items: list[tuple[str, np.ndarray, bool]], n: int) -> Index:
    """An index of (item id, word hashes, whole) pieces; a whole item of fewer than `n` words is one window."""
    vocabulary = np.unique(np.concatenate([h for _, h, _ in items] or [np.zeros(0, np.uint64)]))
    ids = sorted({name for name, _, _ in items})
    number = {name: i for i, name in enumerate(ids)}
    machine, ends = Automaton(), []
    for name, hashes, whole in items:
        sequence = np.searchsorted(vocabulary, hashes).tolist()
        machine.add(sequence, number[name])
        if whole and 0 < len(sequence) < n:
            ends.append((sequence, number[name]))
    machine.spread()
    own: dict[int, list[tuple[int, int]]] = {}
    for sequence, item in ends:
        state = 0
        for word in sequence:
            state = machine.next[state][word]
        own.setdefault(state, []).append((len(sequence), item))
    windows: list[tuple[int, ...] | None] = [None] * len(machine.link)
    shorts: list[tuple[tuple[int, int], ...]] = [()] * len(machine.link)
    for state in sorted(range(1, len(machine.link)), key=machine.length.__getitem__):
        up = machine.link[state]
        shorts[state] = shorts[up] + tuple(sorted(set(own.get(state, ()))))
        if machine.length[state] >= n:
            # The state of the n-word suffix is this one or, if that is too short a stretch for it, one up the links.
            windows[state] = windows[up] if machine.length[up] >= n else tuple(sorted(machine.items[state]))
    return Index(n, vocabulary, machine.next, machine.link, machine.length, windows, shorts, ids)


def stream(index: Index, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Hit stretches (first word, end) and items in a stretch of word numbers."""
    next_, link, length, windows, shorts, n = index.next, index.link, index.length, index.windows, index.shorts, index.n
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    state = matched = 0
    for place, word in enumerate(words, 1):
        to = next_[state].get(word)
        if to is None:
            while to is None and state > 0:
                state = link[state]
                to = next_[state].get(word)
            if to is None:
                matched = 0
                continue
            matched = length[state]
        state = to
        matched += 1
        hit = 0
        if matched >= n:
            found.update(windows[state])
            hit = n
        if shorts[state]:
            for size, item in shorts[state]:
                if size <= matched:
                    found.add(item)
                    hit = max(hit, size)
        if hit:
            start = place - hit
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, place))
    return spans, found


def _known_stretches(hashes: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Word numbers, and starts, ends and rows of stretches of at least `least` words that some item has.

    The automaton falls back to its root at any other word, so only these stretches need to be streamed.
    """
    if not len(vocabulary) or not len(hashes):
        return (np.zeros(0, np.int64),) * 4
    numbers = np.searchsorted(vocabulary, hashes)
    numbers[numbers == len(vocabulary)] = 0
    known = vocabulary[numbers] == hashes
    edge = np.zeros(len(hashes) + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(known & (~np.concatenate([[False], known[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(known & (~np.concatenate([known[1:], [False]]) | edge[1:])) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return numbers, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def scan_block(index, column: str):
    """A task that adds n_words, `spans` and `items` of one block to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        least = min([block.n, *(size for rows in block.shorts for size, _ in rows)])
        for batch in batches:
            n_words: list[int] = []
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            items: list[set] = [set() for _ in range(batch.num_rows)]
            for first, _, bounds, hashes, starts, ends in scan(batch.column(column), SIGNS, lambda p: (p.hashes(), *p.places())):
                n_words += np.diff(bounds).tolist()
                numbers, *stretches = _known_stretches(hashes, bounds, block.vocabulary, least)
                for a, b, row in zip(*(x.tolist() for x in stretches)):
                    hits, found = stream(block, numbers[a:b].tolist())
                    for x, y in hits:
                        place = {"word": a + x - int(bounds[row]), "words": y - x, "start": int(starts[a + x]), "end": int(ends[a + y - 1])}
                        spans[first + row].append(place)
                    items[first + row] |= found
            names = [[block.ids[i] for i in sorted(found)] for found in items]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))],
                names=[*batch.schema.names, "n_words", "spans", "items"],
            )

    return run


SPANS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, spans array<struct<word:long,words:long,start:long,end:long>>, items array<string>"


def item_pieces(items: DataFrame, n: int, piece_words: int) -> DataFrame:
    """(item_id, words, whole): items cut into overlapping pieces; null texts and items without words have none."""
    words = F.regexp_extract_all(F.translate(text_or_empty(items), UPPER, LOWER), F.lit(WORD), 0)
    step = piece_words - n + 1
    known = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - n), F.lit(step))
    return known.select("item_id", (F.size("words") <= piece_words).alias("whole"), "words", F.explode(starts).alias("at")).select(
        "item_id", "whole", F.slice("words", F.col("at") + 1, piece_words).alias("words")
    )


def blocks(items: DataFrame, n: int, block_words: int, piece_words: int) -> Iterator[Index]:
    """Indexes of one block of items after the other; what the driver holds is bounded by `block_words` words."""
    from .words import word_hashes

    pieces = stored(item_pieces(items, n, piece_words).dropDuplicates(), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = 1 if total <= block_words else -(-2 * total // block_words)
    while parts > 1:  # dealing by hash is even only on average: use more blocks until each is within the bound
        dealt = pieces.groupBy(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).alias("block")).agg(F.sum(F.size("words")).alias("n"))
        if dealt.agg(F.max("n")).first()[0] <= max(block_words, 2 * piece_words):
            break
        parts *= 2
    for part in range(parts):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).orderBy("item_id", "words")
        rows = mine.select("item_id", "whole", F.array_join("words", " ").alias("text")).toArrow()
        hashes: list[np.ndarray] = []
        for _, _, bounds, found in word_hashes(rows.column("text"), SIGNS):
            hashes += [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        yield build(list(zip(rows.column("item_id").to_pylist(), hashes, rows.column("whole").to_pylist())), n)


def find(
    docs: DataFrame, items: DataFrame, n: int = N, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS, columns: list[str] | None = None
) -> DataFrame:
    """The `columns` of `docs` with n_words, n_hit, item_ids (sorted as strings) and spans.

    A document word inside any occurrence of a window is hit; a window is `n` consecutive words of an item, or the whole
    of a shorter item. Spans are stretches of hit words: word, words, and start and end as byte places in the text. Null
    texts have no words; a null item_id is listed as an empty string; items without words match nothing. No items, no
    hits. Rows are not joined or grouped by id, so repeated and null ids are kept as they are.
    """
    added = ("n_words", "n_hit", "item_ids", "spans")
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in added]
    empty = F.array().cast("array<struct<word:long,words:long,start:long,end:long>>")
    carried = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)]
    # Texts go to the tasks and back once: a string column `text` that is kept is searched as it is, its nulls as no words.
    searched = next((f"c{i}" for i, c in enumerate(columns) if c.lower() == "text" and isinstance(docs.select("text").schema[0].dataType, T.StringType)), None)
    if searched is None:
        searched = "searched"
        carried.append(text_or_empty(docs).alias(searched))
    found = docs.select(*carried, F.lit(0).cast("long").alias("total"), empty.alias("hits"), F.array().cast("array<string>").alias("names"))
    carried = [c for c in found.columns if c not in ("total", "hits", "names")]
    context = docs.sparkSession.sparkContext
    for number, index in enumerate(blocks(items, n, block_words, piece_words)):
        if number:
            found = stored(found, "hits")
        held = context.broadcast(index)
        scanned = found.mapInArrow(scan_block(held, searched), prefixed(found, FOUND))
        found = scanned.select(
            *carried, F.col("n_words").alias("total"),
            F.concat("hits", "spans").alias("hits"), F.array_sort(F.array_union("names", "items")).alias("names"),
        )
    # Stretches of different blocks may touch or overlap: each counts from where the ones before it end.
    ordered = F.array_sort("hits")
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate(
        ordered, start,
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["word"] + s["words"]).alias("reach"),
            (a["n"] + F.greatest(F.lit(0), s["word"] + s["words"] - F.greatest(a["reach"], s["word"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        F.col("total").alias("n_words"), n_hit.alias("n_hit"), F.col("names").alias("item_ids"), ordered.alias("spans"),
    )


def clean(docs: DataFrame, items: DataFrame, n: int = N, most: float = 0.5, **options) -> DataFrame:
    """The columns of `docs`: documents with more than `most` of their words hit go, other hit stretches leave the text.

    Documents without a hit, without words or without text stay as they are.
    """
    names = ["text" if c.lower() == "text" else f"d{i}" for i, c in enumerate(docs.columns)]
    work = docs.select(*[docs[f"`{c}`"].alias(name) for c, name in zip(docs.columns, names)])
    found = find(work, items, n, **options)
    kept = found.where(F.col("n_hit") <= most * F.col("n_words"))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("text")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(a["text"], F.substring(F.col("text").cast("binary"), (a["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - a["at"]).cast("int"))).alias("text"),
        ),
        lambda a: F.concat(a["text"], F.substring(F.col("text").cast("binary"), (a["at"] + 1).cast("int"), F.lit(2147483647))).cast("string"),
    )
    text = F.when(F.col("n_hit") == 0, F.col("text")).otherwise(merged)
    return kept.select(*[(text if name == "text" else F.col(name)).alias(c) for c, name in zip(docs.columns, names)])
