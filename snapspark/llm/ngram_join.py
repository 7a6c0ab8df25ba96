"""Set similarity join on word shingles: heavy-light by set size, for groups of near copies of any size.

Two documents link when the Jaccard similarity of their shingle sets is at least `num / den`. Equal sets form one class
first, and everything below works on one representative for each class.

* Light sets (at most `boundary` shingles) enumerate subsets of fixed sizes: for every c from ceil(num / den * size) to
  the size, all subsets of c shingles. Two light sets with c common shingles share a subset of that size, and whether c
  suffices follows from their sizes; linking all sets that share a subset to the smallest of them loses nothing.
* Heavy sets are found by scanning inverted lists. A set is listed under its first `size - ceil(num / den * size) + 1`
  shingles in one order that is the same for all sets: sets that link share one of these. Light sets that are large
  enough to link with a heavy one are listed too. Frequent shingles, as a sample estimates them, come last in the order,
  which keeps lists short; the order has no bearing on what is found.
* The boundary is the largest size up to which enumerating subsets costs no more keys than a set's lists would, where
  a list entry stands for `LIST_COST` keys of scanning and checking.

Members of a list are first paired with its smallest set, one from its middle, and the next smaller one, unless the
places of the shared shingle leave too few others; parity bitmaps, which can't rule out a pair that links, and then the
whole sets decide on these pairs. Most groups of near copies become
one component this way, with work in proportion to their size. Lists of up to three sets are done with that. Of longer
ones that still hold several components, the pairs of different components are compared, in blocks of `CHUNK` members,
by bitmaps and then by whole sets. No partner is left out.

Shingles are 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .components import components
from .words import mix, word_hashes

WIDTH, THRESHOLD = 3, (90, 100)
LIST_COST = 16
SAMPLE = 16  # one document in so many is looked at for frequent shingles
FREQUENT, MOST_FREQUENT = 4, 1 << 18  # documents of the sample that make a shingle frequent; the most that are kept
CHUNK = 1024
MOST_SLOTS = 1 << 23

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of one document, sorted; a document of fewer words is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    total = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    for i in range(size):
        total = mix(total * _A + hashes[i : n - size + 1 + i])
    return np.unique(total)


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(int(mix(elements ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (_B, _C))


def least_common(size: int, threshold: tuple[int, int]) -> int:
    """The smallest number of common shingles with which a set of this size links with any set."""
    num, den = threshold
    return -(-num * size // den)


def subsets(size: int, threshold: tuple[int, int]) -> int:
    return sum(comb(size, c) for c in range(least_common(size, threshold), size + 1))


@lru_cache
def boundary(threshold: tuple[int, int]) -> int:
    """The largest light size, by cost."""
    size = 0
    while subsets(size + 1, threshold) <= (size + 2 - least_common(size + 1, threshold)) + LIST_COST:
        size += 1
    return min(size, 60)


def list_keys(elements: np.ndarray, threshold: tuple[int, int], frequent: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists of a set: low six bits 0."""
    length = len(elements) - least_common(len(elements), threshold) + 1
    order = elements
    if len(frequent):
        place = np.searchsorted(frequent, elements)
        place[place == len(frequent)] = 0
        order = elements[np.argsort(frequent[place] == elements, kind="stable")]
    return order[:length] & ~np.uint64(63)


def subset_keys(elements: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Keys of the subsets of a light set: low six bits hold the subset's size."""
    values = mix(elements ^ _A)
    total, size, keys = values.sum(dtype=np.uint64), len(elements), []
    for c in range(least_common(size, threshold), size + 1):
        gone = np.array(list(combinations(range(size), size - c)), dtype=np.int64).reshape(comb(size, c), size - c)
        left = total - values[gone].sum(axis=1, dtype=np.uint64)
        keys.append((mix(left + np.uint64(c)) & ~np.uint64(63)) | np.uint64(c))
    return np.concatenate(keys)


def keys_of(elements: np.ndarray, threshold: tuple[int, int], frequent: np.ndarray) -> np.ndarray:
    light, keys = boundary(threshold), []
    if len(elements) >= least_common(light + 1, threshold):
        keys.append(list_keys(elements, threshold, frequent))  # first, so that a list key's place is the shingle's
    if len(elements) <= light:
        keys.append(subset_keys(elements, threshold))
    return np.concatenate(keys) if keys else elements[:0]


def parity(elements: np.ndarray) -> bytes:
    """A bitmap in which every shingle turns one bit over; two bitmaps differ in no more bits than their sets in shingles."""
    bits = 64 << max(0, (len(elements) - 1).bit_length() - 6)
    return np.packbits(np.bincount((mix(elements ^ _C) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def documents(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for _, _, bounds, hashes in word_hashes(column):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield shingles(hashes[a:b], width)


def sign(width: int, threshold: tuple[int, int], frequent):
    """A task that turns texts into set sizes, digests, keys and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            sizes, first, second, keys, bitmaps = [], [], [], [], []
            for elements in documents(batch.column("text"), width):
                d1, d2 = digest(elements)
                sizes.append(len(elements))
                first.append(d1)
                second.append(d2)
                keys.append(keys_of(elements, threshold, last).astype(np.int64) if len(elements) else elements.astype(np.int64))
                bitmaps.append(parity(elements) if len(elements) else b"")
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            ids = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ids), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, pa.array(bitmaps, pa.binary())],
                names=[*ids, "n", "d1", "d2", "keys", "bitmap"],
            )

    return run


def count_shingles(width: int):
    """A task that counts the documents of each shingle, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(documents(batch.column("text"), width))
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts)], names=["shingle", "n"])

    return run


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of at most MOST_FREQUENT (2 MB) shingles that are frequent in a sample: a hint for the order only."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(count_shingles(width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _enough_left(threshold: tuple[int, int], n, at, m, to):
    """Whether two sets of `n` and `m` shingles can link if the first one they share is at places `at` and `to` of the order."""
    num, den = threshold
    return (den + num) * (np.minimum(n - at, m - to)) >= num * (n + m)


def read_lists(threshold: tuple[int, int]):
    """A task that scans rows in order of (key, n, row): lists with several sets, with each one's place and partners.

    Partners are the list's smallest set, one from its middle and the next smaller one, or the row itself where the two can't
    link by what the list tells. Two sets are judged in the list of the first shingle that they share.
    """
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row", "n", "at")
        key, start = None, 0  # the list in which the last batch ended, and how many of its members have passed
        center = last = (0, 0, 0)  # its smallest and its last member
        waiting = None  # its first member, if it was the last row: whether it has company is not known yet
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, *own = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", *names))
            if waiting is not None:
                keys, *own = (np.concatenate([[x], y]) for x, y in zip(waiting, (keys, *own)))
                key = None
            begins = np.concatenate([[True], keys[1:] != keys[:-1]])
            going_on = bool(key is not None and keys[0] == key)
            heads = np.flatnonzero(begins)
            ends = np.concatenate([heads[1:], [len(keys)]])
            number = np.cumsum(begins) - 1
            places = np.arange(len(keys)) - heads[number]
            places[number == 0] += start if going_on else 0
            centers = [x[heads] for x in own]
            before = [np.concatenate([[y if going_on else x[0]], x[:-1]]) for x, y in zip(own, last)]
            for x, y, z in zip(centers, before, own):
                y[heads[int(going_on) :]] = z[heads[int(going_on) :]]
            if going_on:
                for x, y in zip(centers, center):
                    x[0] = y
            middle = heads + (ends - heads) // 2  # of the part at hand
            lone = ends - heads == 1
            lone[0] &= not going_on
            waiting = (keys[-1], *(x[-1] for x in own)) if lone[-1] else None
            key, start = keys[-1], int(places[-1]) + 1
            center, last = tuple(x[-1] for x in centers), tuple(x[-1] for x in own)
            keep = ~lone[number]
            if not keep.any():
                continue
            common = keys & 63
            scanned = common == 0
            row, n, at = own
            partners = []
            for kind, (other, m, to) in enumerate(([x[number] for x in centers], [x[middle][number] for x in own], before)):
                able = scanned & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & _enough_left(threshold, n, at, m, to)
                if not kind:  # a subset's size must suffice for both sets
                    able |= ~scanned & (den * common >= num * (n + m - common))
                partners.append(np.where(able, other, row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (keys, *own, places, *partners)], names=["key", *names, "place", "center", "middle", "before"]
            )

    return run


def _folded(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _possible(threshold: tuple[int, int]):
    """A task that keeps the pairs that the bitmaps don't rule out."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("nx", "ny", "x", "y"))
            keep = [_folded(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= (den - num) * (m + n) // (den + num) for m, n, x, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _chunk_pairs(threshold: tuple[int, int]):
    """A task over rows in order of (key, i, j): pairs of different components that the bitmaps don't rule out."""
    num, den = threshold

    def compare(group: list[dict]) -> Iterator[tuple[int, int]]:
        i, j = group[0]["i"], group[0]["j"]
        left = [r for r in group if r["chunk"] == i]
        right = [r for r in group if r["chunk"] == j]
        sizes, comps, ids, places = (np.array([r[c] for r in right]) for c in ("n", "comp", "row", "at"))
        maps = [np.frombuffer(r["bitmap"], dtype=np.uint64) for r in right]
        for r in left:
            own = np.frombuffer(r["bitmap"], dtype=np.uint64)
            able = (comps != r["comp"]) & (den * np.minimum(sizes, r["n"]) >= num * np.maximum(sizes, r["n"]))
            able &= _enough_left(threshold, r["n"], r["at"], sizes, places)
            if i == j:
                able &= ids > r["row"]
            for at in np.flatnonzero(able):
                if _folded(own, maps[at]) <= (den - num) * (r["n"] + int(sizes[at])) // (den + num):
                    yield (r["row"], int(ids[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        found: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["key"], row["i"], row["j"]) != (group[0]["key"], group[0]["i"], group[0]["j"]):
                    for a, b in compare(group):
                        found.add((min(a, b), max(a, b)))
                    group = []
                    if len(found) > 50_000:
                        yield flush()
                group.append(row)
        if group:
            for a, b in compare(group):
                found.add((min(a, b), max(a, b)))
        if found:
            yield flush()

    return run


def _links(threshold: tuple[int, int]):
    """A task that keeps the pairs whose whole sets link."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(one) > len(two):
                    one, two = two, one
                place = np.searchsorted(two, one)
                place[place == len(two)] = 0
                common = int((two[place] == one).sum())
                keep.append(den * common >= num * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(width: int):
    """A task that gives size, digest and elements of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, elements, held = [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (n, d1, d2)] + [pa.array(elements, pa.binary())], names=["n", "d1", "d2", "elements"]
                )

            for found in documents(batch.column("text"), width):
                a, b = digest(found)
                n.append(len(found))
                d1.append(a)
                d2.append(b)
                elements.append(found.tobytes())
                held += found.nbytes
                if held > 1 << 22:
                    yield rows()
                    n, d1, d2, elements, held = [], [], [], [], 0
            if n:
                yield rows()

    return run


def _asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id may be among `ids`: a filter of eight bits an id, at most MOST_SLOTS, that only saves work."""
    slots = min(MOST_SLOTS, 32768 * max(1, -(-8 * ids.count() // 32768)))
    slot_of = lambda column: F.pmod(F.xxhash64(column), F.lit(slots))
    pieces = ids.select(slot_of(F.col("doc_id")).alias("slot")).groupBy(F.shiftright("slot", 15).alias("piece")).agg(
        F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")
    )
    filled = {r["piece"]: bytes(r["bits"]) for r in pieces.collect()}
    bits = b"".join(filled.get(i, bytes(4096)) for i in range(slots >> 15))
    slot = slot_of(docs["doc_id"])
    byte = F.conv(F.hex(F.substring(F.lit(bits), (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.where(F.getbit(byte, (slot % 8).cast("int")) == 1)


def _fetched(docs: DataFrame, members: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(row, elements) of the sets in `pairs`, from the texts of their documents."""
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).dropDuplicates()
    asked = stored(members.join(rows, "row", "left_semi").select("row", "doc_id", "n", "d1", "d2"), "asked")
    whole = _asked(docs.select("doc_id", text_or_empty(docs).alias("text")), asked).select("text")
    whole = whole.mapInArrow(_sets(width), "n long, d1 long, d2 long, elements binary")
    whole = whole.groupBy("n", "d1", "d2").agg(F.first("elements").alias("elements"))
    return stored(whole.join(asked, ["n", "d1", "d2"]).select("row", "elements"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    x = sets.select(F.col("row").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("row").alias("b"), F.col("elements").alias("y"))
    return stored(pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_links(threshold), "a long, b long"), "links")


def classes(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(row, doc_id, n, node, component): `docs` has doc_id and text, and may have a stable number of its rows in `row`.

    `node` is the first row with the same set, `component` the smallest node that links reach. Documents without words
    have n = 0 and are alone.
    """
    ids = [c for c in ("doc_id", "row") if c in docs.columns]
    texts = docs.select(*ids, text_or_empty(docs).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, width))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*ids).schema.fields)
    signed = texts.mapInArrow(sign(width, threshold, frequent), schema + "n long, d1 long, d2 long, keys array<long>, bitmap binary")
    if "row" not in ids:
        signed = signed.withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "signed")
    filled = signed.where("n > 0")
    first = filled.groupBy("n", "d1", "d2").agg(F.min("row").alias("node"))
    members = stored(filled.select("row", "doc_id", "n", "d1", "d2").join(first, ["n", "d1", "d2"]), "members")
    copies = members.where("row <> node").select("row")
    postings = filled.select("row", "n", "keys").join(copies, "row", "left_anti").select(F.posexplode("keys").alias("at", "key"), "row", F.col("n").cast("int").alias("n"))
    ordered = postings.repartition("key").sortWithinPartitions("key", "n", "row")
    lists = stored(ordered.mapInArrow(read_lists(threshold), "key long, row long, n long, at long, place long, center long, middle long, before long"), "lists")

    scanned = F.col("key").bitwiseAND(F.lit(63)) == 0
    paired = F.array_distinct(F.array("center", "middle", "before"))
    star = lists.select("row", F.explode(paired).alias("to")).where("row <> to")
    star = star.select(F.least("row", "to").alias("a"), F.greatest("row", "to").alias("b")).dropDuplicates()
    bitmap = lambda a, n, x: signed.select(F.col("row").alias(a), F.col("n").alias(n), F.col("bitmap").alias(x))
    tried = star.join(bitmap("a", "nx", "x"), "a").join(bitmap("b", "ny", "y"), "b")
    tried = stored(tried.mapInArrow(_possible(threshold), "a long, b long"), "star")
    near = stored(components(_verified(tried, _fetched(docs, members, tried, width), threshold)), "components")

    # Longer lists that still hold several components.
    long = lists.where(scanned & (F.col("place") >= 3)).select("key").dropDuplicates()
    members_of = lists.where(scanned).select("key", "row", "n", "at", "place").join(long, "key", "left_semi")
    known = members_of.join(near.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("component", "row"))
    known = stored(known.select("key", "row", "n", "at", "place", "comp"), "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("place").alias("last")).where("low <> high")
    chunk = F.floor(F.col("place") / CHUNK)
    spread = known.join(mixed.select("key", F.floor(F.col("last") / CHUNK).alias("last")), "key").withColumn("chunk", chunk)
    spread = spread.join(signed.select("row", "bitmap"), "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    spread = spread.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "row", "n", "at", "comp", "bitmap")
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk")
    pairs = dealt.mapInArrow(_chunk_pairs(threshold), "a long, b long").dropDuplicates()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    far = _verified(pairs, _fetched(docs, members, pairs, width), threshold)
    # Components of components.
    up = lambda name: near.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    lifted = far.join(up("a"), "a", "left").join(up("b"), "b", "left")
    joined = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = stored(joined.select(F.col("node").alias("lower"), F.col("component").alias("upper")), "joined")
    placed = members.join(near, "node", "left").withColumn("lower", F.coalesce("component", "node")).drop("component")
    placed = placed.join(joined, "lower", "left").select("row", "doc_id", "n", "node", F.coalesce("upper", "lower").alias("component"))
    alone = signed.where("n = 0").select("row", "doc_id", "n", F.col("row").alias("node"), F.col("row").alias("component"))
    return placed.unionByName(alone)


def link(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and blank texts have no shingles and link with nothing. A null doc_id counts only where a component has no other.
    Repeated rows are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    found = stored(classes(docs.select("doc_id", "text"), width, threshold), "classes")
    lowest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(lowest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The columns of `docs`, one row of each component: the smallest doc_id's (null last), and of repeated rows one."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = stored(docs.select(*columns, docs["doc_id"], docs["text"]).withColumn("row", F.monotonically_increasing_id()), "near-docs")
    found = stored(classes(kept.select("doc_id", "text", "row"), width, threshold), "classes")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = found.join(first, "component").where(F.col("row") != F.col("first.row")).select("row")
    left = kept.join(gone, "row", "left_anti")
    return left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
