"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards: a block of up to `BLOCK` conversations of neighbouring ids, and a band of `BAND` turns. A
shard so holds at most BLOCK * BAND turns, however long a conversation is and however many begin alike. In a shard every
conversation has a bit. The index maps (position, turn) to the bitset of the conversations that have the turn there; a
depth-first walk starts with the bitset of each prefix that reaches the band, intersects it with the postings of the next
position, and so meets every node of the shard with its members as a bitset: popcounts are its counts, and the bits in the
bitset of conversations that end there its end list.

A node is known across shards by its key: the exclusive or of the 128-bit hashes of (position, role, text) along its
prefix. The key at the start of a band comes from one such hash per conversation and band. Nodes of all shards are summed
by key.

Sums over subtrees need no walk across shards. A node belongs to its smallest member; along a conversation the nodes are
its own from some depth on, as members only fall away. The turns above are the ones it shares with a smaller conversation,
and a node's subtree saves the words of just these turns at and below the node, summed over its members. Leaves are
counted at the conversations that own them. A second walk over the same shards sums both up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordering
from .common import stored
from .mixing import words

BLOCK = 1024
BAND = 256
HEAVY = 1000  # parents with more than a thousandth of all nodes as children are joined by broadcast

NODE = "depth long, key1 long, key2 long"


class Trie(NamedTuple):
    """`nodes`: one row per node. `ends`: (depth, key1, key2, first_id, ids), the conversations that end at a node, ascending;
    a node has several rows, each of at most `BLOCK` ids, in the order of first_id."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn_hash, words): turns in order, positions from 1; role and text enter the hash.

    Null role or text counts as empty. Turns go by `turn`, null first; ties by role, then by the hash. Repeated rows are turns
    like others. Rows without conv_id belong to no conversation and are left out. Positions are found over ranges of
    (conversation, order), so a long conversation is spread over tasks, and only hashes of texts are dealt.
    """
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    # The length of the role says where it ends.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(whole, 256)).alias("turn_hash"), words(text).alias("words"),
    ).where("conv_id is not null")
    placed = ordering.positions(rows, "conv_id", ["turn", "role", "turn_hash"])
    return placed.select("conv_id", (F.col("position") + 1).alias("position"), "turn_hash", "words")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, length)."""
    return turns.groupBy("conv_id").agg(F.max("position").alias("length"))


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (turns, conversations) as `build` takes them.

    Conversation c begins with the first h turns of conversation c - c % family, all if it has fewer, none if it is absent, and
    goes on with its own turns after the first h; h is crc32 of c in decimal, modulo `most`. At most `most - 1` turns of a
    conversation are repeated, to `family` conversations.
    """
    own = stored(turns, "trie-own")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    every = stored(
        conversations_of(own).select("conv_id", "length", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "trie-every"
    )
    lengths = every.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    joined = every.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("base_length", F.lit(0).cast("long"))))
    joined = stored(joined.withColumn("new_length", F.col("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))), "trie-heads")
    heads = own.where(F.col("position") < most).withColumnRenamed("conv_id", "base")
    repeated = joined.where("head > 0").select("conv_id", "base", "head").join(heads, "base").where(F.col("position") <= F.col("head"))
    kept = own.join(joined.select("conv_id", "h", "head"), "conv_id").where(F.col("position") > F.col("h"))
    columns = ["conv_id", "position", "turn_hash", "words"]
    moved = kept.withColumn("position", F.col("position") - F.col("h") + F.col("head"))
    return repeated.select(*columns).unionByName(moved.select(*columns)), joined.select("conv_id", F.col("new_length").alias("length"))


def sharded(turns: DataFrame, conversations: DataFrame, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """Turns with their shard: block, band, bit, the 128-bit hash (v1, v2) of position and turn, the key (s1, s2) of the prefix
    before the band, and whether the turn is the last."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = conversations.repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id").withColumn("number", F.monotonically_increasing_id())
    homes = stored(numbered, "trie-homes").select(
        "conv_id", "length", F.expr(f"number div {block}").alias("block"), (F.col("number") % block).cast("int").alias("bit")
    )
    hashed = turns.select(
        "conv_id", "position", "words", F.expr(f"(position - 1) div {band}").alias("band"),
        F.xxhash64(F.lit(1), "position", "turn_hash").alias("v1"), F.xxhash64(F.lit(2), "position", "turn_hash").alias("v2"),
    )
    hashed = stored(hashed, "trie-hashed")
    # One row for each conversation and band.
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c: F.coalesce(F.expr(f"bit_xor({c})").over(before), F.lit(0)).cast("long")
    bands = hashed.groupBy("conv_id", "band").agg(F.expr("bit_xor(v1)").alias("x1"), F.expr("bit_xor(v2)").alias("x2"))
    starts = bands.select("conv_id", "band", xor("x1").alias("s1"), xor("x2").alias("s2"))
    # A conversation's turns are spread over its bands in this join; `homes` meets one row a band.
    placed = starts.join(homes, "conv_id")
    return hashed.join(placed, ["conv_id", "band"]).withColumn("last", F.col("position") == F.col("length")).drop("length")


class Shard:
    """The index of one shard and the walk over it. Bitsets are whole numbers."""

    def __init__(self, table: pa.Table):
        column = {name: table.column(name).to_pylist() for name in table.schema.names}
        self.ids: dict[int, int] = dict(zip(column["bit"], column["conv_id"]))
        self.column = column
        self.postings: dict[tuple[int, int, int], int] = {}
        self.words: dict[tuple[int, int, int], int] = {}
        self.turn: dict[tuple[int, int], tuple[int, int]] = {}  # (bit, position) to the turn
        self.ends: dict[int, int] = {}  # position to the conversations that end there
        self.roots: dict[tuple[int, int], int] = {}  # key before the band to the conversations that come with it
        self.first = min(column["position"])
        for bit, at, v1, v2, n, s1, s2, last in zip(*(column[c] for c in ("bit", "position", "v1", "v2", "words", "s1", "s2", "last"))):
            one = 1 << bit
            self.postings[at, v1, v2] = self.postings.get((at, v1, v2), 0) | one
            self.words[at, v1, v2] = n
            self.turn[bit, at] = v1, v2
            if last:
                self.ends[at] = self.ends.get(at, 0) | one
            if at == self.first:
                self.roots[s1, s2] = self.roots.get((s1, s2), 0) | one

    def children(self, members: int, at: int) -> Iterator[tuple[int, int, int]]:
        """(v1, v2, bitset) of the turns at position `at` that follow a prefix with these members."""
        while members:
            bit = (members & -members).bit_length() - 1
            turn = self.turn.get((bit, at))
            if turn is None:  # has ended, or goes on in the next band
                members &= members - 1
                continue
            child = members & self.postings[at, *turn]
            members &= ~child
            yield *turn, child

    def walk(self, enter: Callable, leave: Callable | None = None) -> None:
        """Depth first: enter(depth, key, parent, words, members), and leave(...) with the same once its subtree is done."""
        stack = [(self.first - 1, key, None, 0, members, False) for key, members in self.roots.items()]
        while stack:
            depth, key, parent, n, members, done = stack.pop()
            if done:
                leave(depth, key, parent, n, members)
                continue
            if parent is not None:
                enter(depth, key, parent, n, members)
                if leave is not None:
                    stack.append((depth, key, parent, n, members, True))
            for v1, v2, child in self.children(members, depth + 1):
                stack.append((depth + 1, (key[0] ^ v1, key[1] ^ v2), key, self.words[depth + 1, v1, v2], child, False))

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


LOCAL = f"{NODE}, parent1 long, parent2 long, words long, n_convs long, conv_id long, ended array<bigint>"
_LOCAL = pa.schema([*[(c, pa.int64()) for c in ("depth", "key1", "key2", "parent1", "parent2", "words", "n_convs", "conv_id")], ("ended", pa.list_(pa.int64()))])


def _nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard with their counts there. Bits follow the ids, so the lowest bit is the smallest member."""
    shard, rows = Shard(table), []

    def enter(depth, key, parent, n, members):
        low = (members & -members).bit_length() - 1
        rows.append((depth, *key, *parent, n, members.bit_count(), shard.ids[low], shard.members(members & shard.ends.get(depth, 0))))

    shard.walk(enter)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LOCAL)], schema=_LOCAL)


SUMS = f"{NODE}, n_leaves long, saved_tokens long"
_SUMS = pa.schema([(c, pa.int64()) for c in ("depth", "key1", "key2", "n_leaves", "saved_tokens")])


def _sums(band: int):
    """For the nodes of a shard: members that own a leaf, and words at or below the node that its members do not own."""

    def run(table: pa.Table) -> pa.Table:
        shard, rows = Shard(table), []
        column = shard.column
        owned_from: dict[int, int] = {}
        later: dict[int, int] = {}
        leaf = 0
        for bit, depth, has_leaf, words_later in zip(*(column[c] for c in ("bit", "owned_from", "leaf", "later"))):
            owned_from[bit], later[bit] = depth, words_later
            leaf |= has_leaf << bit
        shares: dict[int, int] = {}  # position to the conversations that do not own their node there
        for bit, depth in owned_from.items():
            for at in range(shard.first, min(depth, shard.first + band)):
                shares[at] = shares.get(at, 0) | 1 << bit
        below: dict[tuple[int, tuple], int] = {}
        end = shard.first + band - 1

        def leave(depth, key, parent, n, members):
            saved = below.pop((depth, key), 0) + n * (members & shares.get(depth, 0)).bit_count()
            if depth == end:
                rest = members
                while rest:
                    low = rest & -rest
                    saved += later[low.bit_length() - 1]
                    rest ^= low
            below[depth - 1, parent] = below.get((depth - 1, parent), 0) + saved
            rows.append((depth, *key, (members & leaf).bit_count(), saved))

        shard.walk(lambda *node: None, leave)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)

    return run


def build(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK, band: int = BAND) -> Trie:
    """The trie of all conversations.

    `turns` has conv_id, position (from 1, without gaps), turn_hash and words; `conversations` has conv_id and length and may hold
    conversations without turns, which end at the root. Node columns: depth, key1, key2 (the key; 0, 0 is the root),
    conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Without conversations there is no node.
    """
    turns = stored(turns, "trie-turns")
    conversations = stored(conversations_of(turns) if conversations is None else conversations, "trie-convs")
    shards = stored(sharded(turns, conversations, block, band), "trie-shards")
    node = ["depth", "key1", "key2"]
    local = stored(shards.groupBy("block", "band").applyInArrow(_nodes, LOCAL), "trie-local")
    merged = local.groupBy(*node, "parent1", "parent2").agg(F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    inner = stored(merged, "trie-nodes")
    children = stored(
        inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(F.count("*").alias("n_children")),
        "trie-children",
    )
    # An aggregate over an empty table still has a row.
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("key1"), zero.alias("key2"), "conv_id", "n_convs")
    every = root.unionByName(inner.select(*node, "conv_id", "n_convs")).join(children, node, "left")
    every = stored(every.withColumn("n_children", F.coalesce("n_children", zero)), "trie-every-node")

    # Where each conversation starts to own its nodes, and whether the last of them is a leaf.
    owned = every.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    owned = conversations.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("owned_from", F.col("length") + 1).alias("owned_from"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    owned = stored(owned, "trie-owned")
    bands = shards.select("conv_id", "band", "position", "words").join(owned.select("conv_id", "owned_from"), "conv_id")
    shared = F.sum(F.when(F.col("position") < F.col("owned_from"), F.col("words")).otherwise(0))
    bands = bands.groupBy("conv_id", "band").agg(shared.alias("shared"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = stored(bands.select("conv_id", "band", "shared", F.coalesce(F.sum("shared").over(after), zero).alias("later")), "trie-bands")
    again = shards.join(bands.select("conv_id", "band", "later").join(owned, "conv_id"), ["conv_id", "band"])
    sums = again.groupBy("block", "band").applyInArrow(_sums(band), SUMS).groupBy(*node).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    # One row each. The root of conversations without any turn is itself the one leaf.
    leaves = owned.agg(F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1)).cast("long").alias("n_leaves")).withColumn("depth", zero)
    saved = bands.agg(F.coalesce(F.sum("shared"), zero).alias("saved_tokens")).withColumn("depth", zero)
    at_root = leaves.join(saved, "depth").select("depth", zero.alias("key1"), zero.alias("key2"), "n_leaves", "saved_tokens")
    counted = every.join(sums.unionByName(at_root), node)
    return Trie(_with_parents(counted, every, inner, children), _ends(local, conversations))


def _with_parents(counted: DataFrame, every: DataFrame, inner: DataFrame, children: DataFrame) -> DataFrame:
    """`counted` with parent_conv_id. A parent with very many children is joined by broadcast, at most `HEAVY` of them."""
    node = ["depth", "key1", "key2"]
    many = inner.count() // HEAVY
    names = F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("up"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2")
    heavy = every.where(F.col("n_children") > max(many, 100)).select(*names)
    light = every.where((F.col("n_children") > 0) & (F.col("n_children") <= max(many, 100))).select(*names)
    up = inner.select(*node, "parent1", "parent2", (F.col("depth") - 1).alias("up"))
    by = ["up", "parent1", "parent2"]
    of_heavy = up.join(F.broadcast(heavy), by)
    of_light = up.join(F.broadcast(heavy), by, "left_anti").join(light, by)
    parents = of_heavy.select(*node, "parent_conv_id").unionByName(of_light.select(*node, "parent_conv_id"))
    return counted.join(parents, node, "left").select(*node, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _ends(local: DataFrame, conversations: DataFrame) -> DataFrame:
    node = ["depth", "key1", "key2"]
    ended = local.where(F.size("ended") > 0).select(*node, F.col("ended")[0].alias("first_id"), F.col("ended").alias("ids"))
    zero = F.lit(0).cast("long")
    turnless = conversations.where("length = 0").select(
        zero.alias("depth"), zero.alias("key1"), zero.alias("key2"), F.col("conv_id").alias("first_id"), F.array("conv_id").alias("ids")
    )
    return ended.unionByName(turnless)


DIGEST = f"{NODE}, ends_sha256 string"
_DIGEST = pa.schema([("depth", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("ends_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, digest, done = None, None, []
    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key1", "key2", "ids"))):
            if node != held:
                if held is not None:
                    done.append((*held, digest.hexdigest()))
                held, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ids)).encode())
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGEST)], schema=_DIGEST)
            done = []
    if held is not None:
        done.append((*held, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _DIGEST)], schema=_DIGEST)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, key1, key2, ends_sha256) of nodes at which conversations end: SHA-256 of the ids in order, comma-joined.

    The digest of one node runs over its list in order, as a stream of rows of up to `BLOCK` ids; no list is put together.
    """
    node = ["depth", "key1", "key2"]
    return ends.repartition(*node).sortWithinPartitions(*node, "first_id").select(*node, "ids").mapInArrow(_digest, DIGEST)


def summary(trie: Trie) -> DataFrame:
    """One row per node: its columns, without the key, and ends_sha256 (of the empty string where no conversation ends)."""
    node = ["depth", "key1", "key2"]
    joined = trie.nodes.join(ends_digests(trie.ends), node, "left")
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
