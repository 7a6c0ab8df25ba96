"""URL filters by Bloom filter cascades, with DataFrame functions only.

A cascade answers "is this key listed?" exactly for every key of a known universe. Level 1 is a Bloom filter of the
listed keys; level 2 one of the universe's keys that level 1 takes by mistake; level 3 one of the listed keys that level
2 takes by mistake, and so on until no mistake is left. The first level that rejects a key decides: an odd level says
not listed, an even one listed. Each level is a binary literal in the projection over the pages, so that no page is
joined or shuffled. A level's size comes from the count of its keys and of those it is asked for by mistake, so that the
next level has about half as many keys as it; a list with a level above `MOST_KEYS` all the same is joined instead
(`listed_by_join` for hosts, `ruled_by_join` for rules).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

HASHES = 4
BITS_PER_KEY = 8
MOST_KEYS = 1_000_000  # at 8 bits: 1 MB for a level
MOST_BITS = 64 * MOST_KEYS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of host labels whose hosts the query lists for blocking.
TERMS = ("casino", "pills", "poker", "viagra", "porn")


def host(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, ASCII lower case; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From behind the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(name: Column) -> Column:
    """A host and the domains above it, longest first; an empty host has none."""
    labels = F.split(name, r"\.", -1)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def candidates(name: Column, place: Column, lengths: Sequence[int]) -> Column:
    """Keys (domain and start of the path) a rule would have that fits this URL, for the path lengths that rules have."""
    starts = F.filter(
        F.array(*[F.when(F.length(place) >= n, F.substring(place, 1, n)) for n in sorted(set(lengths))]).cast("array<string>"),
        lambda s: s.isNotNull(),
    )
    return F.flatten(F.transform(suffixes(name), lambda d: F.transform(starts, lambda s: F.concat(d, s))))


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + i)), F.lit(bits)) for i in range(HASHES)]


class Oversized(ValueError):
    """A level would have more than MOST_KEYS keys."""


class Cascade:
    """Levels of bits as binary literals."""

    def __init__(self, levels: list[bytes]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        held = self.levels[level - 1]
        bits = F.lit(held)

        def test(slot: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (slot % 8).cast("int")) == 1

        return reduce(and_, [test(s) for s in _slots(key, level, 8 * len(held))])

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            answer = F.when(~self.passes(key, level), F.lit(level % 2 == 0)).otherwise(answer)
        return answer


def _bits(keys: DataFrame, level: int, bits: int) -> bytes:
    """The filter of one level: pieces of 32,768 bits, at most MOST_BITS in all."""
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("slot"))
    pieces = slots.groupBy(F.shiftright("slot", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")).collect()
    filled = {r["piece"]: bytes(r["bits"]) for r in pieces}
    return b"".join(filled.get(i, bytes(4096)) for i in range(-(-bits // 32768)))[: bits // 8]


def level_bits(n: int, others: int, bits_per_key: int) -> int:
    """Bits of a level of `n` keys by which about n / 2 of `others` pass; at least `bits_per_key` for a key, at most MOST_BITS."""
    rate = (n / (2 * others)) ** (1 / HASHES) if others else 1.0
    per_key = max(bits_per_key, -HASHES / math.log1p(-rate)) if rate < 1 else bits_per_key
    return 64 * max(1, math.ceil(min(n * per_key, MOST_BITS) / 64))


def build(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> Cascade:
    """A cascade over distinct `key` columns; `universe` holds every key that will be asked for, listed ones or not.

    Raises Oversized if a level has more than MOST_KEYS keys: the list is to be joined.
    """
    inside, outside = stored(listed.select("key").dropDuplicates(), "listed"), None
    levels: list[bytes] = []
    others = universe.count()
    while n := inside.count():
        if n > MOST_KEYS:
            raise Oversized(f"a level of {n} keys is above {MOST_KEYS}: join the list instead")
        level = len(levels) + 1
        levels.append(_bits(inside, level, level_bits(n, others, bits_per_key)))
        if outside is None:
            outside = universe.select("key").dropDuplicates().join(F.broadcast(inside), "key", "left_anti")
        inside, outside = stored(outside.where(Cascade(levels).passes(F.col("key"), level)), "mistakes"), inside
        others = n
    return Cascade(levels)


def universe_keys(keys: Column, pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(keys).alias("key")).dropDuplicates()


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")


def term_hosts(hosts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Of the hosts (`key`), those with a term in one of their labels."""
    return hosts.where(reduce(or_, [F.col("key").contains(t) for t in terms], F.lit(False)))


def listed_by_join(pages: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """The way for lists with a level above MOST_KEYS: `name` tells by an ordinary join on `host` whether it is listed."""
    marked = listed.select(F.col("key").alias("host"), F.lit(True).alias("found")).dropDuplicates()
    return pages.join(marked, "host", "left").withColumn(name, F.coalesce("found", F.lit(False))).drop("found")


def ruled_by_join(pages: DataFrame, keys: Column, table: DataFrame) -> DataFrame:
    """The way for rules with a level above MOST_KEYS: `best` is the longest rule of `table` among a page's `keys`, or null."""
    numbered = stored(pages.withColumn("row", F.monotonically_increasing_id()), "numbered")
    fits = numbered.select("row", F.explode(keys).alias("key")).join(table.dropDuplicates(), "key")
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    return numbered.join(best, "row", "left").drop("row")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, terms: Sequence[str] = TERMS, blocked: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    A rule (verdict, host, path) fits a URL whose host is the rule's or below it and whose path starts with the rule's; the
    longest one wins. Rule keys are looked up in one cascade for each verdict, over all keys that the URLs could ask for.
    Without a fitting rule a page is blocked if its host is listed (`blocked`, a table of `key`; by default the hosts with
    one of `terms`), as a third cascade over all hosts tells. Null URLs and URLs without `://` have an empty host and path,
    fit no rule and are allowed. Pages are not grouped by id; other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    places = pages.select("page_id", host(pages["url"]).alias("host"), path(pages["url"]).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), [len(p) for _, _, p in rules])
    asked = stored(universe_keys(keys, places), "asked-keys")
    table = rule_table(spark, rules)
    verdicts = sorted({v for v, _, _ in rules})
    hosts = stored(places.select(F.col("host").alias("key")).dropDuplicates(), "hosts")
    spam = stored((term_hosts(hosts, terms) if blocked is None else blocked).select("key").dropDuplicates(), "blocked")
    try:
        places = places.withColumn("listed", build(spam, hosts).lists(F.col("host")))
    except Oversized:
        places = listed_by_join(places, spam, "listed")
    try:
        lists = {v: build(table.where(F.col("verdict") == v), asked) for v in verdicts}
    except Oversized:
        judged = ruled_by_join(places, keys, table)
    else:

        def fits(verdict: str) -> Column:
            return F.transform(F.filter(keys, lists[verdict].lists), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(verdict).alias("verdict")))

        judged = places.withColumn("best", F.array_max(F.flatten(F.array(*map(fits, verdicts)))))
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"), "listed")
