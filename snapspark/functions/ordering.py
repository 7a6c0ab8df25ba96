"""Keyset paging, top-N per key and order-dependent sums that stay balanced when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept_partitions, parts_for, written

Order = Sequence[tuple[str, str]]  # (column, "asc" | "desc")

LIST_PART = 1000  # list values in one part of a document


def only(df: DataFrame, keys: DataFrame | None, on: str | list[str]) -> DataFrame:
    """Rows of the asked keys; all rows without keys."""
    return df if keys is None else df.join(keys.select(on).distinct(), on, "left_semi")


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """`df` in as many partitions by key as `session.parts_for` found, for a group or DISTINCT whose keys hardly repeat.

    Spark would combine such rows before the exchange, to no effect, and then join partitions by their compressed bytes; both
    make hash tables that grow with the input. Without `parts` the step is left to Spark.
    """
    return df.repartition(parts, *keys) if parts else df


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order]


def after(order: Order, values: Sequence) -> Column:
    """Rows strictly after a composite key, OR-expanded; the leading bound is kept apart so a scan can use it."""
    def step(col: str, way: str, value) -> Column:
        return F.col(col) < F.lit(value) if way == "desc" else F.col(col) > F.lit(value)

    clauses = []
    for i, ((col, way), value) in enumerate(zip(order, values)):
        equal = [F.col(c) == F.lit(v) for (c, _), v in zip(order[:i], values[:i])]
        clauses.append(reduce(lambda a, b: a & b, [*equal, step(col, way, value)]))
    lead, way = order[0]
    bound = F.col(lead) <= F.lit(values[0]) if way == "desc" else F.col(lead) >= F.lit(values[0])
    return bound & reduce(lambda a, b: a | b, clauses)


def page(df: DataFrame, order: Order, limit: int, cursor: Sequence | None = None) -> DataFrame:
    """One keyset page plus `has_next`, true on every row when another row follows the page."""
    rows = df if cursor is None else df.where(after(order, cursor))
    top = rows.orderBy(*sort_columns(order)).limit(limit + 1)
    # At most limit + 1 rows reach this window.
    numbered = top.withColumn("_n", F.row_number().over(W.orderBy(*sort_columns(order))))
    numbered = numbered.withColumn("has_next", F.max("_n").over(W.partitionBy(F.lit(1))) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n")


def top_per_key(df: DataFrame, key: str | list[str], order: Order, n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key; Spark limits each group before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    w = W.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page_per_key(df: DataFrame, key: str, order: Order, limit: int) -> DataFrame:
    """First page of every key with `has_next`."""
    top = top_per_key(df, key, order, limit + 1, "page_rank")
    more = F.max("page_rank").over(W.partitionBy(key)) > limit
    return top.withColumn("has_next", more).where(F.col("page_rank") <= limit)


def first_per_key(df: DataFrame, key: str | list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row with the smallest order tuple per key, as a map-side combined aggregate."""
    keys = [key] if isinstance(key, str) else key
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*")


def ranges(df: DataFrame, group: str, order: list[str | Column], parts: int | None = None, kept: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The rows dealt by range of (group, order) and written to the shared folder, so that their places hold.

    With `kept`, only these columns and the group are written. With `whole`, a range is read whole by one task of a step
    that has `_bucket` among its keys (`session.kept_partitions`). `_range` is the range; `_place` counts the rows of a range in order, and goes on from one range to the next with a gap.
    `_of` holds the group: as a struct it is never NULL, so that it joins by plain equality, without a further exchange.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    columns = list(dict.fromkeys([group, *kept])) if kept else ["*"]
    ranged = ranged.select(*columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place"))
    ranged = kept_partitions(ranged, "ranges", "_range", parts) if whole else written(ranged, "ranges")
    return ranged.withColumn("_of", F.struct(group))


def spans(ranged: DataFrame) -> DataFrame:
    """(_of, _range, _first, _n, _before): a group's rows in a range, `_n` from place `_first` on, `_before` in earlier ranges."""
    earlier = W.partitionBy("_of").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_of", "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    return totals.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def running_sums(
    df: DataFrame,
    group: str,
    order: list[str | Column],
    sums: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Exclusive running sums per group in order, without putting a whole group into one task.

    Sums inside a range (`ranges`) are joined with the totals of the same group in earlier ranges: one row for each group and
    range. (group, order) should be unique; rows that tie get their places in no particular order.
    """
    ranged = ranges(df.select(*df.columns, *[value.alias(f"_in_{name}") for name, value in sums.items()]), group, order, parts)
    before = W.partitionBy("_of", "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("_of").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_of", "_range").agg(*[F.sum(f"_in_{name}").alias(f"_t_{name}") for name in sums])
    offsets = totals.select("_of", "_range", *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums])
    inside = ranged.select("*", *[F.coalesce(F.sum(f"_in_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    joined = inside.join(offsets, ["_of", "_range"])
    return joined.select(*df.columns, *[(F.col(f"_b_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums])


def positions(df: DataFrame, group: str, order: list[str], name: str = "position", parts: int | None = None, few: bool = False) -> DataFrame:
    """Zero-based position of every row inside its group: its place from the group's first in the range on, after earlier ranges.

    With `few` groups, of a fixed number, there are hardly more spans than ranges: they are broadcast and the rows stay where
    they lie.
    """
    ranged = ranges(df, group, order, parts)
    shift = spans(ranged).select("_of", "_range", (F.col("_before") - F.col("_first")).alias("_shift"))
    shift = F.broadcast(shift) if few else shift
    return ranged.join(shift, ["_of", "_range"]).select(*df.columns, (F.col("_place") + F.col("_shift")).alias(name))


def with_previous(df: DataFrame, group: str, seq: str, columns: list[str], block: int = 1 << 16) -> DataFrame:
    """Add `prev_<column>` from the row one `seq` earlier in the group; `seq` counts up without gaps.

    Rows are dealt to fixed-size blocks and each block also gets the last row of the block before it, so a
    long group is spread over many tasks.
    """
    own = F.floor(F.col(seq) / block)
    homes = F.when((F.col(seq) + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = df.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == own)
    w = W.partitionBy(group, "_block").orderBy(seq)
    for c in columns:
        dealt = dealt.withColumn(f"prev_{c}", F.lag(c).over(w))
    return dealt.where("_own").drop("_block", "_own")


class Listed(NamedTuple):
    """Rows that become an ordered list of a document: structs of `columns` in `order`, as a column `name`."""

    rows: DataFrame
    order: Order
    columns: Sequence[str]
    name: str


def _ordered(values: Column, order: Order) -> Column:
    """An array of structs that begin with the columns of `order`, as `_0`, `_1` and so on, in that order."""
    ways = {way for _, way in order}
    if len(ways) == 1:
        return F.sort_array(values, asc=ways == {"asc"})

    def compared(a: Column, b: Column) -> Column:
        found = F.lit(0)
        for i, (_, way) in reversed(list(enumerate(order))):
            x, y, less = a[f"_{i}"], b[f"_{i}"], -1 if way == "asc" else 1
            found = F.when(x.eqNullSafe(y), found).when(x.isNull() | (x < y), less).otherwise(-less)
        return found

    return F.array_sort(values, compared)


def _long_parts(lists: Sequence[Listed], key: str, size: int) -> DataFrame:
    """(key, part, lists): the rows of all lists stacked and numbered once, over ranges of (key, list, order), so that a long
    list is spread over many tasks; then one group by (key, part) builds all lists of a part."""
    stacked = []
    for i, one in enumerate(lists):
        order = [F.col(c).alias(f"_o{i}_{j}") for j, (c, _) in enumerate(one.order)]
        owner = F.struct(F.col(key).alias("key"), F.lit(i).alias("list"))
        stacked.append(one.rows.select(owner.alias("_owner"), *order, F.struct(*one.columns).alias(f"_s{i}")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    ways = [F.col(f"_o{i}_{j}").desc() if way == "desc" else F.col(f"_o{i}_{j}") for i, one in enumerate(lists) for j, (_, way) in enumerate(one.order)]
    placed = positions(rows, "_owner", ways, "_n").withColumn("part", F.expr(f"_n div {size}"))

    def values(i: int, name: str) -> Column:
        mine = F.collect_list(F.when(F.col("_owner.list") == i, F.struct("_n", f"_s{i}")))
        return F.transform(F.array_sort(mine), lambda x: x[f"_s{i}"]).alias(name)

    parts = placed.groupBy(F.col("_owner.key").alias(key), "part").agg(*[values(i, one.name) for i, one in enumerate(lists)])
    return written(parts, "list-parts")


def with_lists(docs: DataFrame, key: str, lists: Sequence[Listed], size: int = LIST_PART) -> DataFrame:
    """Documents with their lists in numbered parts of at most `size` values, so that a key of any size is whole.

    Part 0 has the columns of the document, further parts only its key and more of the lists; a list that a part does not
    have is NULL or empty. Each list is written and its values are counted by key. A list of up to `size` values is one
    group by key; documents and all such lists are dealt by key once, into partitions that follow the rows, and meet there
    without a further exchange. Only longer lists are numbered over ranges (`_long_parts`).
    """
    names = [one.name for one in lists]
    kept = []
    for one in lists:
        columns = dict.fromkeys([key, *(c for c, _ in one.order), *one.columns])
        kept.append(one._replace(rows=written(one.rows.where(F.col(key).isNotNull()).select(*columns), "list-rows")))
    counts = [one.rows.groupBy(key).count().where(F.col("count") > size).select(key, F.lit(i).alias("_list")) for i, one in enumerate(kept)]
    long = written(reduce(DataFrame.unionByName, counts), "long-lists")
    any_long = not long.isEmpty()
    parts = parts_for(*[one.rows for one in kept])
    first = docs.withColumn("part", F.lit(0).cast("bigint")).repartition(parts, key)
    for i, one in enumerate(kept):
        rows = one.rows.join(long.where(F.col("_list") == i), key, "left_anti") if any_long else one.rows
        order = [F.col(c).alias(f"_{j}") for j, (c, _) in enumerate(one.order)]
        values = F.collect_list(F.struct(*order, F.struct(*one.columns).alias("_s")))
        short = rows.repartition(parts, key).groupBy(key).agg(F.transform(_ordered(values, one.order), lambda x: x["_s"]).alias(one.name))
        first = first.join(short, key, "left")
    first = first.select(key, "part", *[c for c in docs.columns if c != key], *names)
    if not any_long:
        return first
    cut = [one._replace(rows=one.rows.join(long.where(F.col("_list") == i), key, "left_semi")) for i, one in enumerate(kept)]
    further = _long_parts(cut, key, size)
    begun = further.where("part = 0").select(key, *[F.col(n).alias(f"_l{i}") for i, n in enumerate(names)])
    begun = first.join(begun, key, "left")
    both = [F.when(F.size(f"_l{i}") > 0, F.col(f"_l{i}")).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)]
    begun = begun.select(*[c for c in first.columns if c not in names], *both)
    more = further.where("part > 0").join(docs.select(key), key, "left_semi")
    return begun.unionByName(more, allowMissingColumns=True)
