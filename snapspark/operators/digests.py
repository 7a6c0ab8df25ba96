"""Hash trees over ranges of a number: digests that see the order of rows, and tell which range differs.

A leaf is a range of `width` consecutive values of `at` (around zero, twice that) and has the SHA-256 of its rows' digests in the order of `at`; a node
above has that of its `fan` children. With the place of a row as `at` the root stands for the ordered stream; with an id, a
row more or less changes its own leaf alone. Leaves are collected in tasks, so `at` must be unique within a group, or nearly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..session import written
from .audit import compare_rows
from .relations import union_all

WIDTH, FAN = 1024, 64


def _joined(digests: str, by: str) -> Column:
    """SHA-256 of the digests of structs (`by`, digest), in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, digests))), lambda x: x[digests]), ""), 256)


def tree(rows: DataFrame, at: str, columns: Sequence[str], group: Sequence[str] = (), width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """(group, level, block, rows, bytes, digest): all nodes of a tree for each group; level 0 are the leaves.

    The node of a group that has only one, block 0, stays as it is on the levels above, so that the digest of a small group
    does not depend on how high the trees of others are.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = rows.select(*group, F.col(at).cast("bigint").alias("_at"), F.sha2(text, 256).alias("_digest"), (F.octet_length(text) + 1).alias("_bytes"))
    keys = [*group, "block"]
    leaves = rows.withColumn("block", F.expr(f"_at div {width}")).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("_bytes").alias("bytes"), _joined("_digest", "_at").alias("digest")
    )
    levels = [written(leaves, "digest-leaves")]
    while True:
        below = levels[-1]
        low, high = below.agg(F.min("block"), F.max("block")).first()
        if low == high or low is None:
            break
        dealt = below.withColumnRenamed("digest", "_digest").withColumn("_child", F.col("block")).withColumn("block", F.expr(f"block div {fan}"))
        only = (F.count("*") == 1) & (F.max("_child") == 0)
        up = dealt.groupBy(*keys).agg(
            F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.when(only, F.max("_digest")).otherwise(_joined("_digest", "_child")).alias("digest")
        )
        levels.append(written(up, "digest-level"))
    return union_all(*[level.select(*group, F.lit(i).alias("level"), "block", "rows", "bytes", "digest") for i, level in enumerate(levels)])


def roots(nodes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, rows, bytes, digest) of whole groups, for places that begin at 0."""
    top = nodes.where("block = 0").groupBy(*group).agg(F.max(F.struct("level", "rows", "bytes", "digest")).alias("_top"))
    return top.select(*group, "_top.rows", "_top.bytes", "_top.digest")


def ordered(rows: DataFrame, order: list[str], columns: Sequence[str], group: str, width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """(group, rows, bytes, digest): the digest of each group's rows in their order, found over ranges of (group, order)."""
    placed = O.positions(rows.select(group, *dict.fromkeys([*order, *columns])), group, order, "_place")
    return roots(tree(placed, "_place", columns, [group], width, fan), [group])


def differing(primary: DataFrame, secondary: DataFrame, group: Sequence[str] = (), fan: int = FAN) -> DataFrame:
    """(group, block, primary_rows, secondary_rows): leaves that differ between two trees of one width and fan.

    From the top down, nodes are compared only below nodes that differ. The trees may be of unequal height.
    """
    keys = [*group, "block"]

    def level(nodes: DataFrame, at: int) -> DataFrame:
        return nodes.where(F.col("level") == at)

    top = min(nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for nodes in (primary, secondary))
    found = None
    for at in range(top, -1, -1):
        sides = [level(nodes, at).select(*keys, F.col("rows").alias(f"_{side}_rows"), F.col("digest").alias(f"_{side}")) for side, nodes in (("p", primary), ("s", secondary))]
        if found is not None:
            inside = found.select(*group, F.col("block").alias("_up"))
            sides = [side.withColumn("_up", F.expr(f"block div {fan}")).join(inside, [*group, "_up"], "left_semi").drop("_up") for side in sides]
        both = sides[0].join(sides[1], keys, "full_outer")
        found = both.where(~F.col("_p").eqNullSafe(F.col("_s")))
    zero = F.lit(0).cast("bigint")
    return found.select(*keys, F.coalesce("_p_rows", zero).alias("primary_rows"), F.coalesce("_s_rows", zero).alias("secondary_rows"))


def compare_located(primary: DataFrame, secondary: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """As `compare_rows` on one number as key, but only rows of differing ranges meet in the join."""
    columns = sorted(primary.columns)
    trees = [tree(side, key, columns, width=width) for side in (primary, secondary)]
    ranges = differing(*trees).select(F.col("block").alias("_block"))
    block = F.expr(f"{key} div {width}")
    sides = [side.withColumn("_block", block).join(ranges, "_block", "left_semi").drop("_block") for side in (primary, secondary)]
    return compare_rows(*sides, [key])
