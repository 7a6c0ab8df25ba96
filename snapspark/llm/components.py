"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large-star and small-star steps in turn (each node's neighbours are linked to the smallest one near it) until the
    edges no longer change. Every step is grouped minima joined back, so a node with very many neighbours is not one row
    or one task; each round starts from files in the shared folder.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).dropDuplicates(), "edges"
    )
    before = _state(pairs)
    while before[0]:
        both = pairs.select(F.col("v").alias("node"), F.col("u").alias("to")).unionByName(pairs.select(F.col("u").alias("node"), F.col("v").alias("to")))
        lowest = both.groupBy("node").agg(F.least("node", F.min("to")).alias("low"))
        large = both.join(lowest, "node").where("to > node").select(F.col("to").alias("v"), F.col("low").alias("u")).dropDuplicates()
        nearest = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(nearest, "v").where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        pairs = stored(small.unionByName(nearest.withColumnRenamed("low", "u")).dropDuplicates(), "edges")
        after = _state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).dropDuplicates()
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
