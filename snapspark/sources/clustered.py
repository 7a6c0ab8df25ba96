"""Stored copies of a table in the order of a key, of which asked keys read only the files that hold them.

A copy is a folder with `rows`, cut by `range`: ranges of (key, order) with sorted rows, one file each; and `ranges`: one row
(range, low, high) for each of them. A key with very many rows goes on over several ranges.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordering as O

MOST_ASKED = 2000  # keys that are looked up; more keys meet the whole copy in a join


def write_clustered(rows: DataFrame, path: str, key: str, order: O.Order, files: int | None = None) -> None:
    """A copy of the rows in the order of `key`, and of `order` inside a key."""
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(key).asc(), *O.sort_columns(order)]
    ranged = rows.repartitionByRange(files, *sort).sortWithinPartitions(*sort).withColumn("range", F.spark_partition_id())
    ranged.write.partitionBy("range").parquet(f"{path}/rows")
    spans = _rows(spark, path, rows).groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    spans.coalesce(1).write.parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read
    if like is not None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        reader = reader.schema(f"{fields}, `range` int")
    return reader.parquet(f"{path}/rows")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).drop("range")


def _ranges(spark: SparkSession, path: str) -> list[tuple]:
    """(low, high, range), one for each file of the copy."""
    return sorted((r["low"], r["high"], r["range"]) for r in spark.read.parquet(f"{path}/ranges").where("low is not null").collect())


def read_keys(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows of the asked keys (a column `key`). Up to `MOST_ASKED` keys are pushed to the scan, with the ranges that hold them."""
    asked = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(MOST_ASKED + 1).collect()]
    rows = _rows(spark, path)
    if len(asked) > MOST_ASKED:
        return rows.drop("range").join(keys.select(key).distinct(), key, "left_semi")
    asked.sort()
    held = []
    for low, high, at in _ranges(spark, path):
        first = bisect_left(asked, low)
        if first < len(asked) and asked[first] <= high:
            held.append(at)
    return rows.where(F.col("range").isin(held)).where(F.col(key).isin(asked)).drop("range")


def read_between(spark: SparkSession, path: str, key: str, low, high=None) -> DataFrame:
    """Rows with low <= key, and key < high if there is a high."""
    held = [at for first, last, at in _ranges(spark, path) if last >= low and (high is None or first < high)]
    test: Column = F.col(key) >= F.lit(low)
    if high is not None:
        test = test & (F.col(key) < F.lit(high))
    return _rows(spark, path).where(F.col("range").isin(held)).where(test).drop("range")
