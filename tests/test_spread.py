"""Joins and stored copies on uneven keys."""

import re

import pytest
from pyspark.sql import functions as F

from snapspark.functions import ordering as O
from snapspark.operators import relations as J
from snapspark.session import bucketed, scratch_path
from snapspark.sources import clustered as K
from snapspark.sources import layout as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def sides(spark):
    # Drop 0 has a third of all owners and collections.
    owners = spark.createDataFrame([(0 if i % 3 == 0 else i % 40, f"o{i}") for i in range(900)], "drop_id int, owner string")
    collections = spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i) for i in range(300)], "drop_id int, collection_id int")
    return owners, collections


@pytest.mark.parametrize("pairs", [1, 500, 10**9])
def test_spread_join_equals_the_plain_one(spark, pairs):
    left, right = sides(spark)
    rows = lambda df: sorted(tuple(r) for r in df.select("drop_id", "owner", "collection_id").collect())
    want = rows(left.join(right, "drop_id"))
    assert rows(J.spread_join(left, right, "drop_id", pairs)) == want
    assert rows(J.spread_join(right, left, "drop_id", pairs)) == want
    assert J.spread_join(left.limit(0), right, "drop_id").count() == 0


def test_pairs_of_a_hot_key_are_made_by_many_tasks(spark, no_broadcast):
    left, right = sides(spark)
    left, right = (df.where("drop_id = 0") for df in (left, right))
    joined = J.spread_join(left, right, "drop_id", 500).select(F.spark_partition_id().alias("p"))
    assert joined.count() == left.count() * right.count()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in joined.groupBy("p").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_bucketed_relations_meet_without_an_exchange(spark, no_broadcast):
    left, right = (bucketed(df, "side", "drop_id") for df in sides(spark))
    joined = left.join(right, "drop_id")
    assert "Exchange" not in plan(joined) and joined.count() == sides(spark)[0].join(sides(spark)[1], "drop_id").count()
    assert "Exchange hashpartitioning" not in plan(left.groupBy("drop_id").count())


def test_asked_keys_read_only_their_files(spark):
    order = (("token", "desc"),)
    rows = spark.createDataFrame([(f"k{min(i % 60, 30):02d}", i, str(i)) for i in range(3000)], "key string, token int, text string").repartition(5)
    path = scratch_path(spark, "copy")
    K.write_clustered(rows, path, "key", order, files=12)
    assert sorted(map(tuple, K.read_all(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    for asked in (["k05"], ["k30"], ["k00", "k29", "nothing"], ["zz"], []):
        keys = spark.createDataFrame([(k,) for k in [*asked, None]], "key string")
        found = K.read_keys(spark, path, "key", keys)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.where(F.col("key").isin(asked)).collect()))
        if asked == ["k05"]:
            assert re.search(r"PartitionFilters: \[range#\d+ (IN|=)|PartitionFilters: \[.*range", plan(found)) and "EqualTo(key,k05)" in plan(found) or "In(key, [k05])" in plan(found)
            assert len(found.select(F.input_file_name()).distinct().collect()) < 4
    between = K.read_between(spark, path, "key", "k10", "k12")
    assert sorted(map(tuple, between.collect())) == sorted(map(tuple, rows.where("key >= 'k10' and key < 'k12'").collect()))
    assert K.read_between(spark, path, "key", "k30").count() == 1500
    # A hot key goes on over several files, in its order.
    hot = K._rows(spark, path).where("key = 'k30'")
    spans = sorted((r.low, r.high) for r in hot.groupBy("range").agg(F.min("token").alias("low"), F.max("token").alias("high")).collect())
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_more_keys_than_are_looked_up_meet_the_copy_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_ASKED", 2)
    rows = spark.createDataFrame([(i % 9, i) for i in range(90)], "key int, token int")
    path = scratch_path(spark, "copy")
    K.write_clustered(rows, path, "key", (("token", "asc"),), files=3)
    assert K.read_keys(spark, path, "key", spark.createDataFrame([(1,), (2,), (3,), (3,)], "key int")).count() == 30


def test_csv_sections_are_exact_and_in_order(spark):
    header = '"owner","n"'
    data = [("a", i) for i in range(47)] + [(f"o{i:02d}", j) for i in range(30) for j in range(i % 4)] + [("z", 1)]
    lines = spark.createDataFrame([(o, n, f'"{o}","{n}"') for o, n in data] + [("z", 2, header)], "owner string, n int, line string").repartition(4)
    path = scratch_path(spark, "csv")
    S.write_csv(lines, header, path, "owner", ["n"], most=10)
    back = S.read_csv_lines(spark, path).collect()
    assert sorted(r.line for r in back) == sorted(r.line for r in lines.collect())
    by_file = {}
    for r in back:
        by_file.setdefault(r.file, []).append(r.line)
    assert max(map(len, by_file.values())) == 10
    # Files one after the other have all rows in order, newest first in an owner.
    whole = [line for file in sorted(by_file) for line in by_file[file]]
    ordered = sorted(data, key=lambda r: (r[0], -r[1]))
    assert [w for w in whole if w != header] == [f'"{o}","{n}"' for o, n in ordered]
    raw = spark.read.option("lineSep", "\r\n").text(path).where(F.col("value").contains(header)).count()
    assert raw == len(by_file) + 1  # one line of data reads like the header and stays
