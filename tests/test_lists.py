"""Lists of ids: joins and exchanges move a row for each list, and the pairs behind them are the plain ones."""

import re

import pytest
from pyspark.sql import functions as F

from snapspark.domain import Archive
from snapspark.operators import publication as P
from snapspark.operators import relations as J
from snapspark.plans import exports
from snapspark.session import bucketed

BIG = 1 << 40


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def items(spark):
    # Drop 0 has 250 collections, some ids need eight bytes, some are missing, some rows are repeated.
    rows = [(0, i) for i in range(250)] + [(d, c) for d in range(40) for c in (d, d * 7 % 30, BIG + d % 3, None if d % 9 == 0 else d)] + [(None, 5)]
    return spark.createDataFrame(rows, "drop_id bigint, collection_id bigint")


@pytest.fixture
def tokens(spark):
    # Owner o0 has half of all tokens; one in 30 has no owner, one in 25 no drop.
    rows = [(None if i % 30 == 7 else "o0" if i % 2 else f"o{i % 23}", None if i % 25 == 3 else i * 7 % 45) for i in range(900)]
    return spark.createDataFrame(rows, "owner_address_norm string, drop_id bigint")


def test_lists_hold_every_value_once_in_short_rows(spark, items, rows):
    pairs = items.distinct()
    lists = J.id_lists(pairs, "drop_id", "collection_id")
    assert rows(lists.select("drop_id", J.listed_ids("collection_id"))) == rows(pairs)
    assert lists.select(F.max(F.size(F.coalesce(*[F.col(c).cast("array<bigint>") for c in J.IDS])))).first()[0] == J.LIST_IDS
    assert {(r.drop_id, r._far is None) for r in lists.collect()} >= {(0, True), (0, False), (5, False)}
    assert rows(J.single_ids(pairs, "drop_id", "collection_id").select("drop_id", J.listed_ids("collection_id"))) == rows(pairs)


def relations(spark, tokens, items):
    moments = spark.createDataFrame([(f"o{i % 30}", i) for i in range(200)], "author_address_norm string, moment_id bigint")
    tagged = moments.select(F.concat("author_address_norm", F.lit("t")).alias("address_norm"), "moment_id")
    drops = spark.createDataFrame([(i % 200, i % 41) for i in range(600)], "moment_id bigint, drop_id bigint")
    collections = spark.createDataFrame([(i, f"o{i % 5}" if i % 4 else None) for i in range(30)], "collection_id bigint, owner_address_norm string")
    return tokens, items, collections, moments, tagged, J.collection_map(drops, items, 7)


def plain(tokens, items, collections, moments, tagged, pairs):
    mine = moments.withColumnsRenamed({"author_address_norm": "owner"}).union(tagged)
    held = tokens.withColumnRenamed("owner_address_norm", "owner").join(items, "drop_id").select("owner", "collection_id")
    owned = collections.where("owner_address_norm is not null").select("owner_address_norm", "collection_id")
    return held.union(owned).union(mine.join(pairs, "moment_id").select("owner", "collection_id")).distinct()


@pytest.mark.parametrize("busy, heavy", [(10**9, 10**9), (20, 10**9), (20, 30)])
def test_personal_collections_equal_the_plain_ones(spark, tokens, items, rows, monkeypatch, busy, heavy):
    monkeypatch.setattr(J.busy_keys, "__kwdefaults__", {"rows": busy})
    monkeypatch.setattr(P, "HEAVY_LISTS", heavy)
    sides = relations(spark, tokens, items)
    want = rows(plain(*sides))
    assert {("o0", BIG), (None, BIG + 1), ("o0", None)} <= set(want)
    for parts in (31, None):
        assert rows(P.personal_collections(*sides, parts)) == want


def test_pairs_of_moments_equal_the_plain_ones(spark, items, rows, no_broadcast):
    drops = spark.createDataFrame([(i % 200, i % 41) for i in range(600)], "moment_id bigint, drop_id bigint")
    found = J.collection_map(drops, items, 7)
    assert rows(found) == rows(J.collection_map(drops, items)) == rows(drops.join(items, "drop_id").select("moment_id", "collection_id").distinct())


def test_personal_collections_are_dealt_as_lists(spark, tokens, items, no_broadcast):
    text = plan(P.personal_collections(*relations(spark, tokens, items), 31))
    dealt = text.index("Exchange hashpartitioning(owner")
    assert "explode" in text[:dealt].lower() and not re.search(r"Exchange.*\bcollection_id#", text[:dealt])
    # Held drops and the collections of drops lie in buckets: where no drop is heavy, their join moves neither.
    assert text.count("Bucketed: true") >= 2


def test_a_busy_owner_is_taken_apart(spark, tokens, items):
    lists = bucketed(tokens.withColumnRenamed("owner_address_norm", "owner"), "held", "drop_id").join(J.drop_collections(items), "drop_id").drop("drop_id")
    busy = J.busy_keys("owner", tokens.withColumnRenamed("owner_address_norm", "owner"), rows=100)
    assert [(r.owner, r._slices) for r in busy.collect()] == [("o0", 5)]
    dealt = J.dealt_ids(lists, "owner", "collection_id", busy, 16)
    at = dealt.withColumn("p", F.spark_partition_id())
    by = {r.owner: (r.slices, r.parts) for r in at.groupBy("owner").agg(F.count_distinct("collection_id_slice").alias("slices"), F.count_distinct("p").alias("parts")).collect()}
    assert by["o0"][0] == 5 and by["o0"][1] > 1 and {v for k, v in by.items() if k != "o0"} == {(1, 1)}
    assert dealt.groupBy("owner", "collection_id").agg(F.count_distinct("collection_id_slice").alias("n")).agg(F.max("n")).first()[0] == 1


def test_bundle_links_are_dealt_as_lists(spark, sf, no_broadcast):
    text = plan(exports.datasets(Archive(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning\(owner#\d+, collection_id_slice#\d+, \d+\), REPARTITION", text)) == 1
    assert not re.search(r"Exchange hashpartitioning\(owner#\d+, collection_id#", text)
    # Relations of bundles are read as they were written: moments with two columns, each pair of collection and drop once.
    assert "description" not in text and "events.parquet" in text
    assert "Window" not in text and text.count("HashAggregate(keys=[l_suppkey") == 0
