"""Steps whose keys hardly repeat: the partitions follow the rows, so that a task's hash tables do not grow with them."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from snapspark.functions import ordering as O
from snapspark.operators import aggregates as G
from snapspark.operators import browse as B
from snapspark.operators import exports as X
from snapspark.operators import publication as P
from snapspark.operators import relations as J
from snapspark.domain import Archive
from snapspark.plans import exports
from snapspark.session import parts_for


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_rows(spark):
    table = spark.range(1000)
    assert parts_for(table, rows=500) == 8 and parts_for(table, rows=10) == 100 and parts_for(table, table, rows=10) == 200


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def held(spark):
    return spark.createDataFrame([(f"o{i % 50}", i % 70) for i in range(2000)], "owner string, drop_id bigint")


def test_coverage_groups_once_in_as_many_partitions_as_asked(held):
    some, other = held.where("drop_id < 40"), held.where("drop_id > 45 and drop_id < 60")
    seen = J.coverage_partition(held.where("drop_id < 69"), some.unionByName(some), other.unionByName(held.where("drop_id in (3, 69)")), ["owner", "drop_id"], 31)
    assert len(re.findall(r"Exchange hashpartitioning\(.*, 31\)", plan(seen))) == 1 and plan(seen).count("Exchange") == 1
    found = {(r.drop_id, r.rule) for r in seen.collect()}
    assert found == {(3, "overlap"), (69, "unreferenced"), *((d, "missing") for d in [*range(40, 46), *range(60, 69)])}


def test_held_status_is_dealt_as_asked(spark, held):
    tokens, known = held.withColumnRenamed("owner", "owner_address_norm"), spark.range(30).withColumnRenamed("id", "drop_id")
    status = P.held_drop_status(tokens, known, 31)
    assert "31)" in plan(status) and sorted(map(tuple, status.collect())) == sorted(map(tuple, P.held_drop_status(tokens, known).collect()))
    assert O.dealt(held, 31, "owner").rdd.getNumPartitions() == 31


@pytest.fixture
def references(spark):
    rows = [(f"o{i % 20}", ("items", "moments")[i % 2], "k", str(i % 90), f"u{i % 45}" if i % 7 else "", i % 11 or None, f"t{i % 2}") for i in range(3000)]
    return spark.createDataFrame(rows, "owner string, category string, kind string, ref string, url string, bytes bigint, type string")


@pytest.mark.parametrize("step", [X.image_reference_rows, X.image_plan, G.url_coverage])
def test_references_of_a_url_meet_once_in_as_many_partitions_as_asked(references, step):
    found = step(references, 31)
    exchanges = [line for line in plan(found).splitlines() if "Exchange hashpartitioning(owner" in line]
    assert sum("url" in line.split("hashpartitioning")[1].split("]")[0] for line in exchanges) == 1 and "31)" in exchanges[-1]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, step(references).collect()), key=key)


def personal(spark, held):
    moments = spark.createDataFrame([(f"o{i % 30}", i) for i in range(200)], "author_address_norm string, moment_id bigint")
    tagged = moments.select(F.concat("author_address_norm", F.lit("t")).alias("address_norm"), "moment_id")
    drops = spark.createDataFrame([(i % 200, i % 90) for i in range(600)], "moment_id bigint, drop_id bigint")
    return held.withColumnRenamed("owner", "owner_address_norm"), moments, tagged, drops, held.where("drop_id > 60")


def test_personal_references_are_dealt_as_asked(spark, held):
    sides = personal(spark, held)
    found, want = P.personal_references(*sides, 31), P.personal_references(*sides)
    assert len(re.findall(r"Exchange hashpartitioning\(owner.*drop_id.*, 31\)", plan(found))) == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_associations_need_no_distinct_of_the_pairs(spark, no_broadcast):
    moments = spark.createDataFrame([(f"o{i % 30}", i % 150) for i in range(400)], "who string, moment_id bigint")
    drops = spark.createDataFrame([(i % 200, i % 90) for i in range(600)], "moment_id bigint, drop_id bigint")
    items = spark.createDataFrame([(i % 90, i % 25) for i in range(900)], "drop_id bigint, collection_id bigint")
    found = P.moment_associations(moments, "who", J.collection_map(drops, items, 31))
    text, rows = plan(found), sorted(map(tuple, found.collect()))
    plain = moments.withColumnRenamed("who", "owner").join(drops, "moment_id").join(items, "drop_id").select("owner", "collection_id", "moment_id").distinct()
    assert rows == sorted(map(tuple, plain.collect())) and len(set(rows)) == len(rows)
    assert "Aggregate" not in text[: text.index("SortMergeJoin")]
    assert len(re.findall(r"Exchange hashpartitioning\(moment_id\S*, 31\), REPARTITION", text)) == 1


def test_personal_collections_are_dealt_as_asked(spark, held):
    tokens, moments, tagged, drops, _ = personal(spark, held)
    items = spark.createDataFrame([(i % 90, i % 25) for i in range(900)], "drop_id bigint, collection_id bigint")
    collections = spark.createDataFrame([(i, f"o{i % 5}" if i % 4 else None) for i in range(30)], "collection_id bigint, owner_address_norm string")
    sides = tokens, items, collections, moments, tagged, J.collection_map(drops, items)
    found = P.personal_collections(*sides, 31)
    assert len(re.findall(r"Exchange hashpartitioning\(owner.*collection_id.*, 31\)", plan(found))) == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, P.personal_collections(*sides).collect()))


def test_bundle_links_are_dealt_by_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(exports, "parts_for", lambda *tables, rows=0: 31 if rows == 50_000 else 29)
    text = plan(exports.datasets(Archive(spark, sf)))
    assert re.search(r"Exchange hashpartitioning\(owner[^)]*collection_id[^)]*, 31\), REPARTITION", text)
    assert re.search(r"Exchange hashpartitioning\(owner[^)]*drop_id[^)]*, 29\), REPARTITION", text)


@pytest.fixture
def tokens(spark):
    # Drop 0 has a third of all tokens, one in fifty has no drop, and owners hold several tokens of one drop.
    rows = [(f"o{i % 25}", i // 2, f"u{i}", None if i % 50 == 7 else 0 if i % 3 == 0 else i % 40, i, f"n{i % 2}", i % 5) for i in range(900)]
    return spark.createDataFrame(rows, "owner_address_norm string, token_id bigint, source_uid string, drop_id bigint, minted_on bigint, network string, transfer_count bigint")


def collectors(tokens, parts=None, keys=None):
    return B.drop_collectors(tokens.select("drop_id", "token_id", "source_uid", "owner_address_norm"), tokens, keys, 20, parts)


@pytest.mark.parametrize("hot", [10**9, 100, 0])
def test_pages_of_dealt_drops_equal_the_plain_ones(spark, tokens, rows, monkeypatch, hot):
    monkeypatch.setattr(B, "HOT_DROP", hot)
    asked = spark.createDataFrame([(0,), (3,), (4,), (99,)], "drop_id bigint")
    want, found = collectors(tokens), collectors(tokens, 31)
    assert found.columns == want.columns and rows(found) == rows(want)
    assert {0, None} < {r.drop_id for r in found.collect()} and found.where("drop_id = 0 and has_next").count() == 20
    assert rows(collectors(tokens, 31, asked)) == rows(collectors(tokens, keys=asked))


def test_a_page_is_not_moved_a_second_time(tokens, no_broadcast):
    text = plan(collectors(tokens.where("drop_id is not null"), 31))
    assert len(re.findall(r"Exchange hashpartitioning\(drop_id\S*, 31\), REPARTITION", text)) == text.count("Exchange") == 2


@pytest.mark.parametrize("name", ["k04_drop_collectors_page", "k04_asked_drop_pages"])
def test_tokens_of_a_collectors_page_are_worked_out_once(spark, sf, no_broadcast, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "orders.parquet" not in text and "lineitem.parquet" not in text
    assert "Exchange hashpartitioning(drop_id" in text and "Exchange hashpartitioning(owner" not in text
