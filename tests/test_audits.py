"""Tamper tests: a clean dataset is silent, a changed row is named; sources and streams on small files."""

import pytest
from pyspark.sql import functions as F

from snapspark import schemas
from snapspark.domain import Archive
from snapspark.operators import audit as D
from snapspark.session import scratch_path
from snapspark.sources import layout as S
from snapspark.streaming import loads as L


@pytest.fixture(scope="module")
def archive(spark, sf):
    return Archive(spark, sf)


def keys(df):
    return sorted((r.rule, r.key) for r in df.collect())


def test_row_comparison_names_exactly_the_changed_row(archive):
    base = archive.drops_base.select("drop_id", "title", "city")
    assert D.compare_rows(base, base, ["drop_id"]).count() == 0
    changed = base.withColumn("city", F.when(F.col("drop_id") == 5, "X").otherwise(F.col("city"))).where("drop_id <> 6")
    assert sorted((r.drop_id, r.change, r.changed_columns) for r in D.compare_rows(base, changed, ["drop_id"]).collect()) == [(5, "changed", "city"), (6, "removed", "")]


def test_digest_ignores_order_and_partitions_but_not_nulls_or_copies(spark, archive):
    base = archive.drops_base
    digest = lambda df: D.multiset_digest(df, sorted(df.columns)).collect()[0].digest
    assert digest(base) == digest(base.repartition(16)) == digest(base.repartition(1).orderBy(F.desc("title")))
    assert digest(base) != digest(base.unionByName(base.where("drop_id = 5")))
    rows = lambda *data: spark.createDataFrame(list(data), "a string, b string")
    assert digest(rows((None, "x"))) != digest(rows(("x", None)))


def test_foreign_key_counts(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p int")
    parent = spark.createDataFrame([(1,)], "id int")
    found = D.foreign_keys({"x": (child, "p"), "y": (child.where("p is not null"), "p"), "none": (child.limit(0), "p")}, parent, "id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in found.collect()} == {("x", 3, 1, 1), ("y", 3, 1, 0), ("none", 0, 0, 0)}


def test_derived_arrays_name_the_collection(spark):
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 9), (3, 9)], "collection_id int, drop_id int")
    view = spark.createDataFrame([(1, [11, 10]), (2, [10, 12]), (4, [])], "collection_id int, drop_ids array<int>")
    assert keys(D.derived_arrays(view, items)) == [("drop_ids_mismatch", "2"), ("duplicate_membership", "3"), ("row_missing", "3")]


def test_constraints_follow_the_declared_checks(spark):
    rows = spark.createDataFrame([(1, "0x" + "a" * 40, 1, 0), (2, "0xA", -1, None)], "source_uid int, owner_address_norm string, minted_on bigint, transfer_count bigint")
    assert keys(D.check_constraints(rows, "tokens", "source_uid", schemas.checks()["tokens"])) == [("minted_on_range", "2"), ("owner_shape", "2")]


def test_missing_columns_stop_the_job(spark):
    with pytest.raises(ValueError, match="network"):
        schemas.require_columns(spark.range(1).selectExpr("id as token_id"), "tokens")


def test_page_audit(spark):
    schema = "entity string, page bigint, rows array<struct<id:bigint,name:string,drops:array<struct<moment_id:bigint,drop_id:bigint>>>>"
    row = lambda i, n=0: (i, "n", [(i, d) for d in range(n)])
    pages = [("m", 1, [row(1), row(2)]), ("m", 2, [row(3), row(4)])]
    claims = spark.createDataFrame([("m", 4, 4)], "entity string, upper_bound bigint, expected_rows bigint")
    assert D.page_audit(spark.createDataFrame(pages, schema), claims, 5).count() == 0
    bad = [("m", 1, [row(2), row(1)]), ("m", 3, [row(2), row(3, 5)])]
    assert keys(D.page_audit(spark.createDataFrame(bad, schema), claims, 5)) == [
        ("nested_relation_unsafe", "m:3"), ("order_invalid", "m:1"), ("order_invalid", "m:3"), ("page_gap", "m:3"), ("upper_bound_mismatch", "m")]


def test_file_inventory_and_checksums(spark, tmp_path):
    for name, data in (("1.webp", b"RIFF0000WEBP"), ("sub/1.webp", b"x"), ("2.webp", b"y"), ("cover.png", b"z")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    listing = S.read_listing(spark, str(tmp_path)).drop("content")
    got = sorted((r.path.split("/")[-1], r.byte_length, r.drop_id, r.outcome) for r in S.inventory(listing).collect())
    assert got == [("1.webp", 1, 1, "duplicate"), ("1.webp", 12, 1, "duplicate"), ("2.webp", 1, 2, "ok"), ("cover.png", 1, None, "bad_name")]
    tampered = listing.withColumn("sha256", F.when(F.col("byte_length") == 12, "0").otherwise(F.col("sha256")))
    assert [r.rule for r in D.file_checksums(listing, tampered).collect()] == ["shard_differs"]


def test_prefix_bounds():
    assert S.prefix_bounds("0f") == ("0x0f" + "0" * 38, "0x10" + "0" * 38)
    assert S.prefix_bounds("ff") == ("0xff" + "0" * 38, None)
    with pytest.raises(ValueError):
        S.prefix_bounds("G")


def test_id_shards_match_the_closed_form(spark):
    upper, n = 1003, 7
    got = {r.id: r.s for r in spark.range(1, upper + 1).select("id", S.id_shard(F.col("id"), upper, n).alias("s")).collect()}
    for i in range(n):
        low, high = upper * i // n, upper * (i + 1) // n
        assert all(got[x] == i for x in range(low + 1, high + 1))


def test_csv_files_have_mark_header_and_crlf(spark):
    lines = spark.createDataFrame([("o1", i, f"u{i}", f'"{i}"') for i in range(12)], "owner string, token_id bigint, uid string, line string")
    path = scratch_path(spark, "csv-test")
    S.write_csv(lines, '"token"', path, "owner", ["token_id", "uid"], 2)
    files = [r.content for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()]
    assert all(bytes(f).startswith("﻿\"token\"\r\n".encode()) for f in files)
    assert sum(bytes(f).count(b"\r\n") for f in files) == 12 + len(files)


def test_second_run_reads_only_new_files(spark):
    src, out, chk = (scratch_path(spark, n) for n in ("src", "out", "chk"))
    add = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "id % 3 as k").write.mode("append").parquet(src)
    run = lambda: L.write_updates(L.running_counts(L.file_stream(spark, src, "id bigint, k bigint"), "k"), out, chk)
    add(0, 30)
    run()
    run()
    assert sorted(tuple(r) for r in L.current(spark, out, "k").collect()) == [(0, 10), (1, 10), (2, 10)]
    add(30, 33)
    run()
    assert sorted(tuple(r) for r in L.current(spark, out, "k").collect()) == [(0, 11), (1, 11), (2, 11)]
