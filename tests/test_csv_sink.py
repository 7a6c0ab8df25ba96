"""The CSV sink on many owners: what is held in memory does not follow the owners."""

import glob
import gzip
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapspark.functions import ordering as O
from snapspark.session import kept_partitions, scratch_path
from snapspark.sources import layout as S


def owners(spark):
    # Owners of 1 to 60 lines, and one with a third of all.
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 97)).alias("owner"), F.col("id").alias("n"))
    return rows.withColumn("line", F.format_string('"%s","%d"', "owner", "n"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_not_broadcast(spark, monkeypatch):
    plans, stored = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, name: plans.setdefault(name, plan(df)) and stored(df, name))
    S.write_csv(owners(spark), '"owner","n"', scratch_path(spark, "csv"), "owner", ["n"], most=50, parts=5)
    joins = re.findall(r"(\w+Join)[^\n]*_section", plans["csv-blocks"])
    assert joins == ["SortMergeJoin"] and "BroadcastExchange" not in plans["csv-blocks"]


def test_ranges_keep_the_columns_asked_for(spark):
    kept = O.ranges(owners(spark), "owner", [F.col("n").desc()], 4, kept=["line"])
    assert kept.columns == ["owner", "line", "_range", "_place", "_of"] and kept.count() == 3000


@pytest.mark.parametrize("parts, most", [(5, 50), (90, 50), (5, 2000), (1, 7)])
def test_every_file_is_one_stream_in_order(spark, parts, most):
    rows, path = owners(spark), scratch_path(spark, "csv")
    S.write_csv(rows, '"owner","n"', path, "owner", ["n"], most=most, parts=parts)
    found = {}
    for name in glob.glob(path.removeprefix("file:") + "/file=*/*.gz"):
        found.setdefault(int(re.search(r"/file=(\d+)/", name)[1]), []).append(gzip.open(name, "rt", newline="").read())
    assert sorted(found) == list(range(len(found))) and {len(streams) for streams in found.values()} == {1}
    texts = [found[i][0].split("\r\n") for i in range(len(found))]
    assert all(t[0] == '\ufeff"owner","n"' and t[-1] == "" and len(t) - 2 <= most for t in texts)
    want = [r.line for r in rows.orderBy("owner", F.desc("n")).collect()]
    assert [line for t in texts for line in t[1:-1]] == want


def test_a_sink_is_not_written_twice(spark):
    path = scratch_path(spark, "csv")
    for again in (False, True):
        if again:
            with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
                S.write_csv(owners(spark), "n", path, "owner", ["n"])
        else:
            S.write_csv(owners(spark), "n", path, "owner", ["n"])


def test_kept_partitions_are_read_whole_and_not_dealt(spark):
    rows = spark.range(0, 9000, 1, 13).withColumn("at", F.spark_partition_id())
    kept = kept_partitions(rows, "kept", "at", 13)
    placed = kept.withColumn("n", F.row_number().over(W.partitionBy("_bucket", F.col("id") % 7).orderBy("id"))).withColumn("task", F.spark_partition_id())
    assert "Exchange" not in plan(placed)
    found = placed.groupBy("at", "task").agg(F.max("n")).collect()
    assert len(found) == len({r.at for r in found}) == len({r.task for r in found}) == 13
    assert sorted(r.id for r in kept.collect()) == list(range(9000))
