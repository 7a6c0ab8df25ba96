"""T: resumable loads, run over files that Spark writes from the archive tables and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import loads as L
from .registry import query


def _files(rows, name, by):
    """Write rows as files, dealt by a column, and open them as a stream of several batches."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.repartition(by).write.parquet(path)
    return path, rows.schema


def _stream(spark, path, schema):
    return L.file_stream(spark, path, schema, files_per_batch=3)


SHARD = "'events-' || event_id % 8"


@query("t01_shard_load", f"""
  select {SHARD} as shard_path, case event_id % 8 when 3 then 'changed' when 5 then 'changed' when 6 then 'partial' when 7 then 'unknown' else 'loaded' end as verdict,
    count(*) as journal_rows, case when event_id % 8 in (3, 5, 6, 7) then 0 else count(*) end as data_rows, 0 as added_by_second_run from events group by 1, 2, event_id % 8
  union all select 'events-none', 'missing', 0, 0, 0""")
def _(a):
    """Shards spread over all files: one with a row too many, one with another row than planned, one not complete, one not planned, one never sent."""
    spark = a.spark
    tag = F.concat(F.lit("events-"), (F.col("event_id") % 8).cast("string"))
    columns = ["event_id", "user_id", "event_type"]
    rows = a.events.select(*columns, tag.alias("shard_path"))
    path, schema = _files(rows, "events", "event_id")
    shard = F.col("shard_path")
    plan = rows.groupBy("shard_path").agg(F.count("*").alias("row_count"), L.row_digest(columns).alias("digest")).where(shard != "events-7")
    plan = plan.withColumn("row_count", F.col("row_count") - F.when(shard == "events-3", 1).when(shard == "events-6", -1).otherwise(0))
    plan = plan.withColumn("digest", F.when(shard == "events-5", "0").otherwise(F.col("digest")))
    plan = plan.unionByName(spark.range(1).select(F.lit("events-none").alias("shard_path"), F.lit(5).cast("bigint").alias("row_count"), F.lit("0").alias("digest")))
    data, checkpoint = scratch_path(spark, "load-data"), scratch_path(spark, "load-checkpoint")
    L.stage_shards(_stream(spark, path, schema), data, checkpoint)
    before = spark.read.parquet(data).count()  # one number, taken before the second run
    L.stage_shards(_stream(spark, path, schema), data, checkpoint)
    staged = spark.read.parquet(data)
    journal = L.shard_journal(staged, plan, columns)
    per = L.loaded_rows(staged, journal).groupBy("shard_path").agg(F.count("*").alias("data_rows"))
    added = staged.agg(F.count("*") - F.lit(before)).scalar()
    return journal.join(per, "shard_path", "left").select(
        "shard_path", "verdict", F.col("rows").alias("journal_rows"), F.coalesce("data_rows", F.lit(0)).alias("data_rows"), added.alias("added_by_second_run"))


@query("t02_projection_append", "select drop_id, token_id, source_uid, owner_address_norm from $tokens")
def _(a):
    path, schema = _files(a.tokens, "tokens", "source_uid")
    out, checkpoint = scratch_path(a.spark, "refs"), scratch_path(a.spark, "refs-checkpoint")
    project = lambda rows: rows.select("drop_id", "token_id", "source_uid", "owner_address_norm")
    for _run in range(2):  # the second run finds no new file
        L.append_projection(_stream(a.spark, path, schema), project, out, checkpoint)
    return a.spark.read.parquet(out)


@query("t03_running_counts", """
  select event_type as table_name, count(*) as loaded, case when event_type = 'view' then 10 when event_type = 'error' then null end as expected_rows
  from events where event_type in ('view', 'error') group by 1""")
def _(a):
    rows = a.events.select(F.col("event_type").alias("table_name"), "event_id")
    path, schema = _files(rows, "loaded", "event_id")
    plan = rows.where("table_name <> 'error'").groupBy("table_name").agg(F.count("*").alias("expected_rows"))
    plan = plan.withColumn("expected_rows", F.when(F.col("table_name") == "view", F.lit(10).cast("bigint")).otherwise(F.col("expected_rows")))
    out, checkpoint = scratch_path(a.spark, "counts"), scratch_path(a.spark, "counts-checkpoint")
    L.write_updates(L.running_counts(_stream(a.spark, path, schema), "table_name"), out, checkpoint)
    return L.over_plan(L.current(a.spark, out, "table_name"), plan, "table_name")


@query("t04_first_suppressions", "select moment_id, 'appeal' as reason_code, 1 as seq from $moment_suppressions where active = 1")
def _(a):
    """Every suppression comes three times: inactive, later, and earlier for another reason; the earlier active one stands."""
    rows = a.moment_suppressions
    later = rows.withColumn("seq", F.lit(2))
    first = rows.withColumn("seq", F.lit(1)).withColumn("reason_code", F.lit("appeal"))
    again = later.unionByName(rows.withColumn("active", F.lit(0)).withColumn("seq", F.lit(0))).unionByName(first)
    path, schema = _files(again, "suppressions", "moment_id")
    out, checkpoint = scratch_path(a.spark, "accepted"), scratch_path(a.spark, "accepted-checkpoint")
    first = L.first_of("moment_id", ["seq", "reason_code"], ["reason_code", "seq"])
    L.fold_batches(L.accepted_suppressions(_stream(a.spark, path, schema), True), first, out, checkpoint, every=2)
    return L.folded(a.spark, out, first).select("moment_id", "reason_code", "seq")


@query("t05_latest_states", "select media_key, seq, status, sha256 from $capture_log qualify row_number() over (partition by media_key order by seq desc) = 1")
def _(a):
    path, schema = _files(a.capture_log, "capture", "media_key")
    out, checkpoint = scratch_path(a.spark, "states"), scratch_path(a.spark, "states-checkpoint")
    last = L.last_of("media_key", "seq", ["status", "sha256"])
    L.fold_batches(_stream(a.spark, path, schema), last, out, checkpoint, every=2)
    return L.folded(a.spark, out, last)
