"""Resumable incremental loading: file streams, journals, running counters and latest states.

Every query runs with `availableNow` and a checkpoint: a second run reads only new files. `foreachBatch` may see a
batch twice after a failure, so each batch overwrites its own `batch_id=<n>` folder and a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Transform = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _batch_path(path: str, batch: int) -> str:
    return f"{path}/batch_id={batch}"


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run until all files present at the start are read."""
    started = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def stage_shards(stream: DataFrame, data: str, checkpoint: str) -> None:
    """Stage the rows of shard files; what a shard is worth is judged over everything staged (`shard_journal`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(data, batch_id))

    run_batches(stream, checkpoint, write)


def row_digest(columns: list[str]) -> Column:
    """A digest of the multiset of rows, as an aggregate: the sum of 60-bit row digests."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def shard_journal(staged: DataFrame, plan: DataFrame, digest_of: list[str]) -> DataFrame:
    """One row per shard staged or planned: rows, batches and the verdict over all its files and batches.

    `plan` has shard_path, row_count and digest. A shard is loaded when just the planned rows are there; it is partial while
    there are fewer, changed when there are more or others, missing without any, and unknown without a plan. Rows and
    journal can't disagree, because the journal is what the staged rows say.
    """
    found = staged.groupBy("shard_path").agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"), row_digest(digest_of).alias("found"))
    both = found.join(plan.select("shard_path", "row_count", "digest"), "shard_path", "full")
    verdict = (
        F.when(F.col("row_count").isNull(), "unknown")
        .when(F.col("rows").isNull(), "missing")
        .when(F.col("rows") < F.col("row_count"), "partial")
        .when((F.col("rows") > F.col("row_count")) | (F.col("found") != F.col("digest")), "changed")
        .otherwise("loaded")
    )
    return both.select("shard_path", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("batches", F.lit(0)).alias("batches"), verdict.alias("verdict"))


def loaded_rows(staged: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of the shards that are loaded; other shards are refused as a whole."""
    return staged.join(journal.where("verdict = 'loaded'"), "shard_path", "left_semi")


def append_projection(stream: DataFrame, project: Transform, path: str, checkpoint: str) -> None:
    """Keep a projection in step with its source: every new row is projected once."""
    sink = project(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def write_updates(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Changed keys of a streaming aggregate, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    run_batches(rows, checkpoint, write, mode="update")


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Last written row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch_id").alias("r"))
    return latest.select(key, "r.*")


def running_counts(stream: DataFrame, table: str) -> DataFrame:
    """Loaded rows per table so far; the state holds one number per table."""
    return stream.groupBy(table).agg(F.count("*").alias("loaded"))


def over_plan(counts: DataFrame, plan: DataFrame, table: str) -> DataFrame:
    """Tables holding more rows than planned, or not planned at all."""
    joined = counts.join(plan, table, "left")
    bad = F.col("expected_rows").isNull() | (F.col("loaded") > F.col("expected_rows"))
    return joined.where(bad).select(table, "loaded", "expected_rows")


Fold = Callable[[DataFrame], DataFrame]


def fold_batches(stream: DataFrame, fold: Fold, path: str, checkpoint: str, every: int = 8) -> StreamingQuery:
    """A table of one row per key, kept up by a stream that holds no state.

    `fold` sums rows up to one per key and takes its own results again, in any order and more than once. Each batch is
    folded by itself and written; after every `every` batches all that is written so far is folded into a new base. Ids
    that never come again so cost nothing but their row in the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(_batch_path(f"{path}/batches", batch_id))
        if (batch_id + 1) % every == 0:
            spark = batch.sparkSession
            folded(spark, path, fold, batch_id).write.mode("overwrite").parquet(f"{path}/bases/upto={batch_id}")
            # The base counts from here on.
            spark.range(1).write.mode("overwrite").parquet(f"{path}/done/upto={batch_id}")

    return run_batches(stream, checkpoint, write)


def folded(spark: SparkSession, path: str, fold: Fold, batch_id: int | None = None) -> DataFrame:
    """One row per key from the last base and the batches behind it; up to a batch, or all."""
    batches = spark.read.parquet(f"{path}/batches")
    rows, upto = batches, _last_base(spark, path, batch_id)
    if batch_id is not None:
        rows = rows.where(F.col("batch_id") <= batch_id)
    if upto is not None:
        rows = rows.where(F.col("batch_id") > upto).drop("batch_id").unionByName(spark.read.parquet(f"{path}/bases/upto={upto}"))
    return fold(rows)


def _last_base(spark: SparkSession, path: str, before: int | None) -> int | None:
    """The last base; a batch that comes again does not use its own."""
    try:
        done = spark.read.parquet(f"{path}/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None
    return done.where(F.lit(True) if before is None else F.col("upto") < before).agg(F.max("upto")).first()[0]


def accepted_suppressions(rows: DataFrame, ready: bool) -> DataFrame:
    """Suppressions that count: active, and only for a ready snapshot."""
    return rows.where((F.col("active") == 1) & F.lit(ready))


def first_of(key: str, order: list[str], columns: list[str]) -> Fold:
    """The first row per key by `order`; `columns` hold the order."""
    return lambda rows: rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first")).select(key, "first.*")


def last_of(key: str, seq: str, columns: list[str]) -> Fold:
    """The last row per key by `seq`."""
    return lambda rows: rows.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*columns), seq).alias("state")).select(key, seq, "state.*")
