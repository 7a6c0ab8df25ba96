"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "snapspark") -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


TASK_ROWS = 500_000  # rows of a stored table that one task should meet


def parts_for(*tables: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions for work that grows with stored tables: the session's number, or as many more as keep a task's share of the
    rows at `rows`, so that the memory of a task does not grow with the tables. Counts come from the files' footers."""
    conf = tables[0].sparkSession.conf
    return max(int(conf.get("spark.sql.shuffle.partitions")), -(-sum(t.count() for t in tables) // rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a new local one in local mode."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="snapspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's written table, so that runs never overwrite each other."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: what later steps see holds, and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`df` as a table of the session in the shared folder, dealt into buckets of `keys` once: later joins and groups on
    these keys need no exchange of it. The table has a name of its own and is for one run. `made` is a step on the dealt
    rows that keeps them by `keys`, such as a DISTINCT, which then needs no exchange of its own."""
    spark, buckets = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    writer = (made(rows) if made else rows).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def kept_partitions(df: DataFrame, name: str, partition: str, parts: int) -> DataFrame:
    """`df`, whose column `partition` has the number of its partition below `parts`, as a table that keeps partitions: each
    is a bucket of `_bucket`, read whole by one task where a group or window has `_bucket` among its keys. Nothing is dealt."""
    spark, key = df.sparkSession, F.col("id").cast("int")
    # Buckets go by a hash: for each one the least number that falls into it.
    found = spark.range(30 * parts).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("bucket")).agg(F.min(key).alias("key"))
    keys = {r.bucket: r.key for r in found.collect()}
    bucket = F.element_at(F.array(*[F.lit(keys.get(i, i)) for i in range(parts)]), F.col(partition) + 1)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.withColumn("_bucket", bucket).write.option("compression", "zstd").bucketBy(parts, "_bucket")
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)
