"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the digests, one per task, are merged into at most `k` candidates. No digest with more than
N / (k + 1) rows can be missing. Their exact counts and winners are computed, the verified ones are broadcast (at most
`k` rows of about 60 bytes), and rows that lose against a broadcast winner need no shuffle. All other digests are
shuffled; each has at most N / (k + 1) rows, and `k` is at least four times the number of shuffle partitions, so that no
such group outweighs a quarter of an even task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, text_or_empty

LEAST_COUNTERS = 1024


def counters(df: DataFrame, least: int = LEAST_COUNTERS) -> int:
    return max(least, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def misra_gries(k: int):
    """A task that sums up a column `digest` by at most `k` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in Counter(batch.column(0).to_pylist()).items():
                kept[digest] = kept.get(digest, 0) + n
            if len(kept) > k:
                # Merging sums and taking off the (k + 1)th largest counter keeps the bound of the summary.
                cut = sorted(kept.values(), reverse=True)[k]
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], names=["digest", "n"]
            )

    return run


def candidates(digests: DataFrame, k: int) -> DataFrame:
    """At most `k` digests, among them every one with more than N / (k + 1) rows."""
    parts = digests.select("digest").mapInArrow(misra_gries(k), "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def winners(digests: DataFrame, k: int, *aggregates: Column) -> DataFrame:
    """Exact aggregates of the candidates that occur more than once; at most `k` rows."""
    exact = digests.join(F.broadcast(candidates(digests, k)), "digest").groupBy("digest").agg(*aggregates, F.count("*").alias("group_size"))
    return stored(exact.where("group_size > 1"), "winners")


def mark(docs: DataFrame, k: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are equal; null counts as empty. Of equal texts the row with the largest
    doc_id stays (null is the smallest); of rows that share text and doc_id just one has `kept`. Other columns are not
    read. An empty table gives no rows.
    """
    k = k or counters(docs)
    digests = stored(
        docs.select("doc_id", text_digest(text_or_empty(docs)).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    best = F.max(F.struct("doc_id", "row")).alias("best")
    heavy = winners(digests, k, best)
    frequent = digests.join(F.broadcast(heavy), "digest").select("doc_id", "row", "digest", "best", "group_size")
    group = Window.partitionBy("digest")
    others = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id", "row", "digest", F.max(F.struct("doc_id", "row")).over(group).alias("best"), F.count("*").over(group).alias("group_size")
    )
    return frequent.unionByName(others).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, all columns: of equal texts one row with the largest doc_id.

    Rows below the broadcast winner of a frequent digest go before any shuffle. What is left is dealt by digest; the
    limit of one row per digest also holds inside each task before the shuffle, so repeated rows cannot pile up.
    """
    k = k or counters(docs)
    digest, top, rank = (fresh(docs, name) for name in ("digest", "top_id", "rank"))
    text = text_digest(text_or_empty(docs))
    heavy = winners(docs.select("doc_id", text.alias("digest")), k, F.max("doc_id").alias(top)).select(F.col("digest").alias(digest), top)
    left = (
        docs.withColumn(digest, text)
        .join(F.broadcast(heavy), digest, "left")
        .where(F.col(top).isNull() | (F.col("doc_id") >= F.col(top)))
    )
    order = Window.partitionBy(digest).orderBy(F.desc("doc_id"))
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[left[f"`{c}`"] for c in docs.columns])
