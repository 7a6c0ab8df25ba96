"""Grouped counts and projections; every one combines on the map side before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from .relations import union_all


def owner_stats(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("owner_address_norm").agg(
        F.count("*").alias("token_count"),
        F.count_distinct("drop_id").alias("unique_drop_count"),
        F.min("minted_on").alias("first_minted_on"),
        F.max("minted_on").alias("last_minted_on"),
    )


def tokens_per_drop(drops: DataFrame, tokens: DataFrame) -> DataFrame:
    counts = tokens.groupBy("drop_id").agg(F.count("*").alias("token_count"))
    return drops.select("drop_id").join(counts, "drop_id", "left").withColumn("token_count", F.coalesce("token_count", F.lit(0)))


def safe_total(col: str) -> Column:
    """Sum that is flagged instead of trusted once it leaves the exactly representable range."""
    return F.sum(F.col(col).cast("decimal(38,0)"))


def drop_totals(tokens: DataFrame) -> DataFrame:
    rows = tokens.groupBy("drop_id").agg(F.count("*").alias("token_count"), safe_total("transfer_count").alias("_sum"))
    unsafe = F.abs("_sum") > R.MAX_SAFE_INTEGER
    return rows.select("drop_id", "token_count", F.when(~unsafe, F.col("_sum").cast("bigint")).alias("transfer_count"),
                       R.flag(unsafe).alias("unsafe"))


def chain_key(chain: Column) -> Column:
    return F.when(chain.isNull(), "n:").otherwise(F.concat(F.lit("s:"), chain))


def chain_projection(drops: DataFrame, chains: DataFrame) -> DataFrame:
    """Token and transfer totals of every asked drop over its chains, 0 without any."""
    sums = chains.groupBy("drop_id").agg(
        safe_total("token_count").alias("tokens"), safe_total("transfer_count").alias("transfers"), F.count("*").alias("chains"))
    joined = drops.select("drop_id").distinct().join(sums, "drop_id", "left")
    unsafe = (F.col("tokens") > R.MAX_SAFE_INTEGER) | (F.col("transfers") > R.MAX_SAFE_INTEGER)
    return joined.select(
        "drop_id",
        F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("token_count"),
        F.coalesce(F.col("transfers").cast("bigint"), F.lit(0)).alias("transfer_count"),
        F.coalesce("chains", F.lit(0)).alias("chains"),
        R.flag(unsafe).alias("unsafe"),
    )


def single_relation_audit(rows: DataFrame, drops: DataFrame, label: str) -> DataFrame:
    """Rows of a one-per-drop relation that name an unknown drop or repeat one."""
    counts = rows.groupBy("drop_id").agg(F.count("*").alias("n"))
    known = drops.select("drop_id").distinct().withColumn("_known", F.lit(1))
    checked = counts.join(known, "drop_id", "left")
    rule = F.when(F.col("_known").isNull(), "unknown_drop").when(F.col("n") > 1, "repeated_drop")
    return checked.withColumn("rule", rule).where("rule is not null").select(
        "rule", F.lit(label).alias("entity"), F.col("drop_id").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def counts_per_collection(collections: DataFrame, items: DataFrame, sections: DataFrame) -> DataFrame:
    """Item and section counts from one shuffle over the stacked children."""
    children = union_all(
        items.select("collection_id", F.lit(1).alias("i"), F.lit(0).alias("s")),
        sections.select("collection_id", F.lit(0).alias("i"), F.lit(1).alias("s")),
    )
    counts = children.groupBy("collection_id").agg(F.sum("i").alias("item_count"), F.sum("s").alias("section_count"))
    joined = collections.select("collection_id").join(counts, "collection_id", "left")
    return joined.select("collection_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("item_count", "section_count")])


def media_counts(media: DataFrame, is_public: Column) -> DataFrame:
    return media.where("moment_id is not null").groupBy("moment_id").agg(
        F.count("*").alias("source_media_count"), F.count_if(is_public).alias("media_count"))


def preservation_state(source: Column, stored: Column) -> Column:
    return F.when(source == 0, "none").when(stored == 0, "pending").when(stored < source, "partial").otherwise("complete")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Duplicated values of a key and the rows beyond the first of each."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def identity_counts(rows: DataFrame, columns: list[str], nullable: str) -> DataFrame:
    """Rows, distinct identities and rows whose identity has a NULL part, from one grouped pass."""
    groups = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("identities"),
        F.coalesce(F.sum(F.when(F.col(nullable).isNull(), F.col("n"))), F.lit(0)).alias("null_rows"),
    )


def zero_filled(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Histogram that lists every known status, also those without rows."""
    dim = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias(column))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return dim.join(counts, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def holdings_by_month(tokens: DataFrame, owner: str) -> DataFrame:
    """Per owner and UTC mint month with the month's place: newest first, unknown last. The session zone must be UTC."""
    month = F.date_format(F.timestamp_seconds("minted_on"), "yyyy-MM")
    counts = tokens.groupBy(owner, F.coalesce(month, F.lit("unknown")).alias("month")).agg(F.count("*").alias("n"))
    # Only an owner's months reach this window, not their tokens.
    order = W.partitionBy(owner).orderBy(F.col("month") == "unknown", F.col("month").desc())
    return counts.withColumn("place", F.row_number().over(order))


def url_coverage(references: DataFrame, parts: int | None = None) -> DataFrame:
    """(owner, url, bytes) references -> distinct urls, known bytes and urls of unknown length per owner."""
    known = F.max(F.when(F.col("bytes") > 0, F.col("bytes")))
    per_url = O.dealt(references.where(R.nonempty(F.col("url"))), parts, "owner", "url").groupBy("owner", "url").agg(known.alias("bytes"))
    return per_url.groupBy("owner").agg(
        F.count("*").alias("reference_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("known_bytes"),
        F.count_if(F.col("bytes").isNull()).alias("unknown_length"),
    )
