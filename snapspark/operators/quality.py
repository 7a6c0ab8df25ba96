"""Ingest rules: reason codes per row, duplicates, observations and conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from .relations import union_all


def drop_reasons() -> Column:
    c = F.col
    dates = [(f"invalid_{n}", ~R.nonempty(c(n))) for n in ("start_date", "end_date", "created_at")]
    return R.reasons(
        ("invalid_drop_id", ~R.safe_integer(c("drop_id"), 1)),
        ("invalid_fancy_id", c("fancy_id").isNull()),
        ("invalid_title", c("title").isNull()),
        *dates,
        ("invalid_year", ~R.safe_integer(c("year"))),
        ("invalid_is_virtual", c("is_virtual").isNotNull() & ~c("is_virtual").isin(0, 1)),
        ("invalid_is_private", ~F.coalesce(c("is_private").isin(0, 1), F.lit(False))),
    )


def token_reasons() -> Column:
    c = F.col
    return R.reasons(
        ("invalid_source_uid", ~R.nonempty(c("source_uid"))),
        ("invalid_token_id", ~R.safe_integer(c("token_id"), 1)),
        ("invalid_drop_id", ~R.safe_integer(c("drop_id"), 1)),
        ("invalid_minted_on", ~R.safe_integer(c("minted_on"), 0)),
        ("invalid_owner_address", R.address(c("owner_address")).isNull()),
        ("invalid_network", ~R.nonempty(c("network"))),
        ("invalid_transfer_count", ~R.safe_integer(c("transfer_count"), 0)),
    )


def email_reasons() -> Column:
    names = ["email_reservations_total", "email_reservations_minted", "email_reservations_unminted"]
    shape = [("invalid_drop_id", ~R.safe_integer(F.col("drop_id"), 1))]
    shape += [(f"invalid_{n}", ~R.safe_integer(F.col(n), 0)) for n in names]
    found = R.reasons(*shape)
    total = F.col(names[0]) != F.col(names[1]) + F.col(names[2])
    return F.when((F.size(found) == 0) & total, F.array(F.lit("reservation_total_mismatch"))).otherwise(found)


def owner_reasons() -> Column:
    c = F.col
    found = R.reasons(
        ("invalid_owner_address_norm", ~F.coalesce(c("owner_address_norm").rlike("^0x[0-9a-f]{40}$"), F.lit(False))),
        ("invalid_token_count", ~R.safe_integer(c("token_count"), 1)),
        ("invalid_unique_drop_count", ~R.safe_integer(c("unique_drop_count"), 1)),
        ("invalid_first_minted_on", ~R.safe_integer(c("first_minted_on"), 0)),
        ("invalid_last_minted_on", ~R.safe_integer(c("last_minted_on"), 0)),
    )
    reversed_range = c("last_minted_on") < c("first_minted_on")
    return F.when((F.size(found) == 0) & reversed_range, F.array(F.lit("reversed_minted_range"))).otherwise(found)


def judge_drops(raw: DataFrame) -> DataFrame:
    """Reason codes of every drop row, with `duplicate_fancy_id` for rows after the first accepted one.

    Rejected rows never claim a name, so the claimant is the smallest otherwise valid id per name; that is a
    map-side combined aggregate, not an ordered walk over one name's rows.
    """
    judged = raw.withColumn("reasons", drop_reasons())
    owner = judged.where(F.size("reasons") == 0).groupBy("fancy_id").agg(F.min("drop_id").alias("_first"))
    joined = judged.join(owner, "fancy_id", "left")
    late = F.coalesce(F.col("drop_id") > F.col("_first"), F.lit(False))
    codes = F.when(late, F.array_append("reasons", F.lit("duplicate_fancy_id"))).otherwise(F.col("reasons"))
    return joined.select(*raw.columns, codes.alias("reasons"))


def judge_tokens(raw: DataFrame) -> DataFrame:
    return raw.withColumn("owner_address_norm", R.address(F.col("owner_address"))).withColumn("reasons", token_reasons())


def judge_email_stats(raw: DataFrame, accepted_drops: DataFrame) -> DataFrame:
    """Row rules first; a valid row whose drop was not accepted is an orphan."""
    judged = raw.withColumn("reasons", email_reasons())
    known = accepted_drops.select("drop_id").distinct().withColumn("_known", F.lit(1))
    joined = judged.join(known, "drop_id", "left")
    orphan = (F.size("reasons") == 0) & F.col("_known").isNull()
    codes = F.when(orphan, F.array(F.lit("orphan_drop_reference"))).otherwise(F.col("reasons"))
    return joined.select(*raw.columns, codes.alias("reasons"))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("reasons") == 0).drop("reasons")


def rejected(judged: DataFrame, key: str) -> DataFrame:
    """Quarantine rows: primary key, reasons, and the whole record as JSON."""
    record = F.to_json(F.struct(*[c for c in judged.columns if c != "reasons"]), {"ignoreNullFields": "false"})
    return judged.where(F.size("reasons") > 0).select(F.col(key).cast("string").alias("primary_key"), "reasons", record.alias("record"))


def drop_observations(drops: DataFrame) -> DataFrame:
    """Counters over accepted drops, in one pass."""
    start, end, created = [F.try_to_timestamp(F.col(c)) for c in ("start_date", "end_date", "created_at")]
    invalid = start.isNull() | end.isNull() | created.isNull()
    scheme = F.lower(F.try_parse_url("event_url", F.lit("PROTOCOL")))
    unsafe = R.nonempty(F.col("event_url")) & ~F.coalesce(scheme.isin("http", "https"), F.lit(False))
    return drops.agg(
        F.count_if(F.length("fancy_id") == 0).alias("empty_fancy_ids"),
        F.count_if(F.length("title") == 0).alias("empty_titles"),
        F.count_if(invalid).alias("invalid_dates"),
        F.count_if(~invalid & (end < start)).alias("reversed_date_ranges"),
        F.count_if(~invalid & (F.year(start) != F.col("year"))).alias("start_year_mismatches"),
        F.count_if(unsafe).alias("unsafe_event_urls"),
        F.count_if(F.col("is_private") == 1).alias("private_drops"),
        F.count_if(F.col("is_virtual").isNull()).alias("unknown_virtuality"),
    )


def token_observations(judged: DataFrame, accepted_drops: DataFrame) -> DataFrame:
    """Address changes and null mints over all rows; orphan drops only over accepted rows, which are kept."""
    known = accepted_drops.select("drop_id").distinct().withColumn("_known", F.lit(1))
    per_drop = judged.groupBy("drop_id").agg(
        F.count_if(F.col("owner_address_norm") != F.col("owner_address")).alias("changed"),
        F.count_if(F.col("minted_on").isNull()).alias("null_mints"),
        F.count_if(F.size("reasons") == 0).alias("ok"),
    )
    joined = per_drop.join(known, "drop_id", "left")
    return joined.agg(
        F.sum("changed").alias("normalized_addresses_changed"),
        F.sum("null_mints").alias("null_minted_on"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("ok"))), F.lit(0)).alias("orphan_drop_references"),
    )


def compare_metadata(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, value) claims against measured (key, actual) counts; a claim that is absent or not a number differs."""
    joined = counts.join(claims, "key", "left")
    same = F.expr("try_cast(value as bigint)") == F.col("actual")
    return joined.where(~F.coalesce(same, F.lit(False))).select("key", F.col("value").alias("expected"), "actual")


def conclusions(counters: DataFrame, blocking: tuple[str, ...], warning: tuple[str, ...]) -> DataFrame:
    """(counter, n) rows above zero with the level their name carries."""
    level = F.when(F.col("counter").isin(*blocking), "blocking").when(F.col("counter").isin(*warning), "warning")
    return counters.where("n > 0").withColumn("level", level).where("level is not null").select("level", "counter", "n")


def artwork_flags(drops: DataFrame, files: DataFrame) -> DataFrame:
    """Accepted drops with their artwork flag: a file that is neither duplicated nor unreadable."""
    usable = files.groupBy("drop_id").agg(F.bool_and(F.col("state") == "ok").alias("_ok"))
    joined = drops.select("drop_id").join(usable, "drop_id", "left")
    return joined.select("drop_id", R.flag(F.col("_ok")).alias("has_artwork"))


def artwork_counts(drops: DataFrame, files: DataFrame) -> DataFrame:
    flags = artwork_flags(drops, files)
    orphans = files.join(drops.select("drop_id"), "drop_id", "left_anti")
    return union_all(
        flags.agg(F.count_if(F.col("has_artwork") == 1).alias("n")).select(F.lit("accepted_artworks").alias("counter"), "n"),
        flags.agg(F.count_if(F.col("has_artwork") == 0).alias("n")).select(F.lit("missing_for_drops").alias("counter"), "n"),
        orphans.agg(F.count("*").alias("n")).select(F.lit("orphan_artwork").alias("counter"), "n"),
    )


def capture_reasons() -> Column:
    c = F.col
    owner = F.lower(F.coalesce(c("collector_address"), F.lit("")))
    return R.reasons(
        ("invalid_id", ~R.safe_integer(c("id"), 1)),
        ("invalid_owner", ~owner.rlike("^0x[0-9a-f]{40}$")),
        ("invalid_drop_id", c("drop_id").isNotNull() & ~R.safe_integer(c("drop_id"), 1)),
        ("invalid_minted_on", c("minted_on").isNotNull() & ~R.safe_integer(c("minted_on"), 0)),
        ("invalid_transfer_count", ~R.safe_integer(c("transfer_count"), 0)),
        ("invalid_chain", ~R.nonempty(c("chain"))),
        ("outside_shard", (c("id") <= c("lower_exclusive")) | (c("id") > c("upper_inclusive"))),
    )


def judge_capture(rows: DataFrame) -> DataFrame:
    """Captured rows with reason codes; every row of an identity that occurs twice is marked as repeated."""
    judged = rows.withColumn("reasons", capture_reasons())
    repeated = rows.groupBy("id", "chain").agg(F.count("*").alias("_n")).where("_n > 1")
    joined = judged.join(repeated, ["id", "chain"], "left")
    codes = F.when(F.col("_n").isNotNull(), F.array_append("reasons", F.lit("repeated_identity"))).otherwise(F.col("reasons"))
    return joined.select(*rows.columns, codes.alias("reasons"))


def invalid_counters(tokens: DataFrame) -> DataFrame:
    c = F.col
    owner = c("owner_address")
    return tokens.agg(
        F.count("*").alias("tokens"),
        F.count_if(c("drop_id").isNull() | (c("drop_id") <= 0)).alias("invalid_drop_ids"),
        F.count_if(c("minted_on").isNull() | (c("minted_on") < 0)).alias("invalid_minted_on"),
        F.count_if(~R.nonempty(c("network"))).alias("invalid_networks"),
        F.count_if(c("transfer_count").isNull() | (c("transfer_count") < 0)).alias("invalid_transfers"),
        F.count_if(~owner.rlike("^0x[0-9a-f]{40}$")).alias("invalid_owners"),
    )


def judge_capture_order(rows: DataFrame, shard: str, seq: str) -> DataFrame:
    """Rows of a sharded capture that break its order: an identity (id, chain) not above the one before it in the shard, an id
    at or below the shard's lower bound, or above its upper one. `seq` counts a shard's rows without gaps; a shard of any
    size is judged in blocks."""
    here, before = F.struct("id", "chain"), F.struct(F.col("prev_id").alias("id"), F.col("prev_chain").alias("chain"))
    rules = R.reasons(
        ("order_invalid", F.col("prev_id").isNotNull() & (here <= before)),
        ("lower_crossed", F.col("id") <= F.col("lower_exclusive")),
        ("upper_crossed", F.col("id") > F.col("upper_inclusive")),
    )
    chained = O.with_previous(rows, shard, seq, ["id", "chain"])
    return chained.withColumn("reasons", rules).where(F.size("reasons") > 0).drop("prev_id", "prev_chain")
