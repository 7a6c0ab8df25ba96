"""A, S-10: ingest rules and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordering as O
from ..operators import aggregates as G
from ..operators import quality as Q
from ..operators import relations as J
from ..sources.layout import id_shard
from .registry import query

DROP_VERDICT = """
  select *, concat_ws(',', case when drop_id < 1 then 'invalid_drop_id' end, case when title is null then 'invalid_title' end,
    case when start_date = '' then 'invalid_start_date' end, case when is_virtual not in (0, 1) then 'invalid_is_virtual' end) as codes
  from $raw_drops"""
DROP_JUDGED = """
  select v.*, concat_ws(',', nullif(codes, ''), case when v.drop_id > f.first_id then 'duplicate_fancy_id' end) as reasons from $drop_verdict v
  left join (select fancy_id, min(drop_id) as first_id from $drop_verdict where codes = '' group by fancy_id) f on f.fancy_id = v.fancy_id"""
TOKEN_JUDGED = """
  select *, concat_ws(',', case when minted_on is null or minted_on < 0 then 'invalid_minted_on' end,
    case when not regexp_matches(owner_address, '^0x[0-9a-fA-F]{40}$') then 'invalid_owner_address' end) as reasons from $raw_tokens"""
EMAIL_JUDGED = """
  select e.*, case when email_reservations_total <> email_reservations_minted + email_reservations_unminted then 'reservation_total_mismatch'
    when d.drop_id is null then 'orphan_drop_reference' else '' end as reasons
  from $raw_email_stats e left join (select distinct drop_id from $drop_judged where reasons = '') d on d.drop_id = e.drop_id"""
SQL = {"drop_verdict": DROP_VERDICT, "drop_judged": DROP_JUDGED, "token_judged": TOKEN_JUDGED, "email_judged": EMAIL_JUDGED}


def codes(df, *cols):
    return df.select(*cols, F.array_join("reasons", ",").alias("reasons"))


def accepted_drops(a):
    return Q.accepted(Q.judge_drops(a.raw_drops))


@query("a01_drop_reasons", "select drop_id, fancy_id, codes as reasons from $drop_verdict", SQL)
def _(a):
    return codes(a.raw_drops.withColumn("reasons", Q.drop_reasons()), "drop_id", "fancy_id")


@query("a02_token_reasons", "select source_uid, reasons from $token_judged", SQL)
def _(a):
    return codes(Q.judge_tokens(a.raw_tokens), "source_uid")


@query("a03_email_stats_reasons", "select drop_id, reasons from $email_judged", SQL)
def _(a):
    return codes(Q.judge_email_stats(a.raw_email_stats, accepted_drops(a)), "drop_id")


@query("a04_owner_stats_reasons", """
  select owner_address_norm, concat_ws(',', case when tc < 1 then 'invalid_token_count' end,
    case when tc >= 1 and last_minted_on < fm then 'reversed_minted_range' end) as reasons
  from (select *, case when unique_drop_count % 17 = 0 then 0 else token_count end as tc,
    case when unique_drop_count % 13 = 0 then last_minted_on + 1 else first_minted_on end as fm from $owner_stats) x""")
def _(a):
    s = a.owner_stats
    dirty = s.withColumn("token_count", F.when(F.col("unique_drop_count") % 17 == 0, 0).otherwise(F.col("token_count"))).withColumn(
        "first_minted_on", F.when(F.col("unique_drop_count") % 13 == 0, F.col("last_minted_on") + 1).otherwise(F.col("first_minted_on")))
    return codes(dirty.withColumn("reasons", Q.owner_reasons()), "owner_address_norm")


@query("a05_duplicate_fancy_ids", "select drop_id, fancy_id, reasons from $drop_judged", SQL)
def _(a):
    return codes(Q.judge_drops(a.raw_drops), "drop_id", "fancy_id")


@query("a06_drop_observations", """
  select count(*) filter (where fancy_id = '') as empty_fancy_ids, count(*) filter (where title = '') as empty_titles,
    count(*) filter (where s is null or e is null or c is null) as invalid_dates,
    count(*) filter (where s is not null and e is not null and c is not null and e < s) as reversed_date_ranges,
    count(*) filter (where s is not null and e is not null and c is not null and year(s) <> year) as start_year_mismatches,
    count(*) filter (where event_url <> '' and not regexp_matches(event_url, '^(?i)https?:')) as unsafe_event_urls,
    count(*) filter (where is_private = 1) as private_drops, count(*) filter (where is_virtual is null) as unknown_virtuality
  from (select *, try_cast(start_date as timestamp) as s, try_cast(end_date as timestamp) as e, try_cast(created_at as timestamp) as c
    from $drop_judged where reasons = '') x""", SQL)
def _(a):
    return Q.drop_observations(accepted_drops(a))


TOKEN_OBS = """
  select count(*) filter (where regexp_matches(owner_address, '^0x[0-9a-fA-F]{40}$') and owner_address <> lower(owner_address)) as normalized_addresses_changed,
    count(*) filter (where minted_on is null) as null_minted_on,
    count(*) filter (where reasons = '' and drop_id not in (select drop_id from $drop_judged where reasons = '')) as orphan_drop_references
  from $token_judged"""


@query("a07_token_observations", TOKEN_OBS, SQL)
def _(a):
    return Q.token_observations(Q.judge_tokens(a.raw_tokens), accepted_drops(a))


def _count(df, key, cond=None):
    return df.agg(F.count(F.when(cond, 1) if cond is not None else F.lit(1)).alias("n")).select(F.lit(key).alias("counter"), "n")


BLOCKING = ("rejected_drops", "rejected_tokens", "rejected_email_stats", "duplicate_uids", "metadata_mismatches")
WARNING = ("empty_fancy_ids", "duplicate_token_ids")


@query("a08_metadata_claims", """
  select key, value as expected, actual from (
    select 'drops_count' as key, (select count(*)::varchar from $raw_drops) as value, (select count(*) from $raw_drops) as actual
    union all select 'tokens_count', (select (count(*) + 1)::varchar from $raw_tokens), (select count(*) from $raw_tokens)
    union all select 'email_reservation_stats_count', null, (select count(*) from $raw_email_stats)) x
  where try_cast(value as bigint) is null or try_cast(value as bigint) <> actual""")
def _(a):
    return metadata_mismatches(a)


def metadata_mismatches(a):
    def measured(df, key):
        return df.agg(F.count("*").alias("actual")).select(F.lit(key).alias("key"), "actual")

    counts = J.union_all(measured(a.raw_drops, "drops_count"), measured(a.raw_tokens, "tokens_count"),
                         measured(a.raw_email_stats, "email_reservation_stats_count"))
    # The archive's own claims: right for drops, one too many for tokens, absent for email stats.
    claims = counts.where("key <> 'email_reservation_stats_count'").select(
        "key", (F.col("actual") + F.when(F.col("key") == "tokens_count", 1).otherwise(0)).cast("string").alias("value"))
    return Q.compare_metadata(claims, counts)


@query("a08_quality_conclusions", """
  select * from (
    select 'blocking' as level, 'rejected_drops' as counter, count(*) as n from $drop_judged where reasons <> ''
    union all select 'blocking', 'rejected_tokens', count(*) from $token_judged where reasons <> ''
    union all select 'blocking', 'rejected_email_stats', count(*) from $email_judged where reasons <> ''
    union all select 'blocking', 'duplicate_uids', count(*) from (select source_uid from $raw_tokens group by source_uid having count(*) > 1) x
    union all select 'blocking', 'metadata_mismatches', 2
    union all select 'warning', 'empty_fancy_ids', count(*) from $drop_judged where reasons = '' and fancy_id = ''
    union all select 'warning', 'duplicate_token_ids', count(*) from (select token_id from $raw_tokens group by token_id having count(*) > 1) x) c where n > 0""", SQL)
def _(a):
    drops, tokens = Q.judge_drops(a.raw_drops), Q.judge_tokens(a.raw_tokens)
    bad = F.size("reasons") > 0
    counters = J.union_all(
        _count(drops, "rejected_drops", bad),
        _count(tokens, "rejected_tokens", bad),
        _count(Q.judge_email_stats(a.raw_email_stats, Q.accepted(drops)), "rejected_email_stats", bad),
        G.duplicate_keys(a.raw_tokens, "source_uid").select(F.lit("duplicate_uids").alias("counter"), F.col("duplicated").alias("n")),
        _count(metadata_mismatches(a), "metadata_mismatches"),
        _count(drops, "empty_fancy_ids", ~bad & (F.col("fancy_id") == "")),
        G.duplicate_keys(a.raw_tokens, "token_id").select(F.lit("duplicate_token_ids").alias("counter"), F.col("duplicated").alias("n")),
    )
    return Q.conclusions(counters, BLOCKING, WARNING)


@query("a10_artwork_flags", """
  select d.drop_id, case when f.state = 'ok' then 1 else 0 end as has_artwork from (select drop_id from $drop_judged where reasons = '') d
  left join $artwork_files f on f.drop_id = d.drop_id""", SQL)
def _(a):
    return Q.artwork_flags(accepted_drops(a), a.artwork_files)


@query("a10_artwork_counts", """
  select 'accepted_artworks' as counter, count(*) as n from (select drop_id from $drop_judged where reasons = '') d join $artwork_files f on f.drop_id = d.drop_id and state = 'ok'
  union all select 'missing_for_drops', count(*) from (select drop_id from $drop_judged where reasons = '') d where drop_id not in (select drop_id from $artwork_files where state = 'ok')
  union all select 'orphan_artwork', count(*) from $artwork_files where drop_id not in (select drop_id from $drop_judged where reasons = '')""", SQL)
def _(a):
    return Q.artwork_counts(accepted_drops(a), a.artwork_files)


CAPTURE = """
  select l_orderkey + 1 as id, case when l_linenumber = 7 then null else l_partkey + 1 end as drop_id, case when l_partkey % 40 = 0 then -1 else 1000 end as minted_on,
    case when l_suppkey % 50 = 3 then 'bad' else '0x' || repeat('a', 40) end as collector_address,
    case when l_suppkey % 60 = 5 then '' else l_returnflag || cast(l_linenumber as varchar) end as chain, cast(l_quantity as bigint) as transfer_count,
    0 as lower_exclusive, 900000000 as upper_inclusive from $lineitem"""


def capture_rows(a):
    c = F.col
    return a.lineitem.select(
        (c("l_orderkey") + 1).alias("id"),
        F.when(c("l_linenumber") != 7, c("l_partkey") + 1).alias("drop_id"),
        F.when(c("l_partkey") % 40 == 0, -1).otherwise(1000).alias("minted_on"),
        F.when(c("l_suppkey") % 50 == 3, "bad").otherwise(F.concat(F.lit("0x"), F.repeat(F.lit("a"), 40))).alias("collector_address"),
        F.when(c("l_suppkey") % 60 == 5, "").otherwise(F.concat("l_returnflag", c("l_linenumber").cast("string"))).alias("chain"),
        c("l_quantity").cast("bigint").alias("transfer_count"),
        F.lit(0).alias("lower_exclusive"), F.lit(900000000).alias("upper_inclusive"))


@query("a11_capture_row_rules", """
  select reasons, count(*) as n, sum(id)::bigint as id_sum from (
    select c.id, concat_ws(',', case when collector_address = 'bad' then 'invalid_owner' end, case when minted_on < 0 then 'invalid_minted_on' end,
      case when c.chain = '' then 'invalid_chain' end, case when r.id is not null then 'repeated_identity' end) as reasons
    from $capture_rows c left join (select id, chain from $capture_rows group by 1, 2 having count(*) > 1) r on r.id = c.id and r.chain = c.chain) x
  group by reasons""", {"capture_rows": CAPTURE})
def _(a):
    judged = codes(Q.judge_capture(capture_rows(a)), "id")
    return judged.groupBy("reasons").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


# Captured identities in five shards of real bounds; in each shard some rows have slipped below it, and some above.
SHARDED = """
  select shard, (u * shard) // 5 as lower_exclusive, (u * (shard + 1)) // 5 as upper_inclusive, place, chain,
    case when place % 500 = 123 then id - 1000000000 when place % 700 = 99 then id + 1000000000 else id end as id
  from (select *, row_number() over (partition by shard order by id, chain) - 1 as place from (
    select id, chain, u, (select min(i) from range(0, 5) r(i) where id <= (u * (i + 1)) // 5) as shard from (
      select l_orderkey + 1 as id, l_returnflag || cast(l_linenumber as varchar) as chain, (select max(l_orderkey) + 1 from $lineitem_) as u from $lineitem_) x) y) z"""


@query("a11_capture_order", """
  select shard, place, id, reasons from (
    select shard, place, id, concat_ws(',', case when lag(id) over w is not null and (id, chain) <= (lag(id) over w, lag(chain) over w) then 'order_invalid' end,
      case when id <= lower_exclusive then 'lower_crossed' end, case when id > upper_inclusive then 'upper_crossed' end) as reasons
    from $sharded window w as (partition by shard order by place)) x where reasons <> ''""", {"lineitem_": "select l_orderkey, l_returnflag, l_linenumber from lineitem", "sharded": SHARDED})
def _(a):
    c = F.col
    rows = a.lineitem.select((c("l_orderkey") + 1).alias("id"), F.concat("l_returnflag", c("l_linenumber").cast("string")).alias("chain"))
    top = a.lineitem.agg(F.max(c("l_orderkey") + 1)).scalar()
    sharded = rows.withColumn("shard", id_shard(c("id"), top, 5))
    placed = O.positions(sharded, "shard", ["id", "chain"], "place")
    slipped = F.when(c("place") % 500 == 123, c("id") - 1_000_000_000).when(c("place") % 700 == 99, c("id") + 1_000_000_000).otherwise(c("id"))
    bound = lambda i: F.floor(i.cast("decimal(38,0)") * top / 5)
    bounded = placed.withColumn("id", slipped).withColumn("lower_exclusive", bound(c("shard"))).withColumn("upper_inclusive", bound(c("shard") + 1))
    return codes(Q.judge_capture_order(bounded, "shard", "place"), "shard", "place", "id")


@query("a12_invalid_counters", """
  select count(*) as tokens, count(*) filter (where drop_id <= 0) as invalid_drop_ids, count(*) filter (where minted_on is null or minted_on < 0) as invalid_minted_on,
    count(*) filter (where network = '') as invalid_networks, count(*) filter (where transfer_count < 0) as invalid_transfers,
    count(*) filter (where not regexp_matches(owner_address, '^0x[0-9a-f]{40}$')) as invalid_owners from $raw_tokens""")
def _(a):
    return Q.invalid_counters(a.raw_tokens)
