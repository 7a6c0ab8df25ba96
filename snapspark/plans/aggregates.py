"""G: grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import MOMENTS_SNAPSHOT
from ..functions import rules as R
from ..operators import aggregates as G
from ..operators import relations as J
from .registry import query
from .sqltext import PUBLIC_MEDIA, STATUS_SQL


@query("g01_owner_stats", """
  select owner_address_norm, count(*) as token_count, count(distinct drop_id) as unique_drop_count, min(minted_on) as first_minted_on,
    max(minted_on) as last_minted_on from $tokens group by owner_address_norm""")
def _(a):
    return G.owner_stats(a.tokens)


@query("g02_tokens_per_drop", """
  select d.drop_id, count(t.drop_id) as token_count from $drops_base d left join $tokens t on t.drop_id = d.drop_id group by d.drop_id""")
def _(a):
    return G.tokens_per_drop(a.drops_base, a.tokens)


@query("g03_drop_totals", """
  select drop_id, count(*) as token_count, sum(transfer_count)::bigint as transfer_count, 0 as unsafe from $tokens group by drop_id""")
def _(a):
    return G.drop_totals(a.tokens)


@query("g04_network_histogram", "select network, count(*) as n from $tokens group by network")
def _(a):
    return a.tokens.groupBy("network").agg(F.count("*").alias("n")).orderBy("network")


@query("g05_chain_projection", """
  select d.drop_id, coalesce(sum(c.token_count), 0)::bigint as token_count, coalesce(sum(c.transfer_count), 0)::bigint as transfer_count,
    count(c.drop_id) as chains, 0 as unsafe
  from (select drop_id from $drop_cards union select drop_id + 1000000000 from $moment_hidden_drops) d left join $chain_stats c on c.drop_id = d.drop_id group by d.drop_id""")
def _(a):
    asked = J.union_distinct(a.drop_cards.select("drop_id"), a.moment_hidden_drops.select((F.col("drop_id") + 1000000000).alias("drop_id")))
    return G.chain_projection(asked, a.chain_stats)


@query("g05_chain_keys", """
  select drop_id, case when chain is null then 'n:' else 's:' || chain end as chain_key, token_count, transfer_count from $chain_stats""")
def _(a):
    return a.chain_stats.select("drop_id", G.chain_key(F.col("chain")).alias("chain_key"), "token_count", "transfer_count")


@query("g06_single_relation_audit", """
  select case when d.drop_id is null then 'unknown_drop' else 'repeated_drop' end as rule, 'email_claims' as entity, e.drop_id::varchar as key, e.n::varchar as detail
  from (select drop_id, count(*) as n from $email_claims group by drop_id) e left join $drop_cards d on d.drop_id = e.drop_id
  where d.drop_id is null or e.n > 1""")
def _(a):
    return G.single_relation_audit(a.email_claims, a.drop_cards, "email_claims")


@query("g07_collection_counts", """
  select c.collection_id, (select count(*) from $collection_items i where i.collection_id = c.collection_id) as item_count,
    (select count(*) from $collection_sections s where s.collection_id = c.collection_id) as section_count from $collections c""")
def _(a):
    return G.counts_per_collection(a.collections, a.collection_items, a.collection_sections)


def media_counts(a):
    public = R.public_media(MOMENTS_SNAPSHOT, R.media_status(F.col("raw_status")), F.col("object_key"), F.col("archive_sha256"), F.col("archive_content_type"))
    return G.media_counts(a.moment_media, public)


@query("g08_media_counts", f"""
  select moment_id, count(*) as source_media_count, count(*) filter (where {PUBLIC_MEDIA}) as media_count from $moment_media
  where moment_id is not null group by moment_id""")
def _(a):
    return media_counts(a)


@query("g09_preservation_state", f"""
  select m.moment_id, case when n is null then 'none' when p = 0 then 'pending' when p < n then 'partial' else 'complete' end as state from $moments m
  left join (select moment_id, count(*) as n, count(*) filter (where {PUBLIC_MEDIA}) as p from $moment_media group by moment_id) c on c.moment_id = m.moment_id""")
def _(a):
    joined = a.moments.select("moment_id").join(media_counts(a), "moment_id", "left").na.fill(0, ["source_media_count", "media_count"])
    return joined.select("moment_id", G.preservation_state(F.col("source_media_count"), F.col("media_count")).alias("state"))


@query("g12_duplicate_keys", """
  select 'repeated_uid' as key, count(*) as duplicated, coalesce(sum(n - 1), 0)::bigint as surplus from (select count(*) as n from $raw_tokens group by repeated_uid having count(*) > 1) x
  union all select 'token_id', count(*), coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from $raw_tokens group by token_id having count(*) > 1) x
  union all select 'source_uid', count(*), coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from $raw_tokens group by source_uid having count(*) > 1) x""")
def _(a):
    parts = [G.duplicate_keys(a.raw_tokens, k).withColumn("key", F.lit(k)) for k in ("repeated_uid", "token_id", "source_uid")]
    return J.union_all(*parts)


@query("g13_identity_counts", """
  select count(*) as row_count, (select count(*) from (select distinct drop_id, chain from $g13_rows)) as identities,
    count(*) filter (where chain is null) as null_rows from $g13_rows""", {"g13_rows": """
    select l_partkey + 1 as drop_id, case when l_returnflag = 'N' then null else l_returnflag end as chain from $lineitem"""})
def _(a):
    rows = a.lineitem.select((F.col("l_partkey") + 1).alias("drop_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("chain"))
    return G.identity_counts(rows, ["drop_id", "chain"], "chain")


@query("g14_snapshot_meta", """
  select 'drops_count' as key, count(*)::varchar as value from $drops_base union all select 'tokens_count', count(*)::varchar from $tokens
  union all select 'owners_count', count(distinct owner_address_norm)::varchar from $tokens
  union all select 'years', '[' || string_agg(year::varchar, ',' order by year desc) || ']' from (select distinct year from $drops_base where year between 1900 and 2100) y""")
def _(a):
    def row(df, key, value):
        return df.agg(value.cast("string").alias("value")).select(F.lit(key).alias("key"), "value")

    years = a.drops_base.where("year between 1900 and 2100")  # at most 201 distinct values
    listed = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set("year"), False).cast("array<string>"), ","), F.lit("]"))
    return J.union_all(
        row(a.drops_base, "drops_count", F.count("*")),
        row(a.tokens, "tokens_count", F.count("*")),
        row(a.tokens, "owners_count", F.count_distinct("owner_address_norm")),
        row(years, "years", listed),
    )


@query("g15_status_histogram", f"""
  select s.status, count(m.media_key) as n from (values ('pending'), ('public_stored'), ('private_stored'), ('missing'), ('quarantined'), ('failed')) s(status)
  left join (select media_key, {STATUS_SQL} as status from $moment_media) m on m.status = s.status group by s.status""")
def _(a):
    status = R.media_status(F.col("raw_status")).alias("status")
    return G.zero_filled(a.moment_media.select(status).where("status is not null"), "status", R.MEDIA_STATUSES)


@query("g16_holdings_by_month", """
  select *, row_number() over (partition by owner order by month = 'unknown', month desc) as place from (
  select lower(owner_address) as owner, coalesce(strftime(to_timestamp(minted_on) at time zone 'UTC', '%Y-%m'), 'unknown') as month, count(*) as n
  from $raw_tokens where regexp_matches(owner_address, '^0x[0-9a-fA-F]{40}$') group by 1, 2) m""")
def _(a):
    rows = a.raw_tokens.withColumn("owner", R.address(F.col("owner_address"))).where("owner is not null")
    return G.holdings_by_month(rows, "owner")


@query("g19_owned_collections", """
  select owner_address_norm, count(*) as collections from $collections where owner_address_norm is not null group by 1""")
def _(a):
    return a.collections.where("owner_address_norm is not null").groupBy("owner_address_norm").agg(F.count("*").alias("collections"))


@query("g11_export_manifest_counts", """
  select c.collection_id,
    (select count(*) from $collection_items i where i.collection_id = c.collection_id) as items,
    (select count(*) from $collection_sections s where s.collection_id = c.collection_id) as sections,
    (select count(*) from $collection_urls u where u.collection_id = c.collection_id) as urls,
    (select count(*) from $collection_media m where m.collection_id = c.collection_id) as media,
    (select count(*) from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id where ar.collection_id = c.collection_id) as artist_drops,
    (select count(*) from $suggested_drops sd where sd.collection_id = c.collection_id and curation_status = 'approved') as suggestions,
    (select count(*) from $g11_union g where g.collection_id = c.collection_id) as drop_stats
  from $collections c""", {"g11_union": """select collection_id, drop_id from $collection_items
    union select ar.collection_id, ad.drop_id from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id
    union select collection_id, drop_id from $suggested_drops where curation_status = 'approved'"""})
def _(a):
    return export_manifest(a)


def export_manifest(a):
    """Seven counts per collection from one grouped pass over the stacked relations."""
    artist = a.collection_artist_drops.join(a.collection_artists.select("artist_id", "collection_id"), "artist_id")
    approved = a.suggested_drops.where("curation_status = 'approved'")
    union = J.collection_drop_union(a.collection_items, a.collection_artist_drops, a.collection_artists, a.suggested_drops)
    relations = {"items": a.collection_items, "sections": a.collection_sections, "urls": a.collection_urls, "media": a.collection_media,
                 "artist_drops": artist, "suggestions": approved, "drop_stats": union}
    stacked = J.union_all(*[df.select("collection_id", F.lit(n).alias("relation")) for n, df in relations.items()])
    counts = stacked.groupBy("collection_id").agg(*[F.count_if(F.col("relation") == n).alias(n) for n in relations])
    return a.collections.select("collection_id").join(counts, "collection_id", "left").na.fill(0, list(relations))
