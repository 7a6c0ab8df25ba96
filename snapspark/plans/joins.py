"""J, U: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import CATALOG_SNAPSHOT, COLLECTIONS_SNAPSHOT, HOLDINGS_SNAPSHOT, MEDIA_BASE
from ..functions import rules as R
from ..operators import browse as B
from ..operators import relations as J
from .registry import query
from .sqltext import CARD_KEY_OK, HOLD_KEY_OK, SAFE_URL

ART = f"'{MEDIA_BASE}/snapshots/{CATALOG_SNAPSHOT}/artwork/' || {{}} || '.webp'"
LAYER_TABLES = {
    "l_cat": f"""select drop_id, fancy_id, title, start_date, end_date, city, country, year, event_url, {ART.format('drop_id')} as image_url,
      has_artwork, token_count, is_private, 0 as is_hidden from $drops""",
    "l_card": f"""select drop_id, fancy_id, coalesce(title, 'Private Drop #' || drop_id) as title, start_date, end_date, city, country, year,
      {SAFE_URL('event_url')} as event_url, case when {CARD_KEY_OK} then '{MEDIA_BASE}/' || image_object_key else '' end as image_url,
      case when {CARD_KEY_OK} then 1 else 0 end as has_artwork, coalesce(token_count, 0) as token_count,
      case when coalesce(private_value, '') <> 'false' then 1 else 0 end as is_private, is_hidden from $drop_cards""",
    "l_hold": f"""select drop_id, fancy_id, coalesce(title, 'Archived Drop #' || drop_id) as title, start_date, end_date, city, country, year,
      {SAFE_URL('event_url')} as event_url, case when {HOLD_KEY_OK} then '{MEDIA_BASE}/' || image_object_key else '' end as image_url,
      case when {HOLD_KEY_OK} then 1 else 0 end as has_artwork, token_count, is_private, is_hidden from $holding_drops""",
}


def layers(a, exact: bool = False):
    return J.stack_layers(
        catalog=J.catalog_layer(a.drops, MEDIA_BASE, CATALOG_SNAPSHOT, include_private=exact),
        card=J.card_layer(a.drop_cards, MEDIA_BASE, CATALOG_SNAPSHOT, COLLECTIONS_SNAPSHOT, held_only=not exact),
        holding=J.holding_layer(a.holding_drops, MEDIA_BASE, CATALOG_SNAPSHOT, HOLDINGS_SNAPSHOT, COLLECTIONS_SNAPSHOT),
    )


@query("j01_drop_with_stats", f"""
  select d.drop_id, title, {SAFE_URL('event_url')} as event_url, coalesce(email_reservations_total, 0) as email_reservations_total,
    coalesce(email_reservations_minted, 0) as email_reservations_minted, coalesce(email_reservations_unminted, 0) as email_reservations_unminted
  from $drops_base d left join $drop_stats s on s.drop_id = d.drop_id""")
def _(a):
    return B.with_drop_stats(a.drops_base, a.drop_stats).select(
        "drop_id", "title", "event_url", "email_reservations_total", "email_reservations_minted", "email_reservations_unminted")


@query("j02_drop_collectors", """
  select r.drop_id, r.source_uid, r.token_id, r.owner_address_norm, t.minted_on, t.network, t.transfer_count
  from $tokens r join $tokens t on t.owner_address_norm = r.owner_address_norm and t.token_id = r.token_id and t.source_uid = r.source_uid
  where r.drop_id in (select drop_id from $drops_base where is_private = 0)""")
def _(a):
    refs = a.tokens.select("drop_id", "token_id", "source_uid", "owner_address_norm")
    return B.drop_collectors(refs, a.tokens, keys=B.public_drops(a.drops_base).select("drop_id"))



@query("j03_collection_detail", f"""
  select c.collection_id, c.title, case when lg.object_key is not null then '{MEDIA_BASE}/' || lg.object_key end as logo_url,
    case when bn.object_key is not null then '{MEDIA_BASE}/' || bn.object_key end as banner_url, f.featured_on, v.verified_on, v.verified_by,
    o.name as verifier_name, u.title_color, u.is_visible_in_recent_list
  from $collections c
  left join $collection_media lg on lg.collection_id = c.collection_id and lg.role = 'logo' and lg.status = 'stored' and lg.eligible_for_publish = 1
  left join $collection_media bn on bn.collection_id = c.collection_id and bn.role = 'banner' and bn.status = 'stored' and bn.eligible_for_publish = 1
  left join $featured_collections f on f.collection_id = c.collection_id
  left join $verified_collections v on v.collection_id = c.collection_id
  left join $collection_organizations o on o.organization_id = v.verified_by
  left join $collection_ui_settings u on u.collection_id = c.collection_id""")
def _(a):
    return details(a).select("collection_id", "title", "logo_url", "banner_url", "featured_on", "verified_on", "verified_by",
                             "verifier_name", "title_color", "is_visible_in_recent_list")


def details(a):
    return J.collection_details(a.collections, a.collection_media, a.featured_collections, a.verified_collections,
                                a.collection_ui_settings, a.collection_organizations, MEDIA_BASE, COLLECTIONS_SNAPSHOT)


@query("j04_item_with_card", """
  select i.item_id, i.collection_id, i.drop_id, c.title as card_title, case when c.drop_id is null then 1 else 0 end as card_missing
  from $collection_items i left join (select * from $drop_cards where drop_id % 10 <> 0) c on c.drop_id = i.drop_id""")
def _(a):
    cards = a.drop_cards.where("drop_id % 10 <> 0").select("drop_id", F.struct("title").alias("card"))
    return a.collection_items.join(cards, "drop_id", "left").select(
        "item_id", "collection_id", "drop_id", F.col("card.title").alias("card_title"), R.flag(F.col("card").isNull()).alias("card_missing"))


@query("j05_recent_list_anti_join", """
  select c.collection_id from $collections c
  left join (select collection_id, min(is_visible_in_recent_list) as seen from $collection_ui_settings group by collection_id) u on u.collection_id = c.collection_id
  where coalesce(u.seen, 1) <> 0""")
def _(a):
    return B.public_collections(a.collections, a.collection_ui_settings).select("collection_id")


@query("j11_owner_holdings", f"""
  select t.source_uid, t.token_id, t.drop_id, t.minted_on, t.owner_address_norm, t.network, t.transfer_count,
    case when c.drop_id is not null then 'catalog' when p.drop_id is not null then 'card' when h.drop_id is not null then 'holding' else 'placeholder' end as layer,
    coalesce(c.title, p.title, h.title, 'Archived Drop #' || t.drop_id) as title,
    coalesce(c.start_date, p.start_date, h.start_date, '') as start_date,
    case when c.drop_id is not null then c.city when p.drop_id is not null then p.city else h.city end as city,
    coalesce(c.year, p.year, h.year, 0) as year,
    case when coalesce(c.drop_id, p.drop_id) is not null and coalesce(c.has_artwork, p.has_artwork) = 0 and h.has_artwork = 1 then h.image_url
      else coalesce(c.image_url, p.image_url, h.image_url, {ART.format('t.drop_id')}) end as image_url,
    case when coalesce(c.has_artwork, p.has_artwork, 0) = 1 or h.has_artwork = 1 then 1 else 0 end as has_artwork,
    coalesce(c.token_count, p.token_count, h.token_count, 0) as drop_token_count
  from $tokens t left join (select * from $l_cat where is_private = 0) c on c.drop_id = t.drop_id
  left join (select l.* from $l_card l join $drop_cards d on d.drop_id = l.drop_id where d.is_private = 1 or d.is_hidden = 1) p on p.drop_id = t.drop_id
  left join $l_hold h on h.drop_id = t.drop_id""", LAYER_TABLES)
def _(a):
    return J.owner_tokens(a.tokens, layers(a), MEDIA_BASE, CATALOG_SNAPSHOT)


@query("j12_artwork_fallback", """
  select c.drop_id, case when c.has_artwork = 0 and h.has_artwork = 1 then h.image_url else c.image_url end as image_url,
    case when c.has_artwork = 0 and h.has_artwork = 1 then 1 else 0 end as borrowed
  from $l_cat c left join $l_hold h on h.drop_id = c.drop_id where c.is_private = 0""", LAYER_TABLES)
def _(a):
    both = layers(a).where("catalog is not null")
    shown = J.with_fallback_artwork(F.col("catalog"), F.col("holding"))
    return both.select("drop_id", shown["image_url"].alias("image_url"),
                       R.flag(shown["has_artwork"] > F.col("catalog.has_artwork")).alias("borrowed"))



def _pick(col):  # the presentation's column: catalog unless missing or private, then the card when there is one
    return f"case when c.drop_id is null or (c.is_private = 1 and p.drop_id is not null) then p.{col} else c.{col} end"


@query("j13_exact_drop_merge", f"""
  select drop_id, case when h_id is not null then h_title else s_title end as title, case when h_id is not null then h_start else s_start end as start_date,
    case when h_id is not null then h_city else s_city end as city, case when h_id is not null then h_year else s_year end as year,
    case when h_id is not null then h_tokens else s_tokens end as token_count,
    case when s_id is not null and s_art = 1 then s_image when h_id is not null then h_image else s_image end as image_url,
    case when s_id is not null and s_art = 1 then 1 when h_id is not null then h_art else s_art end as has_artwork,
    greatest(coalesce(h_private, 0), coalesce(s_private, 0)) as is_private, greatest(coalesce(h_hidden, 0), coalesce(s_hidden, 0)) as is_hidden,
    case when c_public = 1 then coalesce(r, 0) end as catalog_reservations
  from (select k.drop_id, h.drop_id as h_id, h.title as h_title, h.start_date as h_start, h.city as h_city, h.year as h_year, h.token_count as h_tokens,
      h.image_url as h_image, h.has_artwork as h_art, h.is_private as h_private, h.is_hidden as h_hidden,
      {_pick('drop_id')} as s_id, {_pick('title')} as s_title, {_pick('start_date')} as s_start, {_pick('city')} as s_city, {_pick('year')} as s_year,
      {_pick('token_count')} as s_tokens, {_pick('image_url')} as s_image, {_pick('has_artwork')} as s_art, {_pick('is_private')} as s_private,
      {_pick('is_hidden')} as s_hidden, case when c.is_private = 0 then 1 else 0 end as c_public, s.email_reservations_total as r
    from (select drop_id from $l_cat union select drop_id from $l_card union select drop_id from $l_hold) k
    left join $l_cat c on c.drop_id = k.drop_id left join $l_card p on p.drop_id = k.drop_id left join $l_hold h on h.drop_id = k.drop_id
    left join $drop_stats s on s.drop_id = k.drop_id) x""", LAYER_TABLES)
def _(a):
    return J.exact_drops(layers(a, exact=True), a.drop_stats)


@query("j14_export_records", f"""
  select t.source_uid, t.token_id, t.drop_id, t.owner_address_norm, t.network, t.minted_on, t.transfer_count,
    coalesce(c.title, p.title, h.title, 'Archived Item #' || t.token_id) as title, coalesce(c.start_date, p.start_date, h.start_date, '') as start_date,
    coalesce(c.end_date, p.end_date, h.end_date, '') as end_date,
    coalesce(c.city, case when c.drop_id is null then coalesce(p.city, h.city) end) as city,
    coalesce(c.country, case when c.drop_id is null then coalesce(p.country, h.country) end) as country,
    {SAFE_URL('''(case when c.drop_id is not null then c.event_url when p.drop_id is not null then p.event_url else h.event_url end)''')} as event_url,
    case when c.drop_id is not null then case when c.has_artwork = 1 then {ART.format('t.drop_id')} end
      when p.drop_id is not null then nullif(case when p.has_artwork = 0 and h.has_artwork = 1 then h.image_url else p.image_url end, '')
      else nullif(h.image_url, '') end as artwork_url,
    case when c.drop_id is not null then 0 when p.drop_id is not null then p.is_private else coalesce(h.is_private, 0) end as is_private,
    case when c.drop_id is not null then 0 when p.drop_id is not null then p.is_hidden else coalesce(h.is_hidden, 0) end as is_hidden
  from $tokens t left join (select * from $l_cat where is_private = 0) c on c.drop_id = t.drop_id
  left join (select l.* from $l_card l join $drop_cards d on d.drop_id = l.drop_id where d.is_private = 1 or d.is_hidden = 1) p on p.drop_id = t.drop_id
  left join $l_hold h on h.drop_id = t.drop_id""", LAYER_TABLES)
def _(a):
    return J.export_records(a.tokens, layers(a), MEDIA_BASE, CATALOG_SNAPSHOT)


@query("j15_held_drop_rows", """
  select h.drop_id, h.title, s.token_count, s.transfer_count, 'ok' as verdict from $holding_drops h
    join (select drop_id, count(*) as token_count, sum(transfer_count)::bigint as transfer_count from $tokens group by drop_id) s on s.drop_id = h.drop_id
  union all select h.drop_id, h.title, null, null, 'no_tokens' from $holding_drops h where h.drop_id not in (select drop_id from $tokens)""")
def _(a):
    stats = a.tokens.groupBy("drop_id").agg(F.count("*").alias("token_count"), F.sum("transfer_count").alias("transfer_count"))
    joined = a.holding_drops.select("drop_id", "title").join(stats, "drop_id", "left")
    return joined.withColumn("verdict", F.when(F.col("token_count").isNull(), "no_tokens").otherwise("ok"))


@query("j16_collection_memberships", """
  select distinct i.collection_id, c.title, i.drop_id from $collection_items i join $collections c on c.collection_id = i.collection_id
  where i.drop_id in (select drop_id from $holding_drops)""")
def _(a):
    return J.memberships(a.collection_items, a.collections, a.holding_drops)


@query("j17_item_sections", """
  select i.collection_id, i.item_id, string_agg(s.section_id, ',' order by s.position, l.position, s.section_id) as sections
  from $collection_items i join $collection_item_sections l on l.item_id = i.item_id
  join $collection_sections s on s.section_id = l.section_id and s.collection_id = i.collection_id group by 1, 2""")
def _(a):
    rows = J.item_sections(a.collection_items, a.collection_item_sections, a.collection_sections)
    return rows.select("collection_id", "item_id", F.array_join(F.transform("sections", lambda s: s["section_id"]), ",").alias("sections"))


@query("j10_moment_collection_pairs", """
  select distinct m.moment_id, i.collection_id from $moment_drops m join $collection_items i on i.drop_id = m.drop_id""")
def _(a):
    return J.collection_map(a.moment_drops, a.collection_items)


@query("j10_collection_map_counts", """
  select 'collections' as name, count(*) as n from $collections
  union all select 'collections_with_drop_ids', count(distinct collection_id) from $collection_items
  union all select 'collection_drop_references', count(*) from $collection_items
  union all select 'unique_collection_drops', count(distinct drop_id) from $collection_items
  union all select 'moment_drop_relations', count(*) from $moment_drops
  union all select 'moments_with_drop_relations', count(distinct moment_id) from $moment_drops
  union all select 'matched_moment_drop_relations', count(*) from $moment_drops where drop_id in (select drop_id from $collection_items)
  union all select 'mapped_moments', count(distinct moment_id) from $mc_pairs
  union all select 'mapped_collections', count(distinct collection_id) from $mc_pairs
  union all select 'moment_collection_pairs', count(*) from $mc_pairs
  union all select 'unmatched_moment_drop_relations', count(*) from $moment_drops where drop_id not in (select drop_id from $collection_items)""",
  {"mc_pairs": "select distinct m.moment_id, i.collection_id from $moment_drops m join $collection_items i on i.drop_id = m.drop_id"})
def _(a):
    pairs = J.collection_map(a.moment_drops, a.collection_items)
    counts = J.collection_map_counts(a.moment_drops, a.collections, a.collection_items, pairs)
    unmatched = a.moment_drops.join(a.collection_items.select("drop_id").distinct(), "drop_id", "left_anti")
    return counts.unionByName(unmatched.agg(F.count("*").alias("n")).select(F.lit("unmatched_moment_drop_relations").alias("name"), "n"))


@query("j22_catalog_for_referenced", """
  select d.drop_id, d.token_count, d.has_artwork, count(*) over () as matched, sum(d.has_artwork) over ()::bigint as flagged
  from $drops d where d.drop_id in (select drop_id from $collection_items union select drop_id from $collection_artist_drops)""")
def _(a):
    ids = J.union_distinct(a.collection_items.select("drop_id"), a.collection_artist_drops.select("drop_id"))
    rows = a.drops.join(ids, "drop_id", "left_semi").select("drop_id", "token_count", "has_artwork")
    totals = rows.agg(F.count("*").alias("matched"), F.sum("has_artwork").alias("flagged"))
    return rows.select("*", totals.select("matched").scalar().alias("matched"), totals.select("flagged").scalar().alias("flagged"))


# Set operations ------------------------------------------------------------------------------
@query("u01_collection_drop_union", """
  select collection_id, drop_id from $collection_items
  union select ar.collection_id, ad.drop_id from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id
  union select collection_id, drop_id from $suggested_drops where curation_status = 'approved'""")
def _(a):
    return J.collection_drop_union(a.collection_items, a.collection_artist_drops, a.collection_artists, a.suggested_drops)


def drop_id_arrays(items):
    """The captured view: arrays of drop ids per collection, at most 4096 ids in one row."""
    part = F.floor(F.col("drop_id") / 4096).alias("part")
    return items.groupBy("collection_id", part).agg(F.sort_array(F.collect_list("drop_id")).alias("drop_ids"))


@query("u02_referenced_drop_union", """
  select drop_id from $collection_items union select drop_id from $collection_artist_drops union select drop_id from $suggested_drops""")
def _(a):
    arrays = drop_id_arrays(a.collection_items).select(F.explode("drop_ids").alias("drop_id"))
    frames = [df.select("drop_id") for df in (a.collection_items, a.collection_artist_drops, a.suggested_drops)]
    return J.union_distinct(*frames, arrays)


@query("u04_missing_ids", """
  select distinct drop_id from $tokens where drop_id not in (select drop_id from $drops_base)""")
def _(a):
    return a.tokens.select("drop_id").distinct().join(a.drops_base, "drop_id", "left_anti")


@query("u05_set_equality", """
  select coalesce(l.drop_id, r.drop_id) as drop_id, case when r.drop_id is null then 'left_only' else 'right_only' end as side
  from (select distinct drop_id from $collection_items) l full join (select distinct drop_id from $drops_base) r on l.drop_id = r.drop_id
  where l.drop_id is null or r.drop_id is null""")
def _(a):
    return J.one_sided(a.collection_items, a.drops_base, ["drop_id"])


@query("u06_coverage_partition", """
  select drop_id, case when av and un then 'overlap' when not ref then 'unreferenced' else 'missing' end as rule from (
    select drop_id, bool_or(s = 1) as ref, bool_or(s = 2) as av, bool_or(s = 3) as un from (
      select drop_id, 1 as s from $tokens union all select drop_id, 2 from $drops_base where is_private = 0
      union all select drop_id, 3 from $holding_drops) m group by drop_id) x
  where (av and un) or not ref or (not av and not un)""")
def _(a):
    return J.coverage_partition(a.tokens, B.public_drops(a.drops_base), a.holding_drops, "drop_id")
