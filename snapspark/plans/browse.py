"""P, K, W: filters, projections, pages and limits per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import CATALOG_SNAPSHOT, COLLECTIONS_SNAPSHOT, MEDIA_BASE, MOMENTS_SNAPSHOT
from ..functions import ordering as O
from ..functions import rules as R
from ..operators import browse as B
from ..operators.relations import collection_drop_union
from ..session import parts_for, written
from .registry import query
from .sqltext import CARD_KEY_OK, CLASS_SQL, PUBLIC_MEDIA

@query("p01_drop_browse_filter", """
  select drop_id, title, year, is_virtual from $drops_base where is_private = 0 and year = 1994 and is_virtual = 0""")
def _(a):
    return B.public_drops(a.drops_base, 1994, "in-person").select("drop_id", "title", "year", "is_virtual")


@query("p02_drop_summary", f"""
  select drop_id, fancy_id, title, start_date, city, country, year, is_virtual, token_count,
    '{MEDIA_BASE}/snapshots/{CATALOG_SNAPSHOT}/artwork/' || drop_id || '.webp' as image_url, has_artwork
  from $drops""")
def _(a):
    return B.drop_summary(a.drops, MEDIA_BASE, CATALOG_SNAPSHOT)


@query("p03_collection_browse_filter", """
  select 'recent' as mode, collection_id, title, type, year from $collections c
  where not exists (select 1 from $collection_ui_settings u where u.collection_id = c.collection_id and is_visible_in_recent_list = 0)
    and type = 'artist'
  union all select 'search', collection_id, title, type, year from $collections where type = 'artist'""")
def _(a):
    cols = ["collection_id", "title", "type", "year"]
    recent = B.public_collections(a.collections, a.collection_ui_settings, kind="artist")
    search = B.public_collections(a.collections, a.collection_ui_settings, kind="artist", searching=True)
    return recent.select(F.lit("recent").alias("mode"), *cols).unionByName(search.select(F.lit("search").alias("mode"), *cols))


@query("p04_collection_type", """
  select collection_id, case when type in ('artist', 'organization', 'user') then type end as type from $collections""")
def _(a):
    return a.collections.select("collection_id", B.collection_type(F.col("type")).alias("type"))


@query("p06_public_media", f"select media_key, moment_id from $moment_media where {PUBLIC_MEDIA}")
def _(a):
    return public_media(a.moment_media).select("media_key", "moment_id")


def public_media(media):
    status = R.media_status(F.col("raw_status"))
    ok = R.public_media(MOMENTS_SNAPSHOT, status, F.col("object_key"), F.col("archive_sha256"), F.col("archive_content_type"))
    return media.where(ok)


@query("p07_visibility_class", f"""
  select s.drop_id, {CLASS_SQL} as visibility from (select distinct drop_id from $chain_stats union select drop_id + 1000000000 from $moment_hidden_drops) s
  left join $drop_cards c on c.drop_id = s.drop_id""")
def _(a):
    ids = a.chain_stats.select("drop_id").union(a.moment_hidden_drops.select(F.col("drop_id") + 1000000000)).distinct()
    cards = a.drop_cards.select("drop_id", "is_hidden", "private_value", F.lit(1).alias("_card"))
    vis = R.visibility(F.col("_card").isNotNull(), F.col("is_hidden"), F.col("private_value"))
    return ids.join(cards, "drop_id", "left").select("drop_id", vis.alias("visibility"))


_SEEN = "is_hidden = 0 and private_value = 'false'"
_SHOWN = "fancy_id title description start_date end_date year city country is_virtual token_count transfer_count featured_on moments_uploaded event_url".split()


@query("p08_redacted_cards", f"""
  select drop_id, case when is_hidden <> 0 then 'hidden' when coalesce(private_value, '') <> 'false' then 'private' else 'visible' end as visibility,
    {', '.join(f"case when {_SEEN} then {c} end as {c}" for c in _SHOWN)},
    case when {_SEEN} and {CARD_KEY_OK} then '{MEDIA_BASE}/' || image_object_key end as image_url,
    case when {_SEEN} then case when coalesce(email_claims_minted, email_claims_reserved, email_claims_total) is not null then 1 else 0 end end as has_claims
  from $drop_cards""")
def _(a):
    return B.redacted_cards(a.drop_cards, MEDIA_BASE, CATALOG_SNAPSHOT, COLLECTIONS_SNAPSHOT)


@query("p09_private_normaliser", """
  select raw, case when raw in ('true', 'false') then raw end as private_value, case when raw = 'false' then 0 else 1 end as is_private,
    case when raw is null or raw in ('true', 'false') then 1 else 0 end as known, count(*) as n
  from (select case when drop_id % 97 = 0 then 'maybe' else private_value end as raw from $drop_cards) x group by raw""")
def _(a):
    raw = a.drop_cards.select(F.when(F.col("drop_id") % 97 == 0, "maybe").otherwise(F.col("private_value")).alias("raw"))
    p = R.private_value(F.col("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).select(
        "raw", p["value"].alias("private_value"), p["is_private"].alias("is_private"), p["known"].alias("known"), "n")


@query("p10_rederive_private", """
  select drop_id, is_private as old_is_private, case when private_value = 'false' then 0 else 1 end as is_private
  from (select drop_id, private_value, case when drop_id % 5 = 0 then 1 - is_private else is_private end as is_private from $drop_cards) x
  where is_private <> case when private_value = 'false' then 0 else 1 end""")
def _(a):
    legacy = a.drop_cards.withColumn(
        "old_is_private", F.when(F.col("drop_id") % 5 == 0, 1 - F.col("is_private")).otherwise(F.col("is_private")))
    fixed = legacy.withColumn("is_private", R.private_value(F.col("private_value"))["is_private"])
    return fixed.where(F.col("is_private") != F.col("old_is_private")).select("drop_id", "old_is_private", "is_private")


@query("p11_exact_lookup", f"""
  select k.drop_id, d.title, d.start_date, case when d.drop_id is null then 0 else 1 end as available
  from (select distinct drop_id from $tokens) k left join $drops_base d on d.drop_id = k.drop_id and d.is_private = 0""")
def _(a):
    return B.lookup_ids(a.tokens, a.drops_base).select("drop_id", "title", "start_date", "available")


@query("p12_available_split", """
  select case when d.drop_id is null then 'unavailable' else 'available' end as outcome, count(*) as n, sum(k.drop_id)::bigint as id_sum
  from (select distinct drop_id from $tokens) k left join $drops_base d on d.drop_id = k.drop_id and d.is_private = 0 group by 1""")
def _(a):
    split = B.lookup_ids(a.tokens, a.drops_base)
    outcome = F.when(F.col("available") == 1, "available").otherwise("unavailable").alias("outcome")
    return split.groupBy(outcome).agg(F.count("*").alias("n"), F.sum("drop_id").alias("id_sum"))


@query("p13_record_text_filter", """
  select source_uid, t.drop_id from $tokens t left join $drops_base d on d.drop_id = t.drop_id
  where strpos(lower(coalesce(d.title, '')), 'ring') > 0 or strpos(lower(coalesce(d.description, '')), 'ring') > 0""")
def _(a):
    drop = a.drops_base.select("drop_id", F.struct("title", "description").alias("drop"))
    rows = a.tokens.select("source_uid", "drop_id").join(drop, "drop_id", "left")
    return B.search_text(rows, "RING").select("source_uid", "drop_id")


@query("p14_branding_references", """
  select collection_id || ':' || role as reference_id, collection_id, role, source_url from (
    select collection_id, 'logo' as role, logo_image_url as source_url from $collections
    union all select collection_id, 'banner', banner_image_url from $collections) x
  where source_url is not null and source_url <> ''""")
def _(a):
    return B.unpivot_branding(a.collections)


# Sorting and paging --------------------------------------------------------------------------
def _drop_page(sort, key, direction, limit, cursor=None):
    where = "" if cursor is None else f"and ({key} {'>' if direction == 'asc' else '<'} {cursor[0]!r} or ({key} = {cursor[0]!r} and drop_id {'>' if direction == 'asc' else '<'} {cursor[1]}))"
    return f"""(select '{sort}' as sort, drop_id, {key}::varchar as sort_key from $drops where is_private = 0 {where}
      order by {key} {direction}, drop_id {direction} limit {limit})"""


@query("k01_drop_sorts", " union all ".join([
    _drop_page("recent", "start_date", "desc", 48), _drop_page("oldest", "start_date", "asc", 48), _drop_page("popular", "token_count", "desc", 48)]))
def _(a):
    public = B.public_drops(a.drops)
    parts = []
    for sort, order in B.DROP_ORDERS.items():
        top = O.page(public, order, 48)
        parts.append(top.select(F.lit(sort).alias("sort"), "drop_id", F.col(order[0][0]).cast("string").alias("sort_key")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k02_keyset_page", """
  select drop_id, start_date, case when (select count(*) from $k02_rows) > 24 then 1 else 0 end as has_next from $k02_rows
  order by start_date desc, drop_id desc limit 24""", {"k02_rows": """
    select drop_id, start_date from $drops_base
    where is_private = 0 and (start_date < '1996-01-01' or (start_date = '1996-01-01' and drop_id < 100))"""})
def _(a):
    rows = B.public_drops(a.drops_base).select("drop_id", "start_date")
    return O.page(rows, B.DROP_ORDERS["recent"], 24, ("1996-01-01", 100))


@query("k03_owner_holdings_page", """
  select owner_address_norm, token_id, source_uid, drop_id, n as page_rank, case when total > 24 then 1 else 0 end as has_next from (
    select *, row_number() over (partition by owner_address_norm order by token_id desc, source_uid desc) as n,
      count(*) over (partition by owner_address_norm) as total from $tokens) x where n <= 24""")
def _(a):
    rows = B.owner_holdings(a.tokens.select("owner_address_norm", "token_id", "source_uid", "drop_id"), per_key=24)
    return rows


@query("k04_drop_collectors_page", """
  select drop_id, owner_address_norm, token_id, source_uid, minted_on, network, transfer_count, n as page_rank,
    case when total > 48 then 1 else 0 end as has_next from (
    select *, row_number() over (partition by drop_id order by token_id desc, source_uid desc, owner_address_norm desc) as n,
      count(*) over (partition by drop_id) as total from $tokens) x where n <= 48""")
def _(a):
    tokens = written(a.tokens, "tokens")  # worked out once for the references and the details
    refs = tokens.select("drop_id", "token_id", "source_uid", "owner_address_norm")
    return B.drop_collectors(refs, tokens, per_key=48, parts=parts_for(tokens))


@query("k05_collections_page", """
  select 'recent' as list, collection_id, updated_on, null::varchar as owner from (select * from $collections order by updated_on desc, collection_id desc limit 24) x
  union all
  select 'owned', collection_id, updated_on, owner_address_norm from (
    select *, row_number() over (partition by owner_address_norm order by updated_on desc, collection_id desc) as n from $collections
    where owner_address_norm is not null) y where n <= 2""")
def _(a):
    recent = O.page(a.collections, B.COLLECTION_ORDER, 24)
    owned = O.page_per_key(a.collections.where("owner_address_norm is not null"), "owner_address_norm", B.COLLECTION_ORDER, 2)
    return recent.select(F.lit("recent").alias("list"), "collection_id", "updated_on", F.lit(None).cast("string").alias("owner")).unionByName(
        owned.select(F.lit("owned").alias("list"), "collection_id", "updated_on", F.col("owner_address_norm").alias("owner")))


@query("k06_collection_lists_pages", """
  select list, collection_id, id, drop_id, n as page_rank from (
    select *, row_number() over (partition by list, collection_id order by k, id, drop_id) as n from (
      select 'items' as list, collection_id, item_id::varchar as id, drop_id, item_id as k from $collection_items
      union all select 'artist-drops', ar.collection_id, ad.artist_id, ad.drop_id, 0 from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id
      union all select 'suggestions', collection_id, suggestion_id::varchar, drop_id, suggestion_id from $suggested_drops where curation_status = 'approved'
      union all select 'drop-stats', collection_id, drop_id::varchar, drop_id, drop_id from $k06_union) u) x
  where n <= 48""", {"k06_union": """select collection_id, drop_id from $collection_items
    union select ar.collection_id, ad.drop_id from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id
    union select collection_id, drop_id from $suggested_drops where curation_status = 'approved'"""})
def _(a):
    artist = a.collection_artist_drops.join(a.collection_artists.select("artist_id", "collection_id"), "artist_id")
    approved = a.suggested_drops.where("curation_status = 'approved'")
    union = collection_drop_union(a.collection_items, a.collection_artist_drops, a.collection_artists, a.suggested_drops)
    lists = {
        "items": (a.collection_items, "item_id", (("item_id", "asc"),)),
        "artist-drops": (artist, "artist_id", (("artist_id", "asc"), ("drop_id", "asc"))),
        "suggestions": (approved, "suggestion_id", (("suggestion_id", "asc"),)),
        "drop-stats": (union, "drop_id", (("drop_id", "asc"),)),
    }
    parts = []
    for name, (df, ident, order) in lists.items():
        top = O.top_per_key(df, "collection_id", order, 48, "page_rank")
        parts.append(top.select(F.lit(name).alias("list"), "collection_id", F.col(ident).cast("string").alias("id"), "drop_id", "page_rank"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("k07_moments_pages", """
  select 'authored' as list, author_address_norm as owner, moment_id as id, created_on from $moments
    qualify row_number() over (partition by author_address_norm order by created_on desc, moment_id desc) <= 12
  union all
  select 'capsules', owner_address_norm, capsule_id, created_on from $capsules
    qualify row_number() over (partition by owner_address_norm order by created_on desc, capsule_id desc) <= 3""")
def _(a):
    authored = O.top_per_key(a.moments, "author_address_norm", (("created_on", "desc"), ("moment_id", "desc")), 12)
    capsules = O.top_per_key(a.capsules, "owner_address_norm", (("created_on", "desc"), ("capsule_id", "desc")), 3)
    return authored.select(F.lit("authored").alias("list"), F.col("author_address_norm").alias("owner"), F.col("moment_id").alias("id"), "created_on").unionByName(
        capsules.select(F.lit("capsules").alias("list"), F.col("owner_address_norm").alias("owner"), F.col("capsule_id").alias("id"), "created_on"))


@query("k08_relation_bounds", """
  select 'relation_bound' as rule, 'collection_items' as entity, collection_id::varchar as key, count(*)::varchar || ' > 150' as detail
  from $collection_items group by collection_id having count(*) > 150
  union all
  select 'relation_bound', 'moment_drops', moment_id::varchar, count(*)::varchar || ' > 1' from $moment_drops group by moment_id having count(*) > 1""")
def _(a):
    return B.over_bound(a.collection_items, "collection_id", 150, "relation_bound", "collection_items").unionByName(
        B.over_bound(a.moment_drops, "moment_id", 1, "relation_bound", "moment_drops"))


@query("k09_full_walk_audit", """
  select owner_address_norm, count(*) as walked, count(distinct source_uid) as distinct_uids, max(s.token_count) as expected,
    case when count(*) = max(s.token_count) and count(distinct source_uid) = count(*) then 1 else 0 end as complete
  from $tokens t join $owner_stats s using (owner_address_norm) group by owner_address_norm""")
def _(a):
    # Two-level count: distinct uids are combined before the per-owner step, so one large owner stays spread out.
    per_uid = a.tokens.groupBy("owner_address_norm", "source_uid").agg(F.count("*").alias("n"))
    walked = per_uid.groupBy("owner_address_norm").agg(F.sum("n").alias("walked"), F.count("*").alias("distinct_uids"))
    expected = a.owner_stats.select("owner_address_norm", F.col("token_count").alias("expected"))
    joined = walked.join(expected, "owner_address_norm")
    complete = (F.col("walked") == F.col("expected")) & (F.col("walked") == F.col("distinct_uids"))
    return joined.withColumn("complete", R.flag(complete))


# Windows -------------------------------------------------------------------------------------
@query("w01_top_relations_per_collection", """
  select relation, collection_id, id, rank from (
    select relation, collection_id, id, row_number() over (partition by relation, collection_id order by k, id) as rank from (
      select 'urls' as relation, collection_id, url_id::varchar as id, lpad(url_id::varchar, 20, '0') as k from $collection_urls
      union all select 'media', collection_id, role, case role when 'logo' then '1' when 'banner' then '2' when 'mobile_banner' then '3' else '4' end from $collection_media
      union all select 'sections', collection_id, section_id, lpad(position::varchar, 20, '0') from $collection_sections
      union all select 'artists', collection_id, artist_id, artist_id from $collection_artists
      union all select 'organizations', collection_id, organization_id::varchar, lpad(organization_id::varchar, 20, '0') from $collection_organizations) u) x
  where rank <= 3""")
def _(a):
    def top(df, relation, order, ident):
        ranked = O.top_per_key(df, "collection_id", order, 3)
        return ranked.select(F.lit(relation).alias("relation"), "collection_id", F.col(ident).cast("string").alias("id"), "rank")

    return (
        top(a.collection_urls, "urls", (("url_id", "asc"),), "url_id")
        .unionByName(top(B.with_role_rank(a.collection_media), "media", (("role_rank", "asc"), ("role", "asc")), "role"))
        .unionByName(top(a.collection_sections, "sections", (("position", "asc"), ("section_id", "asc")), "section_id"))
        .unionByName(top(a.collection_artists, "artists", (("artist_id", "asc"),), "artist_id"))
        .unionByName(top(a.collection_organizations, "organizations", (("organization_id", "asc"),), "organization_id"))
    )


@query("w02_preview_media", f"""
  select moment_id, media_key, position, created_at from $moment_media where moment_id is not null and {PUBLIC_MEDIA}
  qualify row_number() over (partition by moment_id order by position, created_at, media_key) = 1""")
def _(a):
    return preview_media(a.moment_media)


def preview_media(media):
    rows = public_media(media).where("moment_id is not null")
    return O.first_per_key(rows, "moment_id", ["position", "created_at", "media_key"], ["media_key", "position", "created_at"])


@query("j08_preview_without_earlier", f"""
  select p.moment_id, p.media_key from (select * from $moment_media where {PUBLIC_MEDIA}) p
  where p.moment_id is not null and not exists (
    select 1 from (select * from $moment_media where {PUBLIC_MEDIA}) e where e.moment_id = p.moment_id
      and (e.position < p.position or (e.position = p.position and (e.created_at < p.created_at or (e.created_at = p.created_at and e.media_key < p.media_key)))))""")
def _(a):
    return preview_media(a.moment_media).select("moment_id", "media_key")


@query("w03_media_role_order", """
  select collection_id, role, case role when 'logo' then 1 when 'banner' then 2 when 'mobile_banner' then 3 else 4 end as role_rank from $collection_media""")
def _(a):
    return B.with_role_rank(a.collection_media).select("collection_id", "role", "role_rank")


@query("w04_position_in_parent", """
  select media_key, row_number() over (partition by moment_id order by media_key) - 1 as position from $moment_media""")
def _(a):
    parent = F.coalesce(F.col("moment_id").cast("string"), F.lit("__orphan__"))
    rows = a.moment_media.select(parent.alias("parent"), "media_key")
    return O.positions(rows, "parent", ["media_key"]).select("media_key", "position")
