"""B and the joins behind it: public rows, documents, personal relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import publication as P
from ..operators import relations as J
from ..session import parts_for, written
from .aggregates import media_counts
from .browse import preview_media, public_media
from .joins import details, layers
from .registry import query
from .sqltext import CLASS_SQL, PUBLIC_MEDIA, SAFE_URL

SQL = {
    "public_moments": """select m.* from $moments m
      join (select moment_id, max(is_public) as shown from $moment_visibility group by moment_id) v on v.moment_id = m.moment_id
      join (select l.moment_id, bool_or(h.drop_id is not null) as touches_hidden from $moment_drops l left join $moment_hidden_drops h on h.drop_id = l.drop_id group by l.moment_id) s on s.moment_id = m.moment_id
      left join (select moment_id, bool_or(active = 1) as stopped from $moment_suppressions group by moment_id) x on x.moment_id = m.moment_id
      where v.shown = 1 and not s.touches_hidden and not coalesce(x.stopped, false)""",
    "public_capsules": """select c.* from $capsules c left join (
        select capsule_id, max(shown) as shown, max(stopped) as stopped from (
          select capsule_id, is_public as shown, 0 as stopped from $capsule_visibility union all select capsule_id, 0, active from $capsule_suppressions) r group by capsule_id) f
      on f.capsule_id = c.capsule_id where f.shown = 1 and f.stopped <> 1""",
    "pairs": "select distinct m.moment_id, i.collection_id from $moment_drops m join $collection_items i on i.drop_id = m.drop_id",
    "pub_media": f"select * from $moment_media where {PUBLIC_MEDIA}",
    "tagged": "select distinct address_norm, moment_id from $moment_user_tags where moment_id in (select moment_id from $public_moments)",
    "owned_union": """select collection_id, drop_id from $collection_items
      union select ar.collection_id, ad.drop_id from $collection_artist_drops ad join $collection_artists ar on ar.artist_id = ad.artist_id
      union select collection_id, drop_id from $suggested_drops where curation_status = 'approved'""",
}
KIND = "case when archive_content_type like 'image/%' then 'image' when archive_content_type like 'video/%' then 'video' when archive_content_type like 'audio/%' then 'audio' else 'other' end"


def public_moments(a):
    return P.public_moments(a.moments, a.moment_visibility, a.moment_drops, a.moment_hidden_drops, a.moment_suppressions)


def public_capsules(a):
    return P.public_capsules(a.capsules, a.capsule_visibility, a.capsule_suppressions)


def pairs(a, items=None):
    items = a.collection_items if items is None else items
    return J.collection_map(a.moment_drops, items, parts_for(a.events, rows=50_000))  # a moment has a dozen collections and more


@query("j06_public_moments", "select moment_id, author_address_norm, created_on from $public_moments", SQL)
def _(a):
    return public_moments(a).select("moment_id", "author_address_norm", "created_on")


@query("j07_public_capsules", "select capsule_id, owner_address_norm, title from $public_capsules", SQL)
def _(a):
    return public_capsules(a).select("capsule_id", "owner_address_norm", "title")


@query("j09_moments_with_media_kind", f"""
  select moment_id from $public_moments m where exists (select 1 from $pub_media x where x.moment_id = m.moment_id and {KIND} = 'video')""", SQL)
def _(a):
    return P.with_media_kind(public_moments(a), public_media(a.moment_media), "video").select("moment_id")


@query("p05_moments_browse_filter", f"""
  select 'drop' as filter, moment_id from $public_moments where moment_id in (select moment_id from $moment_drops where drop_id = 8)
  union all select 'author', moment_id from $public_moments where author_address_norm = '0x' || repeat('0', 38) || '2e'
  union all select 'collection+kind', moment_id from $public_moments where moment_id in (select moment_id from $pairs where collection_id = 3)
    and moment_id in (select moment_id from $pub_media where {KIND} = 'image')""", SQL)
def _(a):
    public, media, bridge = public_moments(a), public_media(a.moment_media), pairs(a)
    cases = {"drop": {"drop_id": 8}, "author": {"author": "0x" + "0" * 38 + "2e"}, "collection+kind": {"collection_id": 3, "kind": "image"}}
    parts = [P.browse_moments(public, a.moment_drops, bridge, media, **kw).select(F.lit(n).alias("filter"), "moment_id") for n, kw in cases.items()]
    return J.union_all(*parts)


@query("j19_capsule_relations", """
  select r.moment_id, c.capsule_id, c.external_id, c.title from $capsule_moments r join $public_capsules c on c.capsule_id = r.capsule_id""", SQL)
def _(a):
    return P.capsule_relations(a.capsule_moments, public_capsules(a)).select("moment_id", "capsule_id", "external_id", "title")


@query("j20_scoped_counts", """
  select 'drop' as scope, drop_id as id, count(*) as n from $moment_drops where moment_id in (select moment_id from $public_moments) group by drop_id
  union all select 'collection', collection_id, count(*) from $pairs where moment_id in (select moment_id from $public_moments) group by collection_id""", SQL)
def _(a):
    public = public_moments(a)
    drop = P.scoped_counts(a.moment_drops, public, "drop_id").select(F.lit("drop").alias("scope"), F.col("drop_id").alias("id"), "n")
    coll = P.scoped_counts(pairs(a), public, "collection_id").select(F.lit("collection").alias("scope"), F.col("collection_id").alias("id"), "n")
    return drop.unionByName(coll)


@query("g10_personal_relation_counts", """
  select address, count(*) filter (where k = 1) as authored_moments, count(*) filter (where k = 2) as tagged_moments, count(*) filter (where k = 3) as owned_capsules
  from (select author_address_norm as address, 1 as k from $public_moments union all select address_norm, 2 from $tagged
    union all select owner_address_norm, 3 from $public_capsules) x group by address""", SQL)
def _(a):
    return P.personal_counts(public_moments(a), a.moment_user_tags, public_capsules(a))


@query("b01_source_visibility", """
  select m.moment_id, case when h = 0 then 1 else 0 end as is_public, case when h = 1 then 'hidden_drop' when h = 0 then 'drop_linked' else 'without_drop' end as source_scope
  from $moments m left join (select l.moment_id, max(case when h.drop_id is null then 0 else 1 end) as h from $moment_drops l
    left join $moment_hidden_drops h on h.drop_id = l.drop_id group by l.moment_id) x on x.moment_id = m.moment_id""", SQL)
def _(a):
    return P.source_visibility(a.moments, a.moment_drops, a.moment_hidden_drops)


@query("b02_hidden_drop_merge", """
  select 'moments_only' as mode, drop_id, hidden_on, 'moments' as source from $moment_hidden_drops
  union all select 'merged', coalesce(m.drop_id, g.drop_id), least(coalesce(m.hidden_on, g.hidden_on), coalesce(g.hidden_on, m.hidden_on)),
    case when g.drop_id is null then 'moments' when m.drop_id is null then 'drops' else 'moments+drops' end
  from $moment_hidden_drops m full join $generic_hidden_drops g on g.drop_id = m.drop_id""")
def _(a):
    own = P.merge_hidden(a.moment_hidden_drops).withColumn("mode", F.lit("moments_only"))
    return own.unionByName(P.merge_hidden(a.moment_hidden_drops, a.generic_hidden_drops).withColumn("mode", F.lit("merged")))


@query("b03_capsule_visibility", """
  select capsule_id, case when ok then 1 else 0 end as is_public, case when ok then 'linked_public_moment' else 'without_public_moment' end as source_scope
  from (select capsule_id, capsule_id in (select capsule_id from $capsule_moments where moment_id in (select moment_id from $public_moments)) as ok from $capsules) x""", SQL)
def _(a):
    return P.capsule_visibility(a.capsules, a.capsule_moments, public_moments(a))


@query("b04_collection_profiles", f"""
  select c.collection_id, 0 as part, c.title, coalesce(u.ids, '') as url_ids, coalesce(u.urls, '') as urls, coalesce(m.roles, '') as roles, coalesce(s.ids, '') as section_ids,
    coalesce(ar.ids, '') as artist_ids, coalesce(o.ids, '') as organization_ids, f.featured_on
  from $collections c
  left join (select collection_id, string_agg(url_id::varchar, ',' order by url_id) as ids, string_agg(coalesce({SAFE_URL('url')}, ''), ',' order by url_id) as urls from $collection_urls group by 1) u on u.collection_id = c.collection_id
  left join (select collection_id, string_agg(role, ',' order by case role when 'logo' then 1 when 'banner' then 2 when 'mobile_banner' then 3 else 4 end, role) as roles from $collection_media group by 1) m on m.collection_id = c.collection_id
  left join (select collection_id, string_agg(section_id, ',' order by position, section_id) as ids from $collection_sections group by 1) s on s.collection_id = c.collection_id
  left join (select collection_id, string_agg(artist_id, ',' order by artist_id) as ids from $collection_artists group by 1) ar on ar.collection_id = c.collection_id
  left join (select collection_id, string_agg(organization_id::varchar, ',' order by organization_id) as ids from $collection_organizations group by 1) o on o.collection_id = c.collection_id
  left join $featured_collections f on f.collection_id = c.collection_id""")
def _(a):
    docs = P.collection_profiles(details(a), a.collection_urls, B.with_role_rank(a.collection_media), a.collection_sections,
                                 a.collection_artists, a.collection_organizations)
    text = P.joined_text
    return docs.select(
        "collection_id", "part", "title", text("urls", "url_id").alias("url_ids"), text("urls", "url").alias("urls"), text("media", "role").alias("roles"),
        text("sections", "section_id").alias("section_ids"), text("artists", "artist_id").alias("artist_ids"),
        text("organizations", "organization_id").alias("organization_ids"), "featured_on")


def _summarised(a):
    public = public_moments(a)
    return public, media_counts(a), preview_media(a.moment_media), a.moment_drops, pairs(a)


def summaries(a):
    return P.moment_summaries(*_summarised(a))


def moment_documents(a):
    capsules = P.capsule_relations(a.capsule_moments, public_capsules(a))
    return P.moment_details(*_summarised(a), public_media(a.moment_media), a.moment_links, a.moment_user_tags, capsules)


@query("b05_moment_summaries", """
  select p.moment_id, 0 as part, coalesce(c.n, 0) as source_media_count, coalesce(c.p, 0) as media_count,
    case when c.n is null then 'none' when c.p = 0 then 'pending' when c.p < c.n then 'partial' else 'complete' end as media_state, v.media_key as preview_key,
    coalesce(d.ids, '') as drop_ids, coalesce(k.ids, '') as collection_ids
  from $public_moments p
  left join (select moment_id, count(*) as n, count(*) filter (where media_key in (select media_key from $pub_media)) as p from $moment_media group by moment_id) c on c.moment_id = p.moment_id
  left join (select moment_id, media_key from $pub_media where moment_id is not null qualify row_number() over (partition by moment_id order by position, created_at, media_key) = 1) v on v.moment_id = p.moment_id
  left join (select moment_id, string_agg(drop_id::varchar, ',' order by drop_id) as ids from $moment_drops group by moment_id) d on d.moment_id = p.moment_id
  left join (select moment_id, string_agg(collection_id::varchar, ',' order by collection_id) as ids from $pairs group by moment_id) k on k.moment_id = p.moment_id""", SQL)
def _(a):
    return summaries(a).select("moment_id", "part", "source_media_count", "media_count", "media_state", "preview_key",
                               P.joined_text("drops", "drop_id").alias("drop_ids"), P.joined_text("collections", "collection_id").alias("collection_ids"))


@query("b06_moment_details", f"""
  select p.moment_id, 0 as part, p.cid, coalesce(m.ids, '') as media_keys, coalesce(m.kinds, '') as kinds, coalesce(l.ids, '') as link_ids, coalesce(l.urls, '') as link_urls,
    coalesce(t.ids, '') as tag_addresses, coalesce(c.ids, '') as capsule_ids
  from $public_moments p
  left join (select moment_id, string_agg(media_key, ',' order by position, created_at, media_key) as ids, string_agg({KIND}, ',' order by position, created_at, media_key) as kinds from $pub_media group by 1) m on m.moment_id = p.moment_id
  left join (select moment_id, string_agg(link_id::varchar, ',' order by link_id) as ids, string_agg(coalesce({SAFE_URL('url', 'https')}, ''), ',' order by link_id) as urls from $moment_links group by 1) l on l.moment_id = p.moment_id
  left join (select moment_id, string_agg(address, ',' order by tag_id) as ids from $moment_user_tags group by 1) t on t.moment_id = p.moment_id
  left join (select moment_id, string_agg(capsule_id::varchar, ',' order by capsule_id) as ids from $capsule_moments where capsule_id in (select capsule_id from $public_capsules) group by 1) c on c.moment_id = p.moment_id""", SQL)
def _(a):
    text = P.joined_text
    return moment_documents(a).select("moment_id", "part", "cid", text("media", "media_key").alias("media_keys"), text("media", "kind").alias("kinds"),
                                      text("links", "link_id").alias("link_ids"), text("links", "url").alias("link_urls"),
                                      text("tags", "address").alias("tag_addresses"), text("capsules", "capsule_id").alias("capsule_ids"))


@query("b07_tagged_moments", "select t.address_norm, t.moment_id, m.created_on from $tagged t join $public_moments m on m.moment_id = t.moment_id", SQL)
def _(a):
    public = public_moments(a)
    return P.tagged_moments(a.moment_user_tags, public).join(public.select("moment_id", "created_on"), "moment_id")


@query("b08_owned_capsules", "select owner_address_norm, capsule_id, created_on from $public_capsules where owner_address_norm in (select owner_address_norm from $owner_stats)", SQL)
def _(a):
    from ..functions.ordering import only

    return only(public_capsules(a), a.tokens, "owner_address_norm").select("owner_address_norm", "capsule_id", "created_on")


@query("b09_drop_statistics", f"""
  select i.drop_id, {CLASS_SQL} as visibility, case when {CLASS_SQL} = 'visible' then c.token_count end as token_count,
    case when {CLASS_SQL} = 'visible' then coalesce(c.transfer_count, 0) end as transfer_count, case when {CLASS_SQL} = 'visible' then coalesce(s.t, '') else '' end as by_chain
  from (select distinct drop_id from $owned_union union select drop_id + 1000000000 from $moment_hidden_drops) i left join $drop_cards c on c.drop_id = i.drop_id
  left join (select drop_id, string_agg(k || '=' || token_count || '/' || transfer_count, ',' order by k) as t from
    (select *, case when chain is null then 'n:' else 's:' || chain end as k from $chain_stats) x group by drop_id) s on s.drop_id = i.drop_id""", SQL)
def _(a):
    ids = J.collection_drop_union(a.collection_items, a.collection_artist_drops, a.collection_artists, a.suggested_drops).select("drop_id")
    ids = J.union_distinct(ids, a.moment_hidden_drops.select((F.col("drop_id") + 1000000000).alias("drop_id")))
    docs = P.drop_statistics(ids, a.drop_cards, a.chain_stats)
    chain = F.transform("by_chain", lambda s: F.concat(s["chain_key"], F.lit("="), s["tokens"].cast("string"), F.lit("/"), s["transfers"].cast("string")))
    return docs.withColumn("by_chain", F.coalesce(F.array_join(chain, ","), F.lit("")))


@query("b10_held_drop_status", """
  select owner_address_norm, drop_id, case when drop_id in (select drop_id from $drops_base where is_private = 0)
    or drop_id in (select drop_id from $drop_cards where is_private = 1 or is_hidden = 1) or drop_id in (select drop_id from $holding_drops) then 'available' else 'unavailable' end as status
  from (select distinct owner_address_norm, drop_id from $tokens) x""")
def _(a):
    return P.held_drop_status(a.tokens, layers(a))


@query("g17_moment_associations", """
  select distinct 'authored' as kind, m.author_address_norm as owner, p.collection_id, m.moment_id from $public_moments m join $pairs p on p.moment_id = m.moment_id
  union all select distinct 'tagged', t.address_norm, p.collection_id, t.moment_id from $tagged t join $pairs p on p.moment_id = t.moment_id""", SQL)
def _(a):
    public, bridge = public_moments(a), pairs(a)
    authored = P.moment_associations(public, "author_address_norm", bridge).withColumn("kind", F.lit("authored"))
    return authored.unionByName(P.moment_associations(P.tagged_moments(a.moment_user_tags, public), "address_norm", bridge).withColumn("kind", F.lit("tagged")))


def collection_drops(a, items=None, artist_drops=None, suggested=None):
    items, artist_drops, suggested = items or a.collection_items, artist_drops or a.collection_artist_drops, suggested or a.suggested_drops
    return J.collection_drop_union(items, artist_drops, a.collection_artists, suggested, parts_for(a.lineitem))


def owned_drops(a, union=None):
    union = collection_drops(a) if union is None else union
    owners = a.collections.where("owner_address_norm is not null").select("collection_id", F.col("owner_address_norm").alias("owner"))
    return union.join(owners, "collection_id").select("owner", "drop_id")


def personal_references(a):
    public = public_moments(a)
    return P.personal_references(a.tokens, public, P.tagged_moments(a.moment_user_tags, public), a.moment_drops, owned_drops(a), parts_for(a.lineitem))


SQL["my_moments"] = "select author_address_norm as owner, moment_id from $public_moments union select address_norm, moment_id from $tagged"
SQL["personal_refs"] = """select owner_address_norm as owner, drop_id from $tokens
  union select x.owner, d.drop_id from $my_moments x join $moment_drops d on d.moment_id = x.moment_id
  union select c.owner_address_norm, u.drop_id from $owned_union u join $collections c on c.collection_id = u.collection_id where c.owner_address_norm is not null"""


@query("u03_personal_drop_references", "select owner, drop_id from $personal_refs", SQL)
def _(a):
    return personal_references(a)


@query("u07_personal_collections", """
  select t.owner_address_norm as owner, i.collection_id from $tokens t join $collection_items i on i.drop_id = t.drop_id
  union select owner_address_norm, collection_id from $collections where owner_address_norm is not null
  union select x.owner, p.collection_id from $my_moments x join $pairs p on p.moment_id = x.moment_id""", SQL)
def _(a):
    public = public_moments(a)
    tagged = P.tagged_moments(a.moment_user_tags, public)
    parts = parts_for(a.lineitem, rows=50_000)  # a token's drop is in a dozen collections and more
    items = written(a.collection_items.select("drop_id", "collection_id"), "items")
    return P.personal_collections(a.tokens, items, a.collections, public, tagged, pairs(a, items), parts)
