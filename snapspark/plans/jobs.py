"""N and P-15..P-17: table jobs that clean columns and count outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import MOMENTS_SNAPSHOT
from ..functions import rules as R
from ..operators import aggregates as G
from ..operators import media as M
from ..operators import projections as N
from ..operators import relations as J
from .media import HOSTS
from .media import SQL as MEDIA
from .registry import query
from .sqltext import EXT_SQL, SAFE_URL, STATUS_SQL

ADDRESS_COLUMNS = [  # table, column, trimmed
    ("raw_tokens", "owner_address", False), ("collections", "owner_address", True), ("moments", "author", True),
    ("moment_user_tags", "address", True), ("capsules", "owner", True)]


def _addr_sql(table, col, trim):
    v = f"trim({col})" if trim else col
    return f"""select '{table}.{col}' as column_name, case when {col} is null then 'null' when not regexp_matches({v}, '^0x[0-9a-fA-F]{{40}}$') then 'invalid'
      when lower({v}) = {col} then 'unchanged' else 'changed' end as outcome, count(*) as n from ${table} group by 1, 2"""


@query("n1_address_columns", " union all ".join(_addr_sql(*c) for c in ADDRESS_COLUMNS))
def _(a):
    parts = []
    for table, col, trim in ADDRESS_COLUMNS:
        clean, raw = R.address(F.col(col), trim), F.col(col)
        outcome = F.when(raw.isNull(), "null").when(clean.isNull(), "invalid").when(clean == raw, "unchanged").otherwise("changed")
        parts.append(getattr(a, table).groupBy(F.lit(f"{table}.{col}").alias("column_name"), outcome.alias("outcome")).agg(F.count("*").alias("n")))
    return J.union_all(*parts)


URL_COLUMNS = [("drops_base", "event_url"), ("collection_urls", "url"), ("moment_links", "url"), ("pages", "url")]


@query("n2_url_columns", " union all ".join(
    f"""select '{t}.{c}' as column_name, case when {c} is null then 'null' when ({SAFE_URL(c)}) is null then 'refused' else 'accepted' end as outcome,
      coalesce(case when regexp_matches({c}, '^[a-z]+://') then lower(regexp_extract({c}, '^[a-z]+://(?:[^/@]*@)?([^/?#:]+)', 1)) end, '') as host, count(*) as n from ${t} group by 1, 2, 3""" for t, c in URL_COLUMNS).replace("$pages", "pages"))
def _(a):
    parts = []
    for table, col in URL_COLUMNS:
        raw = F.col(col)
        outcome = F.when(raw.isNull(), "null").when(R.safe_url(raw).isNull(), "refused").otherwise("accepted")
        host = F.coalesce(F.lower(F.try_parse_url(raw, F.lit("HOST"))), F.lit(""))
        parts.append(getattr(a, table).groupBy(F.lit(f"{table}.{col}").alias("column_name"), outcome.alias("outcome"), host.alias("host")).agg(F.count("*").alias("n")))
    return J.union_all(*parts)


# Every page's URL written in one of nine odd ways, and what each of them is in normal form.
ODD_URLS = [
    ("upper(s) || '://' || upper(h) || p || t", "url"),
    ("s || '://' || h || case s when 'https' then ':443' else ':080' end || p || t", "url"),
    ("s || '://' || h || '/x/.././%2e' || p || t", "url"),
    ("chr(9) || ' ' || url || chr(10) || ' '", "url"),
    ("s || '://' || h || p || ' é\"' || t", "s || '://' || h || p || '%20%C3%A9%22' || t"),
    ("s || ':' || replace('//' || h || p, '/', chr(92)) || t", "url"),
    ("s || '://user:pw@' || h || p || t", "null"),
    ("s || '://Bücher.' || h || p || t", "s || '://xn--bcher-kva.' || h || p || t"),
    ("s || '://' || h || ':8443' || p || '?q=''x y''#é'", "s || '://' || h || ':8443' || p || '?q=%27x%20y%27#%C3%A9'"),
]
_PARTED = "regexp_extract(url, '^(https?)://([^/]+)(/[^?#]*)(.*)$', {})"
_WAYS = "case page_id % 9 " + " ".join(f"when {i} then {{{i}}}" for i in range(9)) + " end"


@query("n2_normal_urls", f"""
  select page_id, {_WAYS.format(*[want for _, want in ODD_URLS])} as url from (
    select page_id, url, {_PARTED.format(1)} as s, {_PARTED.format(2)} as h, {_PARTED.format(3)} as p, {_PARTED.format(4)} as t from pages) x""")
def _(a):
    parted = a.pages.select("page_id", "url", *[F.regexp_extract("url", "^(https?)://([^/]+)(/[^?#]*)(.*)$", i).alias(c) for i, c in enumerate("shpt", 1)])
    odd = parted.withColumn("odd", F.expr(_WAYS.format(*[way for way, _ in ODD_URLS]).replace("'?q=''x y''#é'", "concat('?q=', chr(39), 'x y', chr(39), '#é')")))
    return odd.select("page_id", R.safe_url(F.col("odd")).alias("url"))


@query("n2_image_url_refusals", """
  select collection_id, role, case when source_url = 'not a url' or source_url like 'http:%' then 'INVALID_SOURCE_URL' when source_url like 'https://dead.example.org/%' then 'REWRITTEN'
      when source_url like 'https://images.example.org/%' then 'OK' else 'SOURCE_HOST_NOT_ALLOWED' end as code,
    case when source_url like 'https://dead.example.org/%' then replace(source_url, 'dead.example.org', 'recovered.example.org') when source_url like 'https://images.example.org/%' then source_url end as url
  from (select collection_id, 'logo' as role, logo_image_url as source_url from $collections union all select collection_id, 'banner', banner_image_url from $collections) x
  where source_url is not null and source_url <> ''""")
def _(a):
    from ..operators.browse import unpivot_branding

    return R.with_image_url(unpivot_branding(a.collections), "source_url", HOSTS).select("collection_id", "role", "code", "url")


@query("n3_media_keys", f"""
  select media_key, case when archive_content_type like 'image/%' then 'image' when archive_content_type like 'video/%' then 'video' else 'other' end as kind, {EXT_SQL} as extension,
    case when object_key = 'snapshots/{MOMENTS_SNAPSHOT}/moments/original/sha256/' || substr(archive_sha256, 1, 2) || '/' || archive_sha256 || '.' || ({EXT_SQL}) then 1 else 0 end as key_matches from $moment_media""")
def _(a):
    ctype = F.col("archive_content_type")
    expected = R.moment_object_key(MOMENTS_SNAPSHOT, "public", F.col("archive_sha256"), R.media_extension(ctype))
    return a.moment_media.select("media_key", R.media_kind(ctype).alias("kind"), R.media_extension(ctype).alias("extension"), R.flag(F.col("object_key") == expected).alias("key_matches"))


@query("n4_gateway_labels", "select label, count(*) as n, count(distinct media_key) as media from $labelled group by label", MEDIA)
def _(a):
    return M.labelled_gateways(a.gateways, HOSTS).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("media_key").alias("media"))


@query("n5_status_mapping", f"""
  select raw_status, {STATUS_SQL} as status, case when ({STATUS_SQL}) is null then 1 else 0 end as rejected, count(*) as n from $moment_media group by raw_status""")
def _(a):
    mapped = R.media_status(F.col("raw_status"))
    return a.moment_media.groupBy("raw_status").agg(F.count("*").alias("n")).select("raw_status", mapped.alias("status"), R.flag(mapped.isNull()).alias("rejected"), "n")


@query("n7_record_ids", """
  select count(*) as duplicated, coalesce(sum(n - 1), 0)::bigint as surplus from (select count(*) as n from $tokens group by 'archive:' || token_id || ':' || network having count(*) > 1) x""")
def _(a):
    return G.duplicate_keys(a.tokens.select(R.source_uid("archive", F.col("token_id"), F.col("network")).alias("record_id")), "record_id")


_CANON = "regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]{{3}}Z$')"
TIME_COLUMNS = [("moments", "created_on"), ("moments", "updated_on"), ("raw_drops", "start_date"), ("collections", "updated_on"), ("moment_media", "created_at")]


@query("n8_timestamp_columns", " union all ".join(
    f"""select '{t}.{c}' as column_name, case when {c} is null then 'null' when {_CANON.format(c=c)} then 'canonical' when try_cast({c} as timestamp) is not null then 'other_form' else 'invalid' end as verdict,
      count(*) as n from ${t} group by 1, 2""" for t, c in TIME_COLUMNS))
def _(a):
    parts = []
    for table, col in TIME_COLUMNS:
        raw = F.col(col)
        verdict = F.when(raw.isNull(), "null").when(R.canonical_instant(raw), "canonical").when(F.try_to_timestamp(raw).isNotNull(), "other_form").otherwise("invalid")
        parts.append(getattr(a, table).groupBy(F.lit(f"{table}.{col}").alias("column_name"), verdict.alias("verdict")).agg(F.count("*").alias("n")))
    return J.union_all(*parts)


def captured_entities(a):
    """Captured rows as text, with known defects by collection and drop id."""
    c, s = F.col, lambda name: F.col(name).cast("string")
    null = F.lit(None).cast("string")

    def as_text(df, renames=None, **over):
        out = df.select(*[s(n).alias((renames or {}).get(n, n)) for n in df.columns])
        for name, value in over.items():
            out = out.withColumn(name, value)
        return out

    return {
        "collections": as_text(a.collections, {"collection_id": "id"}, type_rank=null, created_by=null, external_url=null,
                               title=F.when(c("id").cast("bigint") % 11 == 0, "").otherwise(c("title")), year=F.when(c("id").cast("bigint") % 13 == 0, "soon").otherwise(c("year"))),
        "collection_items": as_text(a.collection_items, {"item_id": "id"}, drop_id=F.when(c("drop_id").cast("bigint") % 97 == 0, F.concat(F.lit("-"), c("drop_id"))).otherwise(c("drop_id"))),
        "collection_sections": as_text(a.collection_sections, {"section_id": "id"}, position=F.when(c("position") == "2", "two").otherwise(c("position"))),
        "collection_urls": as_text(a.collection_urls, {"url_id": "id"}),
        "suggested_drops": as_text(a.suggested_drops, {"suggestion_id": "id"}, suggested_by=null, reviewed_on=null,
                                   curation_status=F.when(c("drop_id").cast("bigint") % 89 == 0, null).otherwise(c("curation_status"))),
        "collection_item_sections": as_text(a.collection_item_sections, position=F.when(c("position") == "7", null).otherwise(c("position"))),
        "collection_ui_settings": as_text(
            a.collection_ui_settings, **{name: null for name in ("primary_color", "highlight_color", "dark_color", "grey_color", "white_color")},
            is_visible_in_recent_list=F.when(c("collection_id").cast("bigint") % 9 == 1, "maybe").otherwise(c("is_visible_in_recent_list"))),
        "collection_media": as_text(a.collection_media, byte_length=F.when((c("role") == "banner") & (c("collection_id").cast("bigint") % 3 == 0), "-1").otherwise(c("byte_length"))),
        "collection_artists": as_text(a.collection_artists, {"artist_id": "id"}, slug=null, created_at=F.when(c("collection_id").cast("bigint") % 6 == 0, "").otherwise("2023-01-01")),
        "collection_artist_drops": as_text(a.collection_artist_drops, drop_id=F.when(c("drop_id").cast("bigint") % 103 == 0, "0").otherwise(c("drop_id"))),
        "collection_organizations": as_text(
            a.collection_organizations, {"organization_id": "id"}, slug=F.lit("org"), created_on=F.lit("2023-01-01"),
            name=F.when(c("collection_id").cast("bigint") % 7 == 0, null).otherwise(c("name"))),
        "verified_collections": as_text(a.verified_collections, verified_by=F.when(c("collection_id").cast("bigint") % 3 == 0, "someone").otherwise(c("verified_by"))),
        "featured_collections": as_text(a.featured_collections, featured_on=F.when(c("collection_id").cast("bigint") % 2 == 0, null).otherwise(c("featured_on"))),
        "collection_drop_cards": as_text(
            a.drop_cards, {"drop_id": "id", "title": "name", "is_virtual": "virtual"}, channel=null, platform=null, timezone=null,
            year=F.when(c("id").cast("bigint") % 71 == 0, "x").otherwise(c("year"))),
        "collection_drop_stats_by_chain": as_text(a.chain_stats, created_on=null, token_count=F.when(c("drop_id").cast("bigint") % 101 == 0, "1.5").otherwise(c("token_count"))),
    }


@query("p15_typed_collections", """
  select 'collections' as entity, collection_id::varchar as key, 'collections.title' as violation from $collections where collection_id % 11 = 0
  union all select 'collections', collection_id::varchar, 'collections.year' from $collections where collection_id % 13 = 0
  union all select 'collection_items', item_id::varchar, 'collection_items.drop_id' from $collection_items where drop_id % 97 = 0
  union all select 'collection_sections', section_id, 'collection_sections.position' from $collection_sections where position = 2
  union all select 'suggested_drops', suggestion_id::varchar, 'suggested_drops.curation_status' from $suggested_drops where drop_id % 89 = 0
  union all select 'collection_drop_stats_by_chain', drop_id::varchar, 'collection_drop_stats_by_chain.token_count' from $chain_stats where drop_id % 101 = 0
  union all select 'collection_item_sections', item_id::varchar, 'collection_item_sections.position' from $collection_item_sections where position = 7
  union all select 'collection_ui_settings', collection_id::varchar, 'collection_ui_settings.is_visible_in_recent_list' from $collection_ui_settings where collection_id % 9 = 1
  union all select 'collection_media', collection_id::varchar, 'collection_media.byte_length' from $collection_media where role = 'banner' and collection_id % 3 = 0
  union all select 'collection_artists', artist_id, 'collection_artists.created_at' from $collection_artists where collection_id % 6 = 0
  union all select 'collection_artist_drops', artist_id, 'collection_artist_drops.drop_id' from $collection_artist_drops where drop_id % 103 = 0
  union all select 'collection_organizations', organization_id::varchar, 'collection_organizations.name' from $collection_organizations where collection_id % 7 = 0
  union all select 'verified_collections', collection_id::varchar, 'verified_collections.verified_by' from $verified_collections where collection_id % 3 = 0
  union all select 'featured_collections', collection_id::varchar, 'featured_collections.featured_on' from $featured_collections where collection_id % 2 = 0
  union all select 'collection_drop_cards', drop_id::varchar, 'collection_drop_cards.title' from $drop_cards where title is null
  union all select 'collection_drop_cards', drop_id::varchar, 'collection_drop_cards.year' from $drop_cards where drop_id % 71 = 0""")
def _(a):
    parts = []
    for entity, rows in captured_entities(a).items():
        spec = N.COLLECTION_SPECS[entity]
        key = next(iter(spec))
        out = N.typed(rows, entity, spec)
        parts.append(out.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.explode("violations").alias("violation")))
    return J.union_all(*parts)


@query("p16_typed_moments", """
  select 'capsules' as entity, capsule_id::varchar as key, nullif(trim(case when capsule_id % 9 = 0 then '  ' else ' ' || owner end), '') as name,
    case when capsule_id % 9 <> 0 then owner_address_norm end as address, case when capsule_id % 10 = 0 then 'capsules.created_on' else '' end as violations from $capsules
  union all select 'moments', moment_id::varchar, author, author_address_norm, case when moment_id % 50 = 0 then 'moments.legacy_drop_id' else '' end from $moments
  union all select 'moment_media', media_key, case when doc_id % 15 = 2 then '' else source_status end, null, concat_ws(',', case when doc_id % 15 = 2 then 'moment_media.source_status' end,
    case when doc_id % 21 = 5 then 'moment_media.byte_length' end) from $moment_media
  union all select 'moment_links', link_id::varchar, title, null, case when link_id % 12 = 0 then 'moment_links.moment_id' else '' end from $moment_links
  union all select 'moment_user_tags', tag_id::varchar, case when tag_id % 8 = 0 then null else ens end, address_norm, '' from $moment_user_tags""")
def _(a):
    c = F.col
    text = lambda name: F.col(name).cast("string")
    capsules = a.capsules.select(text("capsule_id").alias("id"), "external_id", F.when(c("capsule_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "owner")).alias("owner"),
                                 "title", "url", F.when(c("capsule_id") % 10 != 0, c("created_on")).alias("created_on"))
    moments = a.moments.select(text("moment_id").alias("id"), "display_id", "author", "description", "cid", c("token_ref").alias("token_id"),
                               F.when(c("moment_id") % 50 == 0, "x1").alias("drop_id"), "created_on", "updated_on", text("updated").alias("updated"))
    media = a.moment_media.select(
        F.upper("media_key").alias("key"), text("moment_id").alias("moment_id"), "mime_type", c("source_hash").alias("hash"),
        F.when(c("doc_id") % 15 == 2, "").otherwise(c("source_status")).alias("status"), F.when(c("doc_id") % 21 == 5, "1.5").otherwise(text("byte_length")).alias("byte_length"))
    links = a.moment_links.select(text("link_id").alias("id"), F.when(c("link_id") % 12 != 0, text("moment_id")).alias("moment_id"), "title", "url")
    tags = a.moment_user_tags.select(
        text("tag_id").alias("id"), text("moment_id").alias("moment_id"), F.concat(F.lit(" "), "address").alias("address"),
        F.when(c("tag_id") % 8 == 0, "  ").otherwise(c("ens")).alias("ens"))
    shown = {  # entity: rows, key, name, address
        "capsules": (capsules, "capsule_id", c("owner"), c("owner_address_norm")), "moments": (moments, "moment_id", c("author"), c("author_address_norm")),
        "moment_media": (media, "media_key", c("source_status"), F.lit(None).cast("string")), "moment_links": (links, "link_id", c("title"), F.lit(None).cast("string")),
        "moment_user_tags": (tags, "tag_id", c("ens"), c("address_norm")),
    }
    return J.union_all(*[
        N.typed(rows, entity, N.MOMENT_SPECS[entity]).select(
            F.lit(entity).alias("entity"), c(key).cast("string").alias("key"), name.alias("name"), address.alias("address"), F.array_join("violations", ",").alias("violations"))
        for entity, (rows, key, name, address) in shown.items()])


@query("p17_flat_drops", """
  select drop_id, fancy_id, title, start_date, end_date, case when drop_id % 97 = 0 then null else private_value end as private_value, case when drop_id % 97 <> 0 and private_value = 'false' then 0 else 1 end as is_private,
    is_hidden, case when is_hidden = 1 then '2024-05-01' end as hidden_on, concat_ws(',', case when title is null then 'drops.name' end, case when drop_id % 97 = 0 then 'drops.private' end) as violations from $drop_cards""")
def _(a):
    c = F.col
    hidden = F.when(c("is_hidden") == 1, F.struct(c("drop_id"), F.lit("2024-05-01").alias("hidden_on")))
    rows = a.drop_cards.select(c("drop_id").alias("id"), "fancy_id", c("title").alias("name"), "start_date", "end_date",
                               F.when(c("drop_id") % 97 == 0, "maybe").otherwise(c("private_value")).alias("private"), hidden.alias("hidden_drop"))
    return N.flat_drop(rows).withColumn("violations", F.array_join("violations", ","))
