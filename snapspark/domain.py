"""Archive tables derived from the driver's tables.

Every table is one deterministic SELECT. The same text is rendered for Spark and, as a CTE, for the
DuckDB check, so both sides start from the same rows. `$name` marks another table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

CATALOG_SNAPSHOT = "cat-1"
HOLDINGS_SNAPSHOT = "hold-1"
COLLECTIONS_SNAPSHOT = "coll-1"
MOMENTS_SNAPSHOT = "mom-1"
MEDIA_BASE = "https://media.example.org"


class SparkDialect:
    def hex(self, x): return f"lower(hex({x}))"
    def sha(self, x): return f"sha2({x}, 256)"
    def unix(self, x): return f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {x})"
    def ymd(self, x): return f"date_format({x}, 'yyyy-MM-dd')"
    def iso(self, x): return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    def rx(self, x, pattern): return f"{x} rlike '{pattern}'"
    def gen(self, upto, name): return f"lateral view explode(sequence(0, {upto})) g_{name} as {name}"
    def json(self, x, key): return f"get_json_object({x}, '$.{key}')"
    def ref(self, name): return "{" + name + "}"


class DuckDialect:
    def hex(self, x): return f"lower(to_hex({x}))"
    def sha(self, x): return f"sha256({x})"
    def unix(self, x): return f"epoch({x})::bigint"
    def ymd(self, x): return f"strftime({x}, '%Y-%m-%d')"
    def iso(self, x): return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    def rx(self, x, pattern): return f"regexp_matches({x}, '{pattern}')"
    def gen(self, upto, name): return f", unnest(range(0, {upto} + 1)) g_{name}({name})"
    def json(self, x, key): return f"json_extract_string({x}, '$.{key}')"
    def ref(self, name): return name


def _address(d, x, upper="false"):
    body = f"lpad({d.hex(x)}, 40, '0')"
    return f"'0x' || case when {upper} then upper({body}) else {body} end"


def _uuid(d, x):
    return f"'00000000-0000-4000-8000-' || lpad({d.hex(x)}, 12, '0')"


def _content_key(snapshot, space, sha, ext):
    return f"'snapshots/{snapshot}/{space}/sha256/' || substr({sha}, 1, 2) || '/' || {sha} || '.' || {ext}"


def definitions(d) -> dict[str, str]:
    """Name -> SELECT text in the given dialect."""
    t: dict[str, str] = {}
    S = "cast({} as string)".format

    # Catalog ------------------------------------------------------------------------------------
    t["drops_base"] = f"""
      select drop_id, case when drop_id % 50 = 0 then 'dup' else p_brand || '-' || {S('drop_id')} end as fancy_id,
        p_name as title, lower(p_type) || ' ' || p_name as description,
        {S('y')} || '-01-01' as start_date,
        case when drop_id % 43 = 0 then {S('y - 1')} || '-12-31' else {S('y')} || '-01-03' end as end_date,
        case p_size % 4 when 0 then null when 1 then 'Paris' when 2 then 'Berlin' else 'Lisboa' end as city,
        case p_size % 4 when 0 then null when 1 then 'France' when 2 then 'Germany' else 'Portugal' end as country,
        case when drop_id % 11 = 0 then 'ftp://host.example/x'
             when drop_id % 13 = 0 then 'https://user:pw@host.example/'
             when drop_id % 7 = 0 then null
             else 'https://events.example.org/' || {S('drop_id')} end as event_url,
        cast(y as int) as year,
        case p_size % 3 when 0 then null when 1 then 0 else 1 end as is_virtual,
        case when drop_id % 17 = 0 then 1 else 0 end as is_private,
        case when p_size % 5 = 0 then null else 'web' end as channel, 'home' as platform,
        'unset' as location_type, 'UTC' as timezone, {S('y')} || '-01-02' as created_at,
        case when drop_id % 4 <> 0 then 1 else 0 end as has_artwork
      from (select *, p_partkey + 1 as drop_id, 1992 + (p_partkey + 1) % 7 as y from $part) p
      where drop_id % 29 <> 0"""
    t["drops"] = """
      select d.*, coalesce(c.n, 0) as token_count from $drops_base d
      left join (select drop_id, count(*) as n from $tokens group by drop_id) c on c.drop_id = d.drop_id"""
    t["raw_drops"] = """
      select case when drop_id % 83 = 0 then -drop_id else drop_id end as drop_id,
        case when drop_id % 61 = 0 then '' else fancy_id end as fancy_id,
        case when drop_id % 67 = 0 then null else title end as title, description,
        case when drop_id % 71 = 0 then '' when drop_id % 41 = 0 then 'soon' else start_date end as start_date,
        end_date, city, country, event_url,
        case when drop_id % 37 = 0 then year + 1 else year end as year,
        case when drop_id % 73 = 0 then 2 else is_virtual end as is_virtual,
        is_private, channel, platform, location_type, timezone, created_at
      from $drops_base"""
    t["raw_email_stats"] = """
      select case when p_partkey % 59 = 58 then p_partkey + 1 + 1000000000 else p_partkey + 1 end as drop_id,
        cast(p_size as bigint) as email_reservations_total,
        cast(p_size - p_size % 5 as bigint) as email_reservations_minted,
        cast(case when p_partkey % 47 = 0 then p_size else p_size % 5 end as bigint) as email_reservations_unminted
      from $part where p_partkey % 3 <> 0"""
    t["drop_stats"] = """
      select drop_id, email_reservations_total, email_reservations_minted, email_reservations_unminted
      from $raw_email_stats where drop_id < 1000000000
        and email_reservations_total = email_reservations_minted + email_reservations_unminted"""
    t["artwork_files"] = f"""
      select drop_id, {S('drop_id')} || '.webp' as path, 1000 + p_size * 37 as byte_length,
        {d.sha(f"'art-' || {S('drop_id')}")} as sha256,
        case when drop_id % 53 = 0 then 'duplicate' when drop_id % 59 = 0 then 'invalid_signature' else 'ok' end as state
      from (select *, p_partkey + 1 as drop_id from $part) p where drop_id % 6 <> 0"""

    # Holdings -----------------------------------------------------------------------------------
    uid = f"{S('l_orderkey')} || ':' || {S('l_linenumber')}"
    t["raw_tokens"] = f"""
      select {uid} || ':' || {S('l_partkey')} || ':' || {S('l_suppkey')} || ':' || {d.ymd('l_shipdate')} as source_uid,
        l_orderkey + 1 as token_id, l_partkey + 1 as drop_id,
        case when l_linenumber = 7 and l_partkey % 5 = 0 then null else {d.unix('l_shipdate')} end as minted_on,
        case when o_custkey % 97 = 0 then '0xBAD' else {_address(d, 'o_custkey', 'o_custkey % 2 = 0')} end as owner_address,
        l_returnflag || l_linestatus as network, cast(l_quantity as bigint) as transfer_count,
        {uid} as repeated_uid
      from $lineitem join $orders on l_orderkey = o_orderkey"""
    t["tokens"] = f"""
      select source_uid, token_id, drop_id, minted_on, lower(owner_address) as owner_address_norm, network, transfer_count
      from $raw_tokens where minted_on is not null and {d.rx('owner_address', '^0x[0-9a-fA-F]{40}$')}"""
    t["owner_stats"] = """
      select owner_address_norm, count(*) as token_count, count(distinct drop_id) as unique_drop_count,
        min(minted_on) as first_minted_on, max(minted_on) as last_minted_on
      from $tokens group by owner_address_norm"""
    hsha = d.sha(f"'held-' || {S('drop_id')}")
    t["holding_drops"] = f"""
      select drop_id, 'h-' || {S('drop_id')} as fancy_id,
        case when drop_id % 58 = 0 then null else 'Held ' || p_name end as title, 'held' as description,
        {S('2001 + drop_id % 7')} || '-03-01' as start_date, {S('2001 + drop_id % 7')} || '-03-02' as end_date,
        'Oslo' as city, 'Norway' as country, cast(2001 + drop_id % 7 as int) as year,
        'https://held.example.org/' || {S('drop_id')} as event_url,
        cast(p_size as bigint) as token_count, cast(p_size * 2 as bigint) as transfer_count,
        case when drop_id % 2 = 0 then {_content_key(HOLDINGS_SNAPSHOT, 'holdings/drop-artwork', hsha, "'png'")} end as image_object_key,
        case when drop_id % 17 = 0 then 1 else 0 end as is_private,
        case when drop_id % 23 = 0 then 1 else 0 end as is_hidden
      from (select *, p_partkey + 1 as drop_id from $part) p where drop_id % 29 = 0 or drop_id % 31 = 0"""

    # Collections --------------------------------------------------------------------------------
    t["collections"] = f"""
      select collection_id, 'slug-' || {S('collection_id % 50')} as slug, s_name as title,
        case when s_suppkey % 5 = 0 then null else 'about ' || s_name end as description,
        case when s_suppkey % 10 = 9 then 'other' when s_suppkey % 3 = 0 then 'artist'
             when s_suppkey % 3 = 1 then 'organization' else 'user' end as type,
        cast(2015 + s_suppkey % 9 as int) as year,
        case when s_suppkey % 5 = 0 then ' ' || {_address(d, 's_nationkey', 'true')} when s_suppkey % 13 = 0 then 'nobody.eth'
             else {_address(d, 's_nationkey')} end as owner_address,
        case when s_suppkey % 13 = 0 and s_suppkey % 5 <> 0 then null else {_address(d, 's_nationkey')} end as owner_address_norm,
        case when s_suppkey % 4 = 0 then null else 'https://images.example.org/logo/' || {S('collection_id')} || '.png' end as logo_image_url,
        case s_suppkey % 6 when 0 then '' when 1 then 'not a url' when 2 then 'http://images.example.org/b.png'
             when 3 then 'https://dead.example.org/banner/' || {S('collection_id')} || '.png'
             when 4 then 'https://other.example.net/b.png'
             else 'https://images.example.org/banner/' || {S('collection_id')} || '.png' end as banner_image_url,
        '2023-02-0' || {S('1 + s_suppkey % 9')} as created_on, '2024-01-0' || {S('1 + s_suppkey % 7')} as updated_on
      from (select *, s_suppkey + 1 as collection_id from $supplier) s"""
    t["collection_items"] = """
      select collection_id * 1000000000 + drop_id as item_id, collection_id, drop_id,
        case when drop_id % 7 = 0 then null else '2023-05-01' end as created_on
      from (select distinct l_suppkey + 1 as collection_id, l_partkey + 1 as drop_id from $lineitem where l_linenumber % 3 = 1) i"""
    t["collection_sections"] = f"""
      select 's-' || {S('s_suppkey + 1')} || '-' || {S('k')} as section_id, s_suppkey + 1 as collection_id,
        'Part ' || {S('k')} as name, cast(k as int) as position
      from $supplier {d.gen('cast(s_suppkey % 3 as int)', 'k')}"""
    t["collection_item_sections"] = f"""
      select item_id, 's-' || {S('case when drop_id % 101 = 0 then collection_id % 10 + 1 else collection_id end')} || '-' ||
        {S('case when drop_id % 101 = 0 then 0 else drop_id % (1 + (collection_id - 1) % 3) end')} as section_id,
        cast(drop_id % 10 as int) as position
      from $collection_items"""
    t["collection_urls"] = f"""
      select (s_suppkey + 1) * 10 + k as url_id, s_suppkey + 1 as collection_id,
        case k when 2 then 'javascript:alert(1)' when 3 then 'https://a:b@site.example.org/'
          else 'https://site.example.org/' || {S('s_suppkey')} || '/' || {S('k')} end as url
      from $supplier {d.gen('cast(s_suppkey % 4 as int)', 'k')}"""
    t["collection_ui_settings"] = """
      select s_suppkey + 1 as collection_id, '#' || s_name as title_color,
        case when s_suppkey % 8 = 0 then 0 else 1 end as is_visible_in_recent_list,
        cast(s_suppkey % 3 as int) % 2 as toggle_elements
      from $supplier where s_suppkey % 2 = 0"""
    role = "case k when 0 then 'logo' when 1 then 'banner' when 2 then 'mobile_banner' else 'extra' end"
    csha = d.sha(f"'media-' || {S('s_suppkey + 1')} || '-' || {S('k')}")
    t["collection_media"] = f"""
      select s_suppkey + 1 as collection_id, {role} as role,
        'https://images.example.org/' || {S('k')} || '/' || {S('s_suppkey + 1')} || '.png' as source_url,
        {csha} as sha256, {_content_key(COLLECTIONS_SNAPSHOT, 'collections/media', csha, "'png'")} as object_key,
        'image/png' as content_type, 100 + s_suppkey * 3 + k as byte_length,
        case (s_suppkey + k) % 6 when 0 then 'failed' when 1 then 'quarantined' else 'stored' end as status,
        case when (s_suppkey + k) % 6 >= 2 and (s_suppkey + k) % 7 <> 0 then 1 else 0 end as eligible_for_publish
      from $supplier {d.gen('cast(s_suppkey % 4 as int)', 'k')}"""
    t["collection_artists"] = f"""
      select 'artist-' || {S('s_suppkey + 1')} as artist_id, s_suppkey + 1 as collection_id, s_name as name,
        case when s_suppkey % 4 = 0 then null else 'a' || {S('s_suppkey')} || '.eth' end as ens
      from $supplier where s_suppkey % 3 = 0 or s_suppkey % 20 = 1"""
    t["collection_artist_drops"] = f"""
      select distinct 'artist-' || {S('l_suppkey - l_suppkey % 3 + 1')} as artist_id, l_partkey + 1 as drop_id
      from $lineitem where l_linenumber % 3 = 0"""
    t["collection_organizations"] = """
      select s_suppkey + 1000001 as organization_id, s_suppkey + 1 as collection_id, 'Org ' || s_name as name
      from $supplier where s_suppkey % 3 = 1"""
    t["verified_collections"] = """
      select s_suppkey + 1 as collection_id, s_suppkey + 1000002 as verified_by, '2024-02-01' as verified_on
      from $supplier where s_suppkey % 4 = 0"""
    t["featured_collections"] = """
      select s_suppkey + 1 as collection_id, '2024-03-01' as featured_on from $supplier where s_suppkey % 5 = 0"""
    t["suggested_drops"] = """
      select collection_id * 1000000000 + drop_id as suggestion_id, collection_id, drop_id,
        case when drop_id % 3 = 1 then 'approved' else 'pending' end as curation_status, '2023-06-01' as created_on
      from (select distinct l_suppkey + 1 as collection_id, l_partkey + 1 as drop_id from $lineitem where l_linenumber % 3 = 2) i"""
    dsha = d.sha(f"'card-' || {S('drop_id')}")
    t["drop_cards"] = f"""
      select drop_id, p_brand as fancy_id, case when drop_id % 34 = 0 then null else 'Card ' || p_name end as title,
        'card' as description, '2010-01-01' as start_date, '2010-01-02' as end_date,
        cast(2010 as int) as year, 'Wien' as city, 'Austria' as country, 'https://cards.example.org/' || {S('drop_id')} as event_url,
        'https://images.example.org/card/' || {S('drop_id')} as image_url,
        case drop_id % 5 when 0 then null when 1 then 'snapshots/{CATALOG_SNAPSHOT}/artwork/' || {S('drop_id')} || '.webp'
          when 2 then {_content_key(COLLECTIONS_SNAPSHOT, 'collections/drop-artwork', dsha, "'png'")}
          when 3 then 'snapshots/{CATALOG_SNAPSHOT}/artwork/' || {S('drop_id + 1')} || '.webp'
          else {_content_key('coll-0', 'collections/drop-artwork', dsha, "'png'")} end as image_object_key,
        case p_size % 3 when 0 then null when 1 then 0 else 1 end as is_virtual,
        case when drop_id % 17 = 0 then 'true' when drop_id % 19 = 0 then null else 'false' end as private_value,
        case when drop_id % 17 = 0 or drop_id % 19 = 0 then 1 else 0 end as is_private,
        case when drop_id % 23 = 0 then 1 else 0 end as is_hidden,
        case when drop_id % 9 = 0 then null else cast(p_size * 2 as bigint) end as token_count,
        cast(p_size as bigint) as transfer_count,
        case when drop_id % 3 = 0 then cast(p_size as bigint) end as email_claims_minted,
        case when drop_id % 3 = 0 and drop_id % 2 = 0 then cast(p_size + 1 as bigint) end as email_claims_reserved,
        case when drop_id % 3 = 0 then cast(2 * p_size + 1 as bigint) end as email_claims_total,
        case when drop_id % 25 = 0 then '2024-04-01' end as featured_on,
        case when drop_id % 6 = 0 then cast(p_size as bigint) end as moments_uploaded
      from (select *, p_partkey + 1 as drop_id from $part) p"""
    t["chain_stats"] = """
      select l_partkey + 1 as drop_id, case when l_returnflag = 'N' then null else l_returnflag end as chain,
        count(*) as token_count, cast(sum(cast(l_quantity as bigint)) as bigint) as transfer_count
      from $lineitem group by 1, 2"""
    t["email_claims"] = """
      select p_partkey + 1 as drop_id, cast(p_size as bigint) as minted, cast(p_size + 1 as bigint) as reserved,
        cast(2 * p_size + 1 as bigint) as total from $part where p_partkey % 3 = 0
      union all select 1000000000 + p_partkey, 1, 1, 2 from $part where p_partkey % 500 = 3
      union all select p_partkey + 1, 9, 9, 18 from $part where p_partkey % 300 = 6"""

    # Moments ------------------------------------------------------------------------------------
    t["moments"] = f"""
      select event_id + 1 as moment_id, case when event_id % 5 = 0 then null else 'd' || {S('event_id')} end as display_id,
        {_address(d, 'user_id', 'event_id % 2 = 0')} as author, {_address(d, 'user_id')} as author_address_norm,
        props as description, case when event_id % 3 = 0 then 'cid' || {S('event_id')} end as cid,
        case when event_id % 4 = 0 then {S('event_id * 3')} end as token_ref, {d.iso('ts')} as created_on,
        case when event_id % 6 = 0 then {d.iso('ts')} end as updated_on,
        case when event_id % 6 = 0 then 1 else 0 end as updated
      from $events"""
    n = "(select count(*) from $part)"
    e = "(select count(*) from $events)"
    t["moment_drops"] = f"""
      select event_id + 1 as moment_id, 1 + (event_id * 7) % {n} as drop_id from $events where event_id % 10 <> 0
      union
      select event_id + 1, 1 + (event_id * 13 + 5) % {n} from $events where event_id % 3 = 0 and event_id % 10 <> 0"""
    t["moment_hidden_drops"] = """
      select p_partkey + 1 as drop_id, case when p_partkey % 2 = 0 then '2024-01-01' end as hidden_on
      from $part where (p_partkey + 1) % 23 = 0"""
    t["generic_hidden_drops"] = """
      select p_partkey + 1 as drop_id, '2023-12-01' as hidden_on from $part where (p_partkey + 1) % 46 = 0 or (p_partkey + 1) % 47 = 0"""
    t["moment_visibility"] = """
      select event_id + 1 as moment_id, case when event_id % 31 = 0 then 0 else 1 end as is_public from $events where event_id % 37 <> 0"""
    t["moment_suppressions"] = """
      select event_id + 1 as moment_id, 'takedown' as reason_code, case when event_id % 82 = 0 then 0 else 1 end as active
      from $events where event_id % 41 = 0"""
    t["moment_links"] = f"""
      select event_id + 1 as link_id, 1 + (event_id * 17) % {e} as moment_id,
        case event_id % 4 when 0 then 'http://links.example.org/' || {S('event_id')} when 1 then 'javascript:x'
          else 'https://links.example.org/' || {S('event_id')} end as url, event_type as title
      from $events where event_type = 'view'"""
    t["moment_user_tags"] = f"""
      select event_id + 1 as tag_id, 1 + (event_id * 3) % {e} as moment_id, {_address(d, 'user_id', 'event_id % 2 = 0')} as address,
        {_address(d, 'user_id')} as address_norm, case when event_id % 3 = 0 then 'u' || {S('user_id')} || '.eth' end as ens
      from $events where event_type = 'click'"""
    t["capsules"] = f"""
      select event_id + 1 as capsule_id, 'x' || {S('event_id')} as external_id, {_address(d, 'user_id', 'event_id % 2 = 0')} as owner,
        {_address(d, 'user_id')} as owner_address_norm, case when event_id % 7 = 0 then null else 'Capsule ' || {S('event_id')} end as title,
        'https://capsules.example.org/' || {S('event_id')} as url, {d.iso('ts')} as created_on
      from $events where event_type = 'purchase'"""
    t["capsule_moments"] = f"""
      select event_id + 1 as capsule_id, 1 + (event_id * 5) % {e} as moment_id from $events where event_type = 'purchase'
      union
      select event_id + 1, 1 + (event_id * 11) % {e} from $events where event_type = 'purchase' and event_id % 2 = 0"""
    t["capsule_visibility"] = """
      select event_id + 1 as capsule_id, case when event_id % 17 = 0 then 0 else 1 end as is_public
      from $events where event_type = 'purchase' and event_id % 19 <> 0"""
    t["capsule_suppressions"] = """
      select event_id + 1 as capsule_id, case when event_id % 106 = 0 then 0 else 1 end as active
      from $events where event_type = 'purchase' and event_id % 53 = 0"""
    mime = "case lang when 'en' then 'image/png' when 'de' then 'image/jpg; q=1' when 'fr' then 'video/mp4' end"
    norm_mime = "case lang when 'en' then 'image/png' when 'de' then 'image/jpeg' when 'fr' then 'video/mp4' end"
    ext = "case lang when 'en' then 'png' when 'de' then 'jpg' when 'fr' then 'mp4' end"
    t["moment_media"] = f"""
      select {_uuid(d, 'doc_id')} as media_key, case when doc_id % 11 = 0 then null else 1 + doc_id % {e} end as moment_id,
        {mime} as mime_type, {d.sha('text')} as source_hash,
        case when doc_id % 9 = 0 then 'INVALID' else 'PROCESSED' end as source_status,
        case when doc_id % 37 = 1 then 'mystery' else case doc_id % 6 when 0 then 'public_stored' when 1 then 'public'
          when 2 then 'private' when 3 then 'oversize' when 4 then 'source_missing' else 'public_stored' end end as raw_status,
        {d.sha('text')} as archive_sha256, {norm_mime} as archive_content_type, n_chars as byte_length,
        case when doc_id % 13 = 0 then 'snapshots/{MOMENTS_SNAPSHOT}/moments/original/sha256/00/bad.png'
          else {_content_key(MOMENTS_SNAPSHOT, 'moments/original', d.sha('text'), ext)} end as object_key,
        cast(100 + doc_id % 7 as bigint) as width, cast(50 + doc_id % 5 as bigint) as height,
        case when lang = 'fr' then cast(1000 + doc_id % 100 as bigint) end as duration_ms,
        '2024-01-' || lpad({S('1 + doc_id % 28')}, 2, '0') || 'T00:00:00.000Z' as created_at, cast(doc_id % 3 as int) as position, doc_id
      from $documents"""
    url = (
        "case k when 0 then 'https://origin.example.org/' || {u} when 1 then 'https://origin.example.org/' || {u} "
        "when 2 then 'https://thumbs.example.org/thumbnails/' || {u} || '.webp' "
        "when 3 then 'https://hls.example.org/' || {u} || '/' || {u} || '.m3u8' "
        "when 4 then 'https://legacy.example.org/file-' || {n} else 'https://origin.example.org/' || {u} || '?v=1' end"
    ).format(u=_uuid(d, "doc_id"), n=S("doc_id"))
    t["gateways"] = f"""
      select {_uuid(d, 'doc_id')} || '-' || {S('k')} as gateway_id, {_uuid(d, 'doc_id')} as media_key, {url} as url,
        case k when 0 then {mime} when 1 then 'image/gif' when 2 then 'image/webp' when 4 then 'image/JPG;x=y' end as type,
        '{{"size":' || {S('case when doc_id % 8 = 0 then 0 else n_chars end')} || '}}' as metadata
      from $documents {d.gen('5', 'k')}
      where (k = 0 and doc_id % 4 <> 3) or (k = 1 and doc_id % 6 = 0) or (k = 2 and doc_id % 3 = 0)
        or (k = 3 and lang = 'fr') or (k = 4 and doc_id % 10 = 7) or (k = 5 and doc_id % 5 = 0)"""
    # Two capture records per media: a first failure, then a final result.
    t["capture_log"] = f"""
      select media_key, seq, status, target,
        case when target is not null then {_content_key(MOMENTS_SNAPSHOT, "moments/' || case when target = 'public' then '' else 'private/' end || 'original", 'sha', 'ext')} end as object_key,
        case when target is not null then sha end as sha256, case when target is not null then n_chars end as byte_length,
        case when target is not null then mime end as content_type,
        case when status = 'failed' then case when http_status is null then 'NETWORK_ERROR' else 'SOURCE_HTTP_ERROR' end end as error_code,
        case when status = 'failed' then http_status end as http_status
      from (
        select *, case when status in ('failed', 'oversize', 'source_missing') then null
                       when status = 'public_stored' then 'public' else 'private' end as target
        from (
          select {_uuid(d, 'doc_id')} as media_key, k + 1 as seq, n_chars, {d.sha('text')} as sha,
            coalesce({ext}, 'bin') as ext, coalesce({norm_mime}, 'application/octet-stream') as mime,
            case doc_id % 5 when 0 then 403 when 1 then 404 when 2 then 500 end as http_status,
            case when k = 0 then 'failed' when doc_id % 7 = 0 then 'failed' when doc_id % 7 = 1 then 'oversize'
                 when doc_id % 4 = 3 then 'source_missing' when doc_id % 7 = 2 then 'quarantined_stored'
                 when doc_id % 7 in (3, 4) then 'private_stored' else 'public_stored' end as status
          from $documents {d.gen('1', 'k')}) a) b"""
    t["recovery_log"] = f"""
      select {_uuid(d, 'doc_id')} as media_key, 1 as seq,
        case doc_id % 4 when 0 then 'original_stored' when 1 then 'derivative_stored' when 2 then 'metadata_only' else 'failed' end as status,
        case when doc_id % 4 = 0 then case when doc_id % 8 = 0 then 'public' else 'private' end end as target,
        case when doc_id % 4 = 0 and doc_id % 3 = 0 then 1 else 0 end as quarantined,
        case doc_id % 4 when 0 then 'retry_primary' when 1 then 'thumbnail_derivative' when 2 then 'metadata_only' end as strategy,
        case when doc_id % 4 = 0 then {_content_key(MOMENTS_SNAPSHOT, 'moments/original', d.sha('text'), f"coalesce({ext}, 'bin')")} end as object_key,
        case when doc_id % 4 = 0 then {d.sha('text')} end as sha256, case when doc_id % 4 = 0 then n_chars end as byte_length,
        case when doc_id % 4 = 0 then coalesce({norm_mime}, 'application/octet-stream') end as content_type
      from $documents where doc_id % 7 in (0, 1) or doc_id % 4 = 3"""
    # A second capture of the documents with known removals and changes.
    t["snapshot_a"] = f"select doc_id, {d.sha('text')} as digest, lang, source, n_chars from $documents"
    t["snapshot_b"] = f"""
      select doc_id, {d.sha("case when doc_id % 100 = 5 then text || '!' else text end")} as digest, lang, source, n_chars
      from $documents where doc_id % 100 <> 3"""
    return t


_REF = re.compile(r"\$(\w+)")


class Archive:
    """Lazy domain tables over one data folder; every attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    @cached_property
    def _definitions(self) -> dict[str, str]:
        return definitions(SparkDialect())

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._tables:
            if name in DRIVER_TABLES:
                self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in self._definitions:
                text = self._definitions[name]
                refs = sorted(set(_REF.findall(text)))
                text = text.replace("{", "{{").replace("}", "}}")
                text = _REF.sub(lambda m: "{" + m.group(1) + "}", text)
                self._tables[name] = self.spark.sql(text, **{r: getattr(self, r) for r in refs})
            else:
                raise AttributeError(name)
        return self._tables[name]


_DUCK = definitions(DuckDialect())


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """Render `$name` references in DuckDB SQL as CTEs, dependencies first."""
    known = {**_DUCK, **(extra or {})}
    ordered: dict[str, str] = {}

    def visit(text: str) -> str:
        for name in dict.fromkeys(_REF.findall(text)):
            if name in known and name not in ordered:
                body = visit(known[name])
                ordered.setdefault(name, body)
        return _REF.sub(lambda m: m.group(1), text)

    main = visit(sql)
    if not ordered:
        return main.strip()
    ctes = ",\n".join(f"{name} as ({body.strip()})" for name, body in ordered.items())
    return f"with recursive {ctes}\n{main.strip()}"
