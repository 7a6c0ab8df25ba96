"""E and J-18..J-24: media planning and proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domain import CATALOG_SNAPSHOT, MEDIA_BASE, MOMENTS_SNAPSHOT
from ..functions import rules as R
from ..operators import browse as B
from ..operators import media as M
from ..operators import publication as P
from ..operators import relations as J
from .registry import query
from .sqltext import STATUS_SQL

HOSTS = R.MediaHosts()
ART_HOSTS = M.ArtworkHosts()
NORM = "nullif(case when lower(trim(split_part({0}, ';', 1))) = 'image/jpg' then 'image/jpeg' else lower(trim(split_part({0}, ';', 1))) end, '')".format
NEEDS = "(l.status in ('failed', 'oversize', 'source_missing') or (p.public_eligible = 1 and l.status <> 'public_stored'))"
RETRY = "(status = 'failed' and not (error_code = 'SOURCE_HTTP_ERROR' and http_status is not null and http_status in (403, 404, 410)))"
STORED = "('public_stored', 'private_stored', 'quarantined_stored')"
SQL = {
    "labelled": """select *, case when url = 'https://origin.example.org/' || media_key then 'original'
      when url = 'https://thumbs.example.org/thumbnails/' || media_key || '.webp' then 'thumbnail'
      when url = 'https://hls.example.org/' || media_key || '/' || media_key || '.m3u8' then 'hls'
      when regexp_matches(url, '^https://legacy[.]example[.]org/[A-Za-z0-9._-]{1,500}$') then 'legacy' else 'other' end as label from $gateways""",
    "choice": """select media_key, min(case when label = 'original' then gateway_id end) as original, count(*) filter (where label = 'original') as originals,
      min(case when label = 'thumbnail' then gateway_id end) as thumbnail, min(case when label = 'hls' then gateway_id end) as hls,
      min(case when label = 'legacy' then gateway_id end) as legacy from $labelled group by media_key""",
    "scope": """select l.moment_id, max(case when h.drop_id is null then 0 else 1 end) as hidden from $moment_drops l
      left join $moment_hidden_drops h on h.drop_id = l.drop_id group by l.moment_id""",
    "media_plan": f"""select media_key, moment_id, gateway_id, source_url, declared_content_type, case when size > 0 then size end as declared_byte_length, source_status,
        eligibility, case when eligibility = 'public' then 1 else 0 end as public_eligible,
        case when gateway_id is not null then case when eligibility = 'public' then 'public' else 'private' end end as target, greatest(coalesce(originals, 0) - 1, 0) as alternates
      from (select m.media_key, m.moment_id, c.original as gateway_id, g.url as source_url, {NORM('coalesce(g.type, m.mime_type)')} as declared_content_type,
        json_extract_string(g.metadata, '$.size')::bigint as size, m.source_status, c.originals,
        case when mo.moment_id is null then 'orphan_media' when m.source_status <> 'PROCESSED' then 'source_not_processed' when s.hidden is null then 'moment_without_drop'
          when s.hidden = 1 then 'hidden_drop' else 'public' end as eligibility
      from $moment_media m left join $moments mo on mo.moment_id = m.moment_id left join $scope s on s.moment_id = m.moment_id
      left join $choice c on c.media_key = m.media_key left join $gateways g on g.gateway_id = c.original) x""",
    "captured": "select * from $capture_log where seq = 2",
    "members": f"""select m.source_hash, m.media_key, c.original as gateway_id, case when l.sha256 = m.source_hash and l.status in {STORED} then l.object_key end as preserved_key
      from $moment_media m join $choice c on c.media_key = m.media_key and c.original is not null left join $captured l on l.media_key = m.media_key""",
    "aliases": """select m.media_key, m.source_hash, count(*) as aliases, min(x.media_key) as first_alias, count(x.preserved_key) as preserved
      from $moment_media m join $members x on x.source_hash = m.source_hash and x.media_key <> m.media_key group by 1, 2""",
    "need": f"""select l.media_key, l.status, l.error_code, l.http_status, p.public_eligible, p.source_status, c.original, c.thumbnail, c.hls, c.legacy, a.first_alias,
        case when p.public_eligible = 1 or p.target = 'public' then 'public' else 'private' end as target
      from $captured l join $media_plan p on p.media_key = l.media_key left join $choice c on c.media_key = l.media_key
      left join $aliases a on a.media_key = l.media_key where {NEEDS}""",
    "found": f"""select media_key, 1 as ord, 'retry_primary' as kind, 'original' as fidelity, target, original as gateway_id, null::varchar as reason from $need where original is not null and {RETRY}
      union all select media_key, 2, 'multipart_original', 'original', target, original, null from $need where original is not null and status = 'oversize'
      union all select media_key, 3, 'hash_alias_original', 'original', target, first_alias, null from $need where http_status = 403 and first_alias is not null
      union all select media_key, 4, 'legacy_original', 'original', target, legacy, null from $need where status = 'source_missing' and legacy is not null
      union all select media_key, 5, 'thumbnail_derivative', 'derivative', 'private', thumbnail, null from $need where thumbnail is not null and (status = 'source_missing' or coalesce(http_status, 0) in (403, 404, 410))
      union all select media_key, 6, 'hls_derivative', 'derivative', 'private', hls, null from $need where hls is not null and (status in ('oversize', 'source_missing') or coalesce(http_status, 0) in (403, 404, 410))""",
    "strategies": f"""select media_key, row_number() over (partition by media_key order by ord) as position, kind, fidelity, target, gateway_id, reason from $found
      union all select media_key, 1, case when target = 'public' then 'public_original_required' when {RETRY} then 'private_recovery_required' else 'metadata_only' end, 'none',
        case when target = 'public' then 'public' else 'private' end, null,
        case when target <> 'public' and {RETRY} then 'retryable_source_without_fixed_candidate' when source_status = 'INVALID' then 'invalid_media_without_recoverable_gateway' else 'no_fixed_recovery_candidate' end
      from $need where media_key not in (select media_key from $found)""",
    "manifest": f"""select media_key, public_eligible,
        case when use_rec then case when r_target = 'public' then r_key end when c_status = 'public_stored' then c_key end as object_key,
        case when use_rec then r_sha when not blank then c_sha end as sha256, case when use_rec then r_bytes when not blank then c_bytes end as byte_length,
        case when use_rec then r_type when not blank then c_type end as content_type,
        case when terminal then c_status when use_rec then case when r_target = 'public' then 'public_stored' when quarantined = 1 then 'quarantined_stored' else 'private_stored' end
          when stored then c_status when blank then 'source_missing' else coalesce(c_status, 'unattempted') end as status,
        case when needs and not terminal and not (case when is_public then coalesce(r_status = 'original_stored' and r_target = 'public' and quarantined <> 1, false)
          else coalesce(r_status in ('original_stored', 'derivative_stored', 'metadata_only'), false) end) then 1 else 0 end as unresolved
      from (select *, stored and (not is_public or c_status = 'public_stored') as terminal,
          not (stored and (not is_public or c_status = 'public_stored')) and coalesce(r_status = 'original_stored', false) as use_rec,
          not stored and coalesce(r_status in ('derivative_stored', 'metadata_only'), false) and needs as blank
        from (select p.media_key, p.public_eligible, p.public_eligible = 1 or coalesce(p.target, '') = 'public' as is_public, l.status in {STORED} as stored, {NEEDS} as needs,
          l.status as c_status, l.object_key as c_key, l.sha256 as c_sha, l.byte_length as c_bytes, l.content_type as c_type,
          r.status as r_status, r.target as r_target, r.quarantined, r.object_key as r_key, r.sha256 as r_sha, r.byte_length as r_bytes, r.content_type as r_type
          from $media_plan p join $captured l on l.media_key = p.media_key left join $recovery_log r on r.media_key = p.media_key) x) y""",
}


def choices(a):
    return M.gateway_choices(a.gateways, HOSTS)


def media_plan(a):
    return M.media_plan(a.moment_media, a.moments, P.drop_scope(a.moment_drops, a.moment_hidden_drops), a.gateways, HOSTS)


def captured(a):
    return M.latest(a.capture_log)


def members(a):
    return M.alias_members(a.moment_media, choices(a), captured(a))


def recovery(a):
    return M.recovery_strategies(media_plan(a), captured(a), choices(a), M.alias_summary(a.moment_media, members(a)))


def manifest(a):
    return M.effective_manifest(media_plan(a), captured(a), M.latest(a.recovery_log))


SIGNATURES = {"en": "89504e470d0a1a0a", "de": "ffd8ffe0", "fr": "00000018667479706d703432", "es": "524946460000000057454250"}
DETECTED = {"en": "image/png", "de": "image/jpeg", "fr": "video/mp4", "es": "image/webp"}


@query("e01_signature_detection", f"""
  select lang, declared, detected, case when declared is null or declared = detected then 1 else 0 end as compatible, count(*) as n from (
    select lang, {NORM("case lang when 'en' then 'image/png' when 'de' then 'image/jpg; q=1' when 'fr' then 'video/webm' end")} as declared,
      case when doc_id % 10 = 0 then null {' '.join(f"when lang = '{k}' then '{v}'" for k, v in DETECTED.items())} end as detected from $documents) x group by all""".replace("$documents", "documents"))
def _(a):
    prefix = F.create_map(*[F.unhex(F.lit(v)) if i else F.lit(k) for k, v in SIGNATURES.items() for i in (0, 1)])[F.col("lang")]
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(F.unhex(F.lit("0a0a0a0a0a0a0a0a")), body)).otherwise(F.concat(prefix, body))
    declared = F.when(F.col("lang") == "en", "image/png").when(F.col("lang") == "de", "image/jpg; q=1").when(F.col("lang") == "fr", "video/webm")
    rows = a.documents.select("lang", declared.alias("declared_raw"), M.detect_type(content, declared).alias("detected"))
    ok = R.flag(M.type_compatible(F.col("declared_raw"), F.col("detected")))
    return rows.groupBy("lang", R.content_type(F.col("declared_raw")).alias("declared"), "detected", ok.alias("compatible")).agg(F.count("*").alias("n"))


@query("e02_media_plan", "select * from $media_plan", SQL)
def _(a):
    return media_plan(a)


@query("e03_plan_counts", """
  select count(*) as planned, count(source_url) as source_available, count(*) filter (where source_url is null) as source_missing, count(*) filter (where target = 'public') as public,
    count(*) filter (where target = 'private') as private, sum(alternates)::bigint as alternates from $media_plan""", SQL)
def _(a):
    return M.plan_counts(media_plan(a))


@query("e04_latest_capture", "select * from $capture_log qualify row_number() over (partition by media_key order by seq desc) = 1")
def _(a):
    return captured(a)


@query("e05_capture_audit", f"""
  select rule, 'capture_log' as entity, media_key || ':' || seq as key, '' as detail from (
    select l.*, case when status in {STORED} and not coalesce((status = 'public_stored' and p.public_eligible = 1 and p.target = 'public' and l.target = 'public')
      or (status = 'private_stored' and p.public_eligible = 0 and coalesce(p.target, '') <> 'public' and l.target = 'private')
      or (status = 'quarantined_stored' and p.public_eligible = 1 and p.target = 'public' and l.target = 'private'), false) then 'routing_invalid' end as rule
    from $capture_log l join $media_plan p on p.media_key = l.media_key) x where rule is not null""", SQL)
def _(a):
    return M.capture_audit(a.capture_log, media_plan(a), MOMENTS_SNAPSHOT)


@query("e06_plan_coverage", """
  select media_key, 'left_only' as side from $moment_media where doc_id % 50 = 4 union all
  select media_key, 'right_only' from $moment_media where doc_id % 60 = 5 and doc_id % 50 <> 4""")
def _(a):
    plan = media_plan(a)
    lost = a.moment_media.where("doc_id % 60 = 5 and doc_id % 50 <> 4").select("media_key")
    left = plan.join(lost, "media_key", "left_anti")
    return J.one_sided(left, a.moment_media.where("doc_id % 50 <> 4"), ["media_key"])


@query("e07_recovery_needs", f"""
  select l.media_key, l.status, case when {NEEDS} then 1 else 0 end as needs_recovery, case when {RETRY} then 1 else 0 end as requires_retry
  from $captured l join $media_plan p on p.media_key = l.media_key""".replace(RETRY, RETRY.replace("status =", "l.status =", 1)), SQL)
def _(a):
    rows = captured(a).join(media_plan(a).select("media_key", "public_eligible"), "media_key")
    return rows.select("media_key", "status", R.flag(M.needs_recovery(F.col("status"), F.col("public_eligible"))).alias("needs_recovery"),
                       R.flag(M.requires_retry(F.col("status"), F.col("error_code"), F.col("http_status"))).alias("requires_retry"))


@query("j18_hash_aliases", "select media_key, source_hash, aliases, first_alias, preserved from $aliases", SQL)
def _(a):
    return M.alias_summary(a.moment_media, members(a))


@query("j18_alias_members", "select source_hash, media_key, gateway_id, preserved_key from $members", SQL)
def _(a):
    return members(a)


@query("e08_recovery_strategies", "select media_key, position, kind, fidelity, target, gateway_id, reason from $strategies", SQL)
def _(a):
    rows = recovery(a).select("media_key", F.posexplode("strategies").alias("position", "s"))
    return rows.select("media_key", (F.col("position") + 1).alias("position"), "s.*")


@query("e08_strategy_candidates", """
  select s.media_key, s.kind, coalesce(l.rank, 0) as rank, coalesce(l.gateway_id, s.gateway_id) as gateway_id, case when s.kind = 'legacy_original' then l.url else g.url end as source_url,
    case when s.fidelity = 'original' then m.source_hash end as required_sha256
  from $strategies s left join (select *, row_number() over (partition by media_key order by gateway_id) - 1 as rank from $labelled where label = 'legacy') l
      on l.media_key = s.media_key and s.kind = 'legacy_original'
    left join $labelled g on g.media_key = s.media_key and g.gateway_id = s.gateway_id left join $moment_media m on m.media_key = s.media_key
  where s.gateway_id is not null""", SQL)
def _(a):
    return M.strategy_candidates(recovery(a), a.gateways, a.moment_media, HOSTS)


@query("g15_strategy_histogram", """
  select k.kind, count(s.media_key) as n from (values ('retry_primary'), ('multipart_original'), ('hash_alias_original'), ('legacy_original'), ('thumbnail_derivative'),
    ('hls_derivative'), ('public_original_required'), ('private_recovery_required'), ('metadata_only')) k(kind) left join $strategies s on s.kind = k.kind group by k.kind""", SQL)
def _(a):
    from ..operators.aggregates import zero_filled

    kinds = ("retry_primary", "multipart_original", "hash_alias_original", "legacy_original", "thumbnail_derivative", "hls_derivative",
             "public_original_required", "private_recovery_required", "metadata_only")
    return zero_filled(recovery(a).select(F.explode("strategies.kind").alias("kind")), "kind", kinds)


@query("e09_effective_manifest", "select * from $manifest", SQL)
def _(a):
    return manifest(a)


@query("e10_completeness", """
  select count(*) filter (where unresolved = 1) as unresolved,
    case when count(*) filter (where unresolved = 1) = 0 and count(*) filter (where public_eligible = 1 and status <> 'public_stored') = 0 then 1 else 0 end as projection_ready,
    case when count(*) filter (where unresolved = 1) = 0 and count(*) filter (where status in ('failed', 'oversize', 'unattempted')) = 0 then 1 else 0 end as complete from $manifest""", SQL)
def _(a):
    return M.completeness(manifest(a))


@query("e11_stored_objects", f"""
  select target, object_key, min(sha256) as sha256, min(byte_length) as byte_length, count(*) as "references",
    case when count(distinct byte_length) > 1 or count(distinct content_type) > 1 then 1 else 0 end as conflict
  from $e11_rows group by target, object_key""", {**SQL, "e11_rows": f"""select target, object_key, sha256, content_type,
    case when media_key like '%5' then byte_length + 1 else byte_length end as byte_length from $captured where status in {STORED}"""})
def _(a):
    rows = captured(a).where(F.col("status").isin(*R.STORED_STATUSES))
    tampered = F.when(F.col("media_key").endswith("5"), F.col("byte_length") + 1).otherwise(F.col("byte_length"))
    return M.stored_objects(rows.withColumn("byte_length", tampered))


ACTIONS = """
  select drop_id, case when drop_id in (select drop_id from $artwork_files where state = 'ok') then 'archive'
    when drop_id in (select drop_id from $holding_drops where image_object_key is not null) then 'seed'
    when drop_id in (select drop_id from $drop_cards where image_object_key is not null) then 'collection-reuse' else 'capture' end as action
  from (select distinct drop_id from $tokens) t"""


def actions(a):
    return M.artwork_actions(a.tokens.select("drop_id").distinct(), a.artwork_files.where("state = 'ok'"),
                             a.holding_drops.where("image_object_key is not null"), a.drop_cards.where("image_object_key is not null"))


@query("e12_artwork_actions", ACTIONS)
def _(a):
    return actions(a)


_U = "https://assets.example.org/a/"
RAW = f"""select d as drop_id, case d % 3 when 0 then null when 1 then '{{"drop_image":{{"gateways":[{{"id":"g1","type":"ORIGINAL","url":"{_U}' || d || '.png"}},{{"id":"g2","type":"THUMB","url":"{_U}t.png"}}]}}}}'
    else '{{"drop_image":{{"gateways":[{{"id":"g1","type":"ORIGINAL","url":"{_U}' || d || '.png?x=1"}},{{"id":"g3","type":"ORIGINAL","url":"{_U}b' || d || '.png"}}]}}}}' end as raw_json,
  case d % 4 when 0 then null when 1 then '{_U}' || d || '.png' when 2 then 'https://storage.example.org/media/a/' || d || '.png' else 'http://assets.example.org/a/' || d || '.png' end as source_url
  from (select p_partkey + 1 as d from {{part}}) p"""
_S = "https://storage.example.org/media/a/"
CAND = f"""select d as drop_id, pos, url from (
    select d, 1 as pos, '{_U}' || d || '.png' as url from $ids where d % 3 = 1 union all select d, 2, '{_S}' || d || '.png' from $ids where d % 3 = 1
    union all select d, 3, '{_U}b' || d || '.png' from $ids where d % 3 = 2 union all select d, 4, '{_S}b' || d || '.png' from $ids where d % 3 = 2
    union all select d, 5, '{_S}' || d || '.png' from $ids where d % 4 = 1 union all select d, 6, '{_U}' || d || '.png' from $ids where d % 4 = 1
    union all select d, 6, '{_S}' || d || '.png' from $ids where d % 4 = 2) x qualify row_number() over (partition by d, url order by pos) = 1"""
CAND_SQL = {"ids": "select p_partkey + 1 as d from part", "cand": CAND}


def raw_drop_json(a):
    return a.spark.sql(RAW.replace("{part}", "PART").replace("{", "{{").replace("}", "}}").replace("PART", "{part}"), part=a.part)


@query("e13_source_candidates", """
  select i.d as drop_id, coalesce(string_agg(c.url, ' ' order by c.pos), '') as candidates from $ids i left join $cand c on c.drop_id = i.d group by i.d""", CAND_SQL)
def _(a):
    rows = raw_drop_json(a)
    return rows.select("drop_id", F.array_join(M.source_candidates(F.col("raw_json"), F.col("source_url"), ART_HOSTS), " ").alias("candidates"))


def unavailable(a):
    rows = raw_drop_json(a).select("drop_id", M.source_candidates(F.col("raw_json"), F.col("source_url"), ART_HOSTS).alias("candidates"))
    code = F.when(F.col("drop_id") % 5 == 0, "NETWORK_ERROR").otherwise("SOURCE_HTTP_ERROR")
    attempts = F.transform("candidates", lambda u: F.struct(u.alias("url"), code.alias("code"), F.lit(404).alias("http")))
    tried = rows.withColumn("attempts", F.when(F.col("drop_id") % 7 == 0, F.slice(attempts, 1, 1)).otherwise(attempts))
    status = F.when(F.col("drop_id") % 6 == 0, "stored").otherwise("failed")
    return tried.select("drop_id", R.flag(M.terminal_unavailable(status, F.col("candidates"), F.col("attempts"))).alias("terminal"))


TERMINAL = """select i.d as drop_id, case when i.d % 6 = 0 then 0 when count(c.url) = 0 then 1 when i.d % 5 = 0 then 0 when i.d % 7 = 0 and count(c.url) > 1 then 0 else 1 end as terminal
  from $ids i left join $cand c on c.drop_id = i.d group by i.d"""


@query("e14_terminal_unavailable", TERMINAL, CAND_SQL)
def _(a):
    return unavailable(a)


@query("e15_release_coverage", """
  select count(*) as referenced, count(*) filter (where action = 'archive') as archive_direct, count(*) filter (where action = 'collection-reuse') as reuse,
    count(*) filter (where action = 'seed') as seed, count(*) filter (where action = 'capture' and terminal = 0) as captured, count(*) filter (where action = 'capture' and terminal = 1) as unavailable, 1 as complete
  from $actions a join $terminal t on t.drop_id = a.drop_id""", {**CAND_SQL, "actions": ACTIONS, "terminal": TERMINAL})
def _(a):
    rows = actions(a).join(unavailable(a), "drop_id", "left")
    c = F.col
    counts = rows.agg(
        F.count("*").alias("referenced"), F.count_if(c("action") == "archive").alias("archive_direct"), F.count_if(c("action") == "collection-reuse").alias("reuse"),
        F.count_if(c("action") == "seed").alias("seed"), F.count_if((c("action") == "capture") & (c("terminal") == 0)).alias("captured"),
        F.count_if((c("action") == "capture") & (c("terminal") == 1)).alias("unavailable"))
    total = c("archive_direct") + c("reuse") + c("seed") + c("captured") + c("unavailable")
    return counts.withColumn("complete", R.flag(total == c("referenced")))


@query("e19_publication_plan", """
  select key, min(kind) as kind, case min(kind) when 'archive-drop-artwork' then 'reuse' else 'upload' end as disposition, min(sha256) as sha256,
    min_by(byte_length, kind) as byte_length, case when count(distinct kind || byte_length) > 1 then 1 else 0 end as conflict from (
    select 'collection-media' as kind, object_key as key, sha256, byte_length from $collection_media where eligible_for_publish = 1
    union all select 'archive-drop-artwork', 'art/' || drop_id, sha256, byte_length from $artwork_files where state = 'ok'
    union all select 'collection-drop-artwork', case when drop_id % 10 = 0 then 'art/' else 'new/' end || drop_id, sha256, byte_length from $artwork_files) x group by key""")
def _(a):
    media = a.collection_media.where("eligible_for_publish = 1").withColumnRenamed("object_key", "key")
    text = F.col("drop_id").cast("string")
    reused = a.artwork_files.where("state = 'ok'").withColumn("key", F.concat(F.lit("art/"), text))
    stored = a.artwork_files.withColumn("key", F.concat(F.when(F.col("drop_id") % 10 == 0, "art/").otherwise("new/"), text))
    return M.publication_plan({"collection-media": (media, "upload"), "archive-drop-artwork": (reused, "reuse"), "collection-drop-artwork": (stored, "upload")})


@query("e20_artwork_references", """
  select d.drop_id, case when d.has_artwork = 1 then 'reused' else coalesce(case f.state when 'ok' then 'stored' when 'duplicate' then 'quarantined' when 'invalid_signature' then 'failed' end, 'pending') end as status
  from $drops_base d left join $artwork_files f on f.drop_id = d.drop_id""")
def _(a):
    plan = a.drops_base.select("drop_id", F.when(F.col("has_artwork") == 1, F.lit("key")).alias("reuse_key"))
    status = F.when(F.col("state") == "ok", "stored").when(F.col("state") == "duplicate", "quarantined").otherwise("failed")
    return M.artwork_references(plan, a.artwork_files.select("drop_id", status.alias("status")))


@query("e21_gateway_candidates", f"""
  select d as drop_id, case when d % 3 = 0 then coalesce(s, '') when d % 3 = 1 then '{_U}' || d || '.png' || case when s is not null and d % 4 <> 1 then ' ' || s else '' end
    else '{_U}' || d || '.png?x=1 {_U}b' || d || '.png' || case when s is not null then ' ' || s else '' end end as candidates
  from (select d, case d % 4 when 0 then null when 1 then '{_U}' || d || '.png' when 2 then '{_S}' || d || '.png' else 'http://assets.example.org/a/' || d || '.png' end as s from $ids) x""", CAND_SQL)
def _(a):
    return raw_drop_json(a).select("drop_id", F.array_join(M.gateway_candidates(F.col("raw_json"), F.col("source_url")), " ").alias("candidates"))


@query("e23_archive_object_manifest", f"""
  select f.drop_id, 'snapshots/{CATALOG_SNAPSHOT}/artwork/' || f.drop_id || '.webp' as object_key, '{MEDIA_BASE}/snapshots/{CATALOG_SNAPSHOT}/artwork/' || f.drop_id || '.webp' as public_url,
    case when d.drop_id is null then 0 else 1 end as catalog_exists, case when d.drop_id is not null and f.state = 'ok' then 1 else 0 end as eligible
  from $artwork_files f left join $drops_base d on d.drop_id = f.drop_id""")
def _(a):
    return M.archive_objects(a.artwork_files, a.drops_base, CATALOG_SNAPSHOT, MEDIA_BASE)


@query("e24_recovery_plan_coverage", f"""
  select case when n.media_key is null then 'recovery_extra' when n.media_key like '%7' then 'recovery_missing' else 'recovery_differs' end as rule, 'recovery_plan' as entity, l.media_key as key,
    case when n.media_key is not null and n.media_key not like '%7' then 'http_status' else '' end as detail
  from $captured l left join $need n on n.media_key = l.media_key
  where (n.media_key is null and l.media_key like '%a1') or n.media_key like '%7' or (n.media_key like '%b' and n.http_status is not null)""", SQL)
def _(a):
    c = F.col
    rows = captured(a)
    need = rows.join(media_plan(a).select("media_key", "public_eligible"), "media_key").withColumn("_n", M.needs_recovery(c("status"), c("public_eligible")))
    kept = need.where((c("_n") & ~c("media_key").endswith("7")) | (~c("_n") & c("media_key").endswith("a1")))
    tampered = kept.withColumn("http_status", F.when(c("media_key").endswith("b"), c("http_status") + 1).otherwise(c("http_status")))
    return M.recovery_coverage(media_plan(a), rows, tampered, ["status", "error_code", "http_status"])


@query("e25_recovery_audit", f"""
  select rule, 'recovery_log' as entity, media_key as key, coalesce(strategy, '') as detail from (
    select r.*, case when n.media_key is null then 'unplanned'
      when r.status = 'original_stored' and (coalesce(s.fidelity, '') <> 'original' or (r.target = 'public' and (n.target <> 'public' or r.quarantined = 1)) or (r.target = 'private' and n.target = 'public' and r.quarantined <> 1)) then 'original_invalid'
      when r.status = 'derivative_stored' and coalesce(s.fidelity, '') <> 'derivative' then 'derivative_invalid'
      when r.status = 'metadata_only' and (n.target = 'public' or coalesce(s.kind, '') <> 'metadata_only') then 'metadata_invalid' end as rule
    from $recovery_log r left join $need n on n.media_key = r.media_key left join $strategies s on s.media_key = r.media_key and s.kind = r.strategy) x where rule is not null""", SQL)
def _(a):
    rows = M.recovery_audit(M.latest(a.recovery_log), media_plan(a), recovery(a))
    return rows.withColumn("detail", F.coalesce("detail", F.lit("")))


BRAND = """select collection_id || ':' || role as reference_id, collection_id, source_url from (
    select collection_id, 'logo' as role, logo_image_url as source_url from $collections union all select collection_id, 'banner', banner_image_url from $collections) x
  where source_url is not null and source_url <> ''"""


@query("e26_branding_audit", """
  select rule, 'branding' as entity, reference_id as key, '' as detail from (
    select reference_id, 'record_missing' as rule from $brand where collection_id % 9 = 0
    union all select reference_id, 'reference_mismatch' from $brand where collection_id % 9 <> 0 and collection_id % 8 = 0
    union all select reference_id, 'status_invalid' from $brand where collection_id % 9 <> 0 and collection_id % 7 = 0
    union all select reference_id, 'object_metadata_invalid' from $brand where collection_id % 9 <> 0 and collection_id % 7 <> 0 and collection_id % 5 = 0
    union all select collection_id || ':poster', 'record_unexpected' from $collections where collection_id % 30 = 0) y""", {"brand": BRAND})
def _(a):
    refs = B.unpivot_branding(a.collections)
    c = F.col
    kept = refs.where("collection_id % 9 <> 0")
    final = kept.select(
        "reference_id", F.lit(2).alias("seq"), F.when(c("collection_id") % 8 == 0, "https://changed.example.org/").otherwise(c("source_url")).alias("source_url"),
        F.when(c("collection_id") % 7 == 0, "unheard").otherwise("stored").alias("status"),
        F.when(c("collection_id") % 5 != 0, F.sha2(c("source_url"), 256)).alias("sha256"))
    first = final.withColumn("seq", F.lit(1)).withColumn("status", F.lit("failed"))
    extra = a.collections.where("collection_id % 30 = 0").select(
        F.concat(c("collection_id").cast("string"), F.lit(":poster")).alias("reference_id"), F.lit(1).alias("seq"), F.lit("x").alias("source_url"),
        F.lit("failed").alias("status"), F.lit(None).cast("string").alias("sha256"))
    return M.branding_audit(refs, J.union_all(first, final, extra), ("stored", "missing", "quarantined", "failed"))


@query("e27_manifest_vs_listing", """
  select path, case when eligible = 0 then 'skipped' when drop_id % 13 = 0 then 'missing' when drop_id % 11 = 0 then 'duplicated' when drop_id % 7 = 0 then 'size_differs'
    when drop_id % 5 = 0 then 'crc_differs' else 'matched' end as outcome
  from (select *, case when state = 'ok' and drop_id % 3 <> 0 then 1 else 0 end as eligible from $artwork_files) x where eligible = 1 or drop_id % 13 <> 0""")
def _(a):
    c = F.col
    crc = F.substring("sha256", 1, 8)
    found = a.artwork_files.where("drop_id % 13 <> 0").select(
        "drop_id", "path", (c("byte_length") + F.when(c("drop_id") % 7 == 0, 1).otherwise(0)).alias("byte_length"),
        F.when(c("drop_id") % 5 == 0, "00000000").otherwise(crc).alias("crc"))
    listing = found.unionByName(found.where("drop_id % 11 = 0"))
    stated = a.artwork_files.select("path", "byte_length", crc.alias("crc"), R.flag((c("state") == "ok") & (c("drop_id") % 3 != 0)).alias("eligible"))
    return M.listing_audit(stated, listing)


@query("j21_media_manifest_coverage", f"""
  select rule, 'media_manifest' as entity, media_key as key, '' as detail from (
    select m.media_key, case when m.doc_id % 100 = 7 then 'manifest_missing' when m.doc_id % 100 = 8 then 'manifest_extra'
      when ({STATUS_SQL}) = 'public_stored' and archive_content_type is null then 'public_incomplete' when ({STATUS_SQL}) = 'public_stored' and m.doc_id % 13 = 0 then 'public_key_invalid' end as rule
    from $moment_media m) x where rule is not null""")
def _(a):
    manifest_rows = a.moment_media.where("doc_id % 100 <> 7").select(
        "media_key", F.col("raw_status").alias("status"), "object_key", F.col("archive_sha256").alias("sha256"), "byte_length", F.col("archive_content_type").alias("content_type"))
    out = M.manifest_coverage(a.moment_media.where("doc_id % 100 <> 8"), manifest_rows, MOMENTS_SNAPSHOT)
    # An extra manifest row is reported as extra only; its other findings follow from the missing media.
    extra = out.where("rule = 'manifest_extra'").select("key")
    return out.where("rule = 'manifest_extra'").unionByName(out.join(extra, "key", "left_anti").select(*out.columns))


@query("j23_upload_proofs", """
  select case when drop_id % 19 = 0 then 'unproven' when drop_id % 11 = 0 then 'proof_repeated' else 'proof_differs' end as rule, 'objects' as entity, path as key, '' as detail
  from $artwork_files where state = 'ok' and (drop_id % 19 = 0 or drop_id % 11 = 0 or drop_id % 7 = 0)
  union all select 'proof_unknown', 'objects', path, '' from $artwork_files where state <> 'ok' and drop_id % 19 <> 0""")
def _(a):
    c = F.col
    log = a.artwork_files.where("drop_id % 19 <> 0").withColumn("byte_length", c("byte_length") + F.when(c("drop_id") % 7 == 0, 1).otherwise(0))
    proofs = log.unionByName(log.where("drop_id % 11 = 0"))
    return M.proof_audit(a.artwork_files.where("state = 'ok'"), proofs, "path", ["sha256", "byte_length"])


@query("j24_artwork_publication_proofs", """
  select case when drop_id % 17 = 0 then 'unproven' else 'proof_differs' end as rule, 'objects' as entity,
    'snapshots/coll-1/collections/drop-artwork/sha256/' || substr(sha256, 1, 2) || '/' || sha256 || '.webp' as key, '' as detail
  from $artwork_files where state = 'ok' and (drop_id % 17 = 0 or drop_id % 5 = 0)""")
def _(a):
    c = F.col
    key = R.content_key("snapshots/coll-1/collections/drop-artwork", c("sha256"), F.lit("webp"))
    stored = a.artwork_files.where("state = 'ok'").select("drop_id", key.alias("key"), "sha256", "byte_length", F.lit("image/webp").alias("content_type"))
    proofs = stored.where("drop_id % 17 <> 0").withColumn("content_type", F.when(c("drop_id") % 5 == 0, "image/png").otherwise(c("content_type")))
    return M.proof_audit(stored, proofs, "key", ["sha256", "byte_length", "content_type"])
