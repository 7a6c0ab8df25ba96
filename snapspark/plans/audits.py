"""D, W-05: integrity audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import ordering as O
from ..functions import rules as R
from ..operators import audit as D
from ..operators import digests as H
from ..operators import relations as J
from ..session import parts_for
from .aggregates import export_manifest
from .joins import drop_id_arrays
from .publication import SQL as PUB
from .publication import public_capsules, public_moments
from .registry import query

STATUS_KNOWN = "'pending', 'public_stored', 'private_stored', 'missing', 'quarantined', 'failed', 'isolated', 'private', 'public', 'not_found', 'error', 'quarantined_stored', 'source_missing', 'oversize', 'unattempted'"


@query("d01_primary_keys", """
  select 'duplicate_key' as rule, 'raw_tokens' as entity, repeated_uid as key, count(*)::varchar as detail from $raw_tokens group by repeated_uid having count(*) > 1
  union all select 'null_key', 'moment_media_by_moment', 'null', count(*)::varchar from $moment_media where moment_id is null having count(*) > 0
  union all select 'duplicate_key', 'moment_media_by_moment', moment_id::varchar, count(*)::varchar from $moment_media where moment_id is not null group by moment_id having count(*) > 1
  union all select 'duplicate_key', 'moment_media', media_key, count(*)::varchar from $moment_media group by media_key having count(*) > 1
  union all select 'duplicate_key', 'moments', moment_id::varchar, count(*)::varchar from $moments group by moment_id having count(*) > 1
  union all select 'duplicate_key', 'collection_media', collection_id || ' ' || role, count(*)::varchar from $collection_media group by collection_id, role having count(*) > 1""")
def _(a):
    """The real keys of three tables, and two columns that are planted as keys and are none."""
    found = D.primary_key(a.raw_tokens, ["repeated_uid"], "raw_tokens").unionByName(D.primary_key(a.moment_media, ["moment_id"], "moment_media_by_moment"))
    for name, key in (("moment_media", ["media_key"]), ("moments", ["moment_id"]), ("collection_media", ["collection_id", "role"])):
        found = found.unionByName(D.primary_key(getattr(a, name), key, name))
    return found


@query("d02_check_constraints", f"""
  select 'drop_id_positive' as rule, 'drops' as entity, drop_id::varchar as key, '' as detail from $raw_drops where not drop_id > 0
  union all select 'is_virtual_flag', 'drops', drop_id::varchar, '' from $raw_drops where is_virtual not in (0, 1)
  union all select 'is_private_flag', 'drops', drop_id::varchar, '' from $raw_drops where is_private not in (0, 1)
  union all select 'fancy_id_present', 'drops', drop_id::varchar, '' from $raw_drops where fancy_id = ''
  union all select 'date_range', 'drops', drop_id::varchar, '' from $raw_drops where end_date < start_date
  union all select 'status_known', 'moment_media', media_key, '' from $moment_media where raw_status not in ({STATUS_KNOWN})
  union all select 'public_needs_object', 'moment_media', media_key, '' from $moment_media where raw_status = 'public_stored' and (object_key is null or archive_content_type is null)
  union all select 'role_known', 'collection_media', object_key, '' from $collection_media where role not in ('logo', 'banner', 'mobile_banner')
  union all select 'eligible_is_stored', 'collection_media', object_key, '' from $collection_media where eligible_for_publish = 1 and status <> 'stored'""")
def _(a):
    checks = schemas.checks()
    tables = {"drops": (a.raw_drops, "drop_id"), "tokens": (a.tokens, "source_uid"), "moment_media": (a.moment_media, "media_key"),
              "collection_media": (a.collection_media, "object_key")}
    return J.union_all(*[D.check_constraints(df, n, key, checks[n]) for n, (df, key) in tables.items()])


FOREIGN_KEYS = [  # child, column, parent, target
    ("collection_items", "collection_id", "collections", "collection_id"),
    ("collection_items", "drop_id", "drops_base", "drop_id"),
    ("collection_sections", "collection_id", "collections", "collection_id"),
    ("collection_item_sections", "item_id", "collection_items", "item_id"),
    ("collection_item_sections", "section_id", "collection_sections", "section_id"),
    ("collection_urls", "collection_id", "collections", "collection_id"),
    ("collection_ui_settings", "collection_id", "collections", "collection_id"),
    ("collection_artists", "collection_id", "collections", "collection_id"),
    ("collection_artist_drops", "artist_id", "collection_artists", "artist_id"),
    ("collection_artist_drops", "drop_id", "drops_base", "drop_id"),
    ("collection_organizations", "collection_id", "collections", "collection_id"),
    ("verified_collections", "collection_id", "collections", "collection_id"),
    ("verified_collections", "verified_by", "collection_organizations", "organization_id"),
    ("featured_collections", "collection_id", "collections", "collection_id"),
    ("suggested_drops", "collection_id", "collections", "collection_id"),
    ("suggested_drops", "drop_id", "drops_base", "drop_id"),
    ("moment_media", "moment_id", "moments", "moment_id"),
]


@query("d03_foreign_keys", " union all ".join(
    f"""select '{c}.{col}' as name, count({col}) as checked, count(*) filter (where {col} is not null and {col} not in (select {tgt} from ${p})) as missing,
      count(*) filter (where {col} is null) as empty from ${c}""" for c, col, p, tgt in FOREIGN_KEYS))
def _(a):
    parents: dict = {}
    for child, column, parent, target in FOREIGN_KEYS:
        parents.setdefault((parent, target), {})[f"{child}.{column}"] = (getattr(a, child), column)
    return J.union_all(*[D.foreign_keys(children, getattr(a, parent), target) for (parent, target), children in parents.items()])


@query("d04_section_collections", """
  select 'section_collection_mismatch' as rule, 'item_sections' as entity, l.item_id || ':' || l.section_id as key, '' as detail
  from $collection_item_sections l join $collection_items i on i.item_id = l.item_id join $collection_sections s on s.section_id = l.section_id
  where i.collection_id <> s.collection_id""")
def _(a):
    return D.section_collections(a.collection_items, a.collection_item_sections, a.collection_sections)


@query("d05_derived_arrays", """
  select 'row_missing' as rule, 'collection_drop_ids' as entity, collection_id::varchar as key, count(*)::varchar as detail from $collection_items where collection_id % 4 = 0 group by collection_id
  union all select 'drop_ids_mismatch', 'collection_drop_ids', collection_id::varchar, count(*) filter (where drop_id % 97 = 0)::varchar from $collection_items
    where collection_id % 4 <> 0 and collection_id % 5 = 0 group by collection_id having count(*) filter (where drop_id % 97 = 0) > 0""")
def _(a):
    # The view lacks every fourth collection, and in every fifth the drops divisible by 97.
    view = drop_id_arrays(a.collection_items.where("collection_id % 4 <> 0")).withColumn("drop_ids", F.when(F.col("collection_id") % 5 == 0, F.filter("drop_ids", lambda d: d % 97 != 0)).otherwise(F.col("drop_ids")))
    return D.derived_arrays(view, a.collection_items)


@query("d06_collection_types", """
  select 'type_relation_mismatch' as rule, 'collections' as entity, collection_id::varchar as key, type as detail from (
    select collection_id, coalesce(type, '') as type, collection_id in (select collection_id from $collection_artists) as a,
      collection_id in (select collection_id from $collection_organizations) as o from $collections) x
  where not ((type = 'artist' and a and not o) or (type = 'organization' and o and not a) or (type = 'user' and not a and not o))""")
def _(a):
    return D.collection_types(a.collections, a.collection_artists, a.collection_organizations)


def nested_moments(a):
    """Moments with their nested drops as the source delivers them (at most two per moment here); some are tampered with."""
    pairs = a.moment_drops.withColumn("pointer", F.when(F.col("moment_id") % 333 == 0, F.col("moment_id") + 1).otherwise(F.col("moment_id")))
    lists = pairs.groupBy("moment_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pointer").alias("moment_id"), "drop_id"))).alias("drops"))
    return lists.select(F.col("moment_id").alias("id"), "drops")


@query("d07_bridge_equals_nested", """
  select 'derivation_extra' as rule, 'moment_drops' as entity, b.moment_id || ':' || b.drop_id as key, '' as detail from $moment_drops b
    left join $d07_nested n on n.moment_id = b.moment_id and n.drop_id = b.drop_id where n.moment_id is null
  union all select 'derivation_missing', 'moment_drops', n.moment_id || ':' || n.drop_id, '' from $d07_nested n
    left join $moment_drops b on n.moment_id = b.moment_id and n.drop_id = b.drop_id where b.moment_id is null
  union all select 'moment_id_orphan', 'links', link_id::varchar, moment_id::varchar from $moment_links where moment_id not in (select moment_id from $moments where moment_id % 500 <> 1)
  union all select 'moment_id_orphan', 'user_tags', tag_id::varchar, moment_id::varchar from $moment_user_tags where moment_id not in (select moment_id from $moments where moment_id % 500 <> 1)
  union all select 'media_key_orphan', 'gateways', gateway_id, media_key from $gateways where media_key not in (select media_key from $moment_media where doc_id % 100 <> 9)""",
  {"d07_nested": "select distinct case when moment_id % 333 = 0 then moment_id + 1 else moment_id end as moment_id, drop_id from $moment_drops"})
def _(a):
    moments = a.moments.where("moment_id % 500 <> 1")
    media = a.moment_media.where("doc_id % 100 <> 9")
    return J.union_all(
        D.bridge_equals_nested(a.moment_drops, nested_moments(a)),
        D.orphans(a.moment_links, "moment_id", moments, "moment_id", "links", "link_id"),
        D.orphans(a.moment_user_tags, "moment_id", moments, "moment_id", "user_tags", "tag_id"),
        D.orphans(a.gateways, "media_key", media, "media_key", "gateways", "gateway_id"),
    )


@query("d08_nested_parent", """
  select 'nested_parent_mismatch' as rule, 'moments' as entity, moment_id::varchar as key, (moment_id + 1)::varchar as detail from $moment_drops where moment_id % 333 = 0""")
def _(a):
    return D.nested_parent(nested_moments(a), "moments", "id", "drops", "moment_id")


@query("d09_duplicate_slugs", "select count(*) - count(distinct slug) as duplicates from $collections")
def _(a):
    return a.collections.agg((F.count("*") - F.count_distinct("slug")).alias("duplicates"))


def same_multiset(left: str, right: str) -> str:
    return f"case when (select count(*) from (select * from {left} except all select * from {right}) x) + (select count(*) from (select * from {right} except all select * from {left}) y) = 0 then 1 else 0 end"


@query("d10_dataset_digest", f"""
  select 'same rows, other order' as pair, count(*) as n, 1 as equal from $snapshot_a
  union all select 'second capture', (select count(*) from $snapshot_b), {same_multiset('$snapshot_a', '$snapshot_b')}""")
def _(a):
    cols = a.snapshot_a.columns
    base = D.multiset_digest(a.snapshot_a, cols)
    others = {"same rows, other order": a.snapshot_a.orderBy(F.desc("digest")), "second capture": a.snapshot_b}
    parts = []
    for name, df in others.items():
        equal = F.col("digest") == base.select("digest").scalar()
        parts.append(D.multiset_digest(df, cols).select(F.lit(name).alias("pair"), F.col("rows").alias("n"), R.flag(equal).alias("equal")))
    return J.union_all(*parts)


_JSON = """'{"digest":"' || digest || '","doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}'"""


@query("d11_two_pass_stability", f"""
  select artifact, field, case when p = s then 1 else 0 end as stable, case when field = 'digest' then '' else p end as primary_value from (
    select 'documents' as artifact, 'rows' as field, (select count(*) from $snapshot_a)::varchar as p, (select count(*) from $snapshot_b)::varchar as s
    union all select 'documents', 'bytes', (select sum(strlen({_JSON}) + 1)::bigint from $snapshot_a)::varchar, (select sum(strlen({_JSON}) + 1)::bigint from $snapshot_b)::varchar
    union all select 'documents', 'digest', '1', ({same_multiset('$snapshot_a', '$snapshot_b')})::varchar
    union all select 'english', 'rows', (select count(*) from $snapshot_a where lang = 'en')::varchar, (select count(*) from $snapshot_a where lang = 'en')::varchar
    union all select 'english', 'bytes', (select sum(strlen({_JSON}) + 1)::bigint from $snapshot_a where lang = 'en')::varchar, (select sum(strlen({_JSON}) + 1)::bigint from $snapshot_a where lang = 'en')::varchar
    union all select 'english', 'digest', '1', '1') x""")
def _(a):
    english = a.snapshot_a.where("lang = 'en'")
    out = D.compare_captures({"documents": a.snapshot_a, "english": english}, {"documents": a.snapshot_b, "english": english})
    shown = F.when(F.col("field") == "digest", "").otherwise(F.col("primary_value"))
    return out.select("artifact", "field", "stable", shown.alias("primary_value"))


@query("d12_row_comparison", """
  select coalesce(p.doc_id, s.doc_id) as doc_id, case when p.doc_id is null then 'added' when s.doc_id is null then 'removed' else 'changed' end as change,
    case when p.doc_id is not null and s.doc_id is not null then 'digest' else '' end as changed_columns
  from $snapshot_a p full join $snapshot_b s on s.doc_id = p.doc_id where p.doc_id is null or s.doc_id is null or p.digest <> s.digest""")
def _(a):
    return D.compare_rows(a.snapshot_a, a.snapshot_b, ["doc_id"])


@query("d12_located_rows", """
  select coalesce(p.doc_id, s.doc_id) as doc_id, case when p.doc_id is null then 'added' when s.doc_id is null then 'removed' else 'changed' end as change,
    case when p.doc_id is not null and s.doc_id is not null then 'digest' else '' end as changed_columns
  from $snapshot_a p full join $snapshot_b s on s.doc_id = p.doc_id where p.doc_id is null or s.doc_id is null or p.digest <> s.digest""")
def _(a):
    return H.compare_located(a.snapshot_a, a.snapshot_b, "doc_id", width=64)


# Captures of the documents in an order: as it is, with two rows swapped, with one row changed, with one row lost.
SEQ = "select *, row_number() over (order by doc_id) - 1 as place from $snapshot_a"
CAPTURES = {
    "ordered": SEQ,
    "swapped": "select * replace (case place when 3 then 150 when 150 then 3 else place end as place) from $ordered",
    "changed": "select * replace (case place when 77 then 'other' else digest end as digest) from $ordered",
    "cut": "select * replace (place - 1 as place) from $ordered where place > 0",
}
_DIFFERS = "select '{0}' as capture, coalesce(p.place, s.place) // 64 as block from $ordered p full join ${0} s on s.place = p.place where (p.digest, p.doc_id) is distinct from (s.digest, s.doc_id)"


def captures(a):
    placed = O.positions(a.snapshot_a.withColumn("_all", F.lit(0)), "_all", ["doc_id"], "place").drop("_all")
    place = F.col("place")
    return {
        "ordered": placed,
        "swapped": placed.withColumn("place", F.when(place == 3, 150).when(place == 150, 3).otherwise(place)),
        "changed": placed.withColumn("digest", F.when(place == 77, "other").otherwise(F.col("digest"))),
        "cut": placed.where(place > 0).withColumn("place", place - 1),
    }


@query("d10_ordered_digest", """
  select capture, f.block, n.n as primary_rows, n.n - case when capture = 'cut' and f.block = (select max(block) from $blocks) then 1 else 0 end as secondary_rows
  from $found f join $blocks n on n.block = f.block""", CAPTURES | {
    "found": " union ".join(_DIFFERS.format(name) for name in ("swapped", "changed", "cut")),
    "blocks": "select block, count(*) as n from (select place // 64 as block from $ordered) x group by 1"})
def _(a):
    frames = captures(a)
    columns = [c for c in frames["ordered"].columns if c != "place"]
    trees = {name: H.tree(df, "place", columns, width=64) for name, df in frames.items()}
    return J.union_all(*[H.differing(trees["ordered"], trees[name]).withColumn("capture", F.lit(name)) for name in ("swapped", "changed", "cut")])


SHARDS = """select 'tokens-' || substr(owner_address_norm, 42, 1) as shard_path, 'tokens' as table_name, count(*) as row_count, (count(*) + 499) // 500 as statement_count from $tokens group by 1"""
LOADED = """select shard_path, case when shard_path = 'tokens-f' then 'drops' else table_name end as table_name, case when shard_path = 'tokens-b' then row_count + 1 else row_count end as row_count,
  case when shard_path = 'tokens-e' then 0 else statement_count end as statement_count from $shards where shard_path <> 'tokens-a'
  union all select 'tokens-zz', 'tokens', 0, 0"""
SHARD_SQL = {"shards": SHARDS, "loaded": LOADED}
JOURNAL = ["source_database_sha256", "payload_sha256", "table_name", "row_count", "statement_count"]
PAYLOAD = ["token_id", "source_uid", "drop_id", "owner_address_norm"]


def placed_tokens(a):
    """Tokens with their shard, one for each last digit of an address, and their place in it."""
    path = F.concat(F.lit("tokens-"), F.substring("owner_address_norm", 42, 1))
    rows = a.tokens.select(path.alias("shard_path"), *PAYLOAD)
    return O.positions(rows, "shard_path", ["token_id", "source_uid"], "place", parts_for(a.lineitem), few=True)


def shard_journal(placed, source):
    """One journal row for each shard of the rows as they lie; `source` has the digest of the whole source."""
    shards = H.roots(H.tree(placed, "place", PAYLOAD, ["shard_path"]), ["shard_path"])
    return shards.select(
        "shard_path", F.lit("tokens").alias("table_name"), F.col("rows").alias("row_count"), F.ceil(F.col("rows") / 500).alias("statement_count"),
        F.col("digest").alias("payload_sha256"), source.alias("source_database_sha256"))


def source_digest(a):
    return D.multiset_digest(a.tokens, PAYLOAD).select("digest").scalar()


def loaded_journal(a, placed):
    """A journal with one shard lost and one that nobody planned, and of six others: one of another source, one with a changed
    row, one with two rows swapped, and one wrong table, row count and statement count each."""
    c = F.col
    at = lambda digit: c("shard_path") == f"tokens-{digit}"
    swapped = F.when(c("place") == 0, 1).when(c("place") == 1, 0).otherwise(c("place"))
    found = placed.where(~at("a")).withColumn("drop_id", F.when(at("c") & (c("place") == 0), -1).otherwise(c("drop_id"))).withColumn(
        "place", F.when(at("d"), swapped).otherwise(c("place")))
    rows = shard_journal(found, source_digest(a))
    rows = rows.withColumn("row_count", c("row_count") + F.when(at("b"), 1).otherwise(0)).withColumn(
        "statement_count", F.when(at("e"), 0).otherwise(c("statement_count"))).withColumn("table_name", F.when(at("f"), "drops").otherwise(c("table_name"))).withColumn(
        "source_database_sha256", F.when(at("1"), "other").otherwise(c("source_database_sha256")))
    nothing = F.lit(0).cast("bigint")
    extra = a.spark.range(1).select(
        F.lit("tokens-zz").alias("shard_path"), F.lit("tokens").alias("table_name"), nothing.alias("row_count"), nothing.alias("statement_count"),
        F.lit("").alias("payload_sha256"), F.lit("").alias("source_database_sha256"))
    return rows.unionByName(extra)


@query("d14_journal", """
  select * from (
    select case when l.shard_path is null then 'shard_missing' when e.shard_path is null then 'shard_unknown' else 'shard_differs' end as rule, 'import_shards' as entity,
      coalesce(e.shard_path, l.shard_path) as key, case when l.shard_path is null or e.shard_path is null then '' else concat_ws(',',
        case when e.shard_path = 'tokens-1' then 'source_database_sha256' end, case when e.shard_path = 'tokens-c' or e.shard_path = 'tokens-d' and e.row_count > 1 then 'payload_sha256' end,
        case when e.table_name <> l.table_name then 'table_name' end, case when e.row_count <> l.row_count then 'row_count' end,
        case when e.statement_count <> l.statement_count then 'statement_count' end) end as detail
    from $shards e full join $loaded l on l.shard_path = e.shard_path) x where rule <> 'shard_differs' or detail <> ''""", SHARD_SQL)
def _(a):
    placed = placed_tokens(a)
    return D.journal(shard_journal(placed, source_digest(a)), loaded_journal(a, placed), "shard_path", JOURNAL)


@query("d15_journal_totals", """
  select 'tokens' as table_name, (select sum(row_count)::bigint from $loaded) as journal_rows, (select count(*) from $tokens) as table_rows,
    case when (select sum(row_count) from $loaded) = (select count(*) from $tokens) then 1 else 0 end as ok""", SHARD_SQL)
def _(a):
    return D.journal_totals(loaded_journal(a, placed_tokens(a)).withColumn("table_name", F.lit("tokens")), {"tokens": a.tokens})


@query("d16_release_arithmetic", """
  select name, l as left_value, r as right_value, case when l = r then 1 else 0 end as ok from (
    select 'owner_stats_sum' as name, (select sum(token_count)::bigint from $owner_stats) as l, (select count(*) from $tokens) as r
    union all select 'drop_counts_sum', (select sum(token_count)::bigint from $drops), (select count(*) from $tokens)
    union all select 'drop_stats_rows', (select count(*) from $drop_stats), (select count(*) from $drops_base)
    union all select 'collector_refs', (select count(*) from $tokens), (select count(*) from $tokens)) x""")
def _(a):
    def one(df, col):
        return df.agg(col.alias("v"))

    n = F.count("*")
    refs = a.tokens.select("drop_id", "token_id", "source_uid", "owner_address_norm")
    return D.arithmetic({
        "owner_stats_sum": (one(a.owner_stats, F.sum("token_count")), one(a.tokens, n)),
        "drop_counts_sum": (one(a.drops, F.sum("token_count")), one(a.tokens, n)),
        "drop_stats_rows": (one(a.drop_stats, n), one(a.drops_base, n)),
        "collector_refs": (one(refs, n), one(a.tokens, n)),
    })


@query("d17_public_projection", """
  select 'visible_moments' as name, count(*) as n from $moment_visibility where is_public = 1
  union all select 'public_moments', count(*) from $public_moments union all select 'public_capsules', count(*) from $public_capsules
  union all select 'invalid_public_moments', count(*) from $public_moments p where not exists (select 1 from $moment_drops d where d.moment_id = p.moment_id)
    or exists (select 1 from $moment_drops d join $moment_hidden_drops h on h.drop_id = d.drop_id where d.moment_id = p.moment_id)""", PUB)
def _(a):
    public = public_moments(a)
    hidden = a.moment_drops.join(a.moment_hidden_drops, "drop_id", "left_semi")
    broken = J.union_distinct(
        public.join(a.moment_drops, "moment_id", "left_anti").select("moment_id"),
        public.join(hidden, "moment_id", "left_semi").select("moment_id"),
        public.join(a.moment_suppressions.where("active = 1"), "moment_id", "left_semi").select("moment_id"))
    frames = {"visible_moments": a.moment_visibility.where("is_public = 1"), "public_moments": public, "public_capsules": public_capsules(a), "invalid_public_moments": broken}
    return J.union_all(*[df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in frames.items()])


# Loaded projections: of moments some are lost and some hidden ones are in, of capsules some are doubled, of a third all is well.
VERDICT = {
    **PUB,
    "loaded_moments": "select moment_id from $public_moments where moment_id % 70 <> 1 union all select moment_id from $moments where moment_id % 90 = 2 and moment_id not in (select moment_id from $public_moments)",
    "loaded_capsules": "select capsule_id from $public_capsules union all select capsule_id from $public_capsules where capsule_id % 80 = 3",
}


@query("d17_projection_verdict", """
  select 'moments' as name, (select count(*) from $public_moments) as planned, (select count(*) from $loaded_moments) as loaded,
    (select count(*) from $public_moments where moment_id % 70 = 1) as missing, (select count(*) from $loaded_moments where moment_id not in (select moment_id from $public_moments)) as broken,
    case when (select count(*) from $public_moments where moment_id % 70 = 1) = 0 and (select count(*) from $loaded_moments where moment_id not in (select moment_id from $public_moments)) = 0 then 1 else 0 end as ok
  union all select 'capsules', (select count(*) from $public_capsules), (select count(*) from $loaded_capsules), 0, (select count(*) from $public_capsules where capsule_id % 80 = 3),
    case when (select count(*) from $public_capsules where capsule_id % 80 = 3) = 0 then 1 else 0 end
  union all select 'collections', (select count(*) from $collections), (select count(*) from $collections), 0, 0, 1""", VERDICT)
def _(a):
    moments, capsules = public_moments(a).select("moment_id"), public_capsules(a).select("capsule_id")
    hidden = a.moments.where("moment_id % 90 = 2").select("moment_id").join(moments, "moment_id", "left_anti")
    loaded = moments.where("moment_id % 70 <> 1").unionByName(hidden)
    doubled = capsules.unionByName(capsules.where("capsule_id % 80 = 3"))
    return J.union_all(
        D.projection_verdict("moments", moments, loaded, "moment_id"), D.projection_verdict("capsules", capsules, doubled, "capsule_id"),
        D.projection_verdict("collections", a.collections, a.collections, "collection_id"))


@query("d18_shard_reconciliation", """
  select c.shard, c.n as captured, coalesce(f.n, 0) as final from (select token_id % 16 as shard, count(*) as n from $raw_tokens group by 1) c
  left join (select token_id % 16 as shard, count(*) as n from $raw_tokens where not (token_id % 16 in (3, 9) and transfer_count = 7) group by 1) f on f.shard = c.shard where c.n <> coalesce(f.n, 0)""")
def _(a):
    rows = a.raw_tokens.withColumn("shard", F.col("token_id") % 16)
    final = rows.where("not (shard in (3, 9) and transfer_count = 7)")
    return D.shard_reconciliation(rows, final, "shard")


@query("d18_retry_list", """
  select shard, n as removed, low, high, (select count(*) from $raw_tokens where token_id % 16 not in (select shard from $d18_wrong)) as rows_left from $d18_wrong""", {
    "d18_wrong": """select c.shard, c.n, c.low, c.high from (select token_id % 16 as shard, count(*) as n, min(token_id) as low, max(token_id) as high from $raw_tokens group by 1) c
      where exists (select 1 from $raw_tokens r where r.token_id % 16 = c.shard and c.shard in (3, 9) and r.transfer_count = 7)"""})
def _(a):
    rows = a.raw_tokens.withColumn("shard", F.col("token_id") % 16)
    final = rows.where("not (shard in (3, 9) and transfer_count = 7)")
    left, again = D.retry_list(rows, D.shard_reconciliation(rows, final, "shard"), "shard", "token_id")
    return again.withColumn("rows_left", left.agg(F.count("*")).scalar())


@query("d19_referenced_coverage", """
  select 'captured_plus_missing' as name, (select count(*) from $drops_base where drop_id in (select drop_id from $tokens))
    + (select count(distinct drop_id) from $tokens where drop_id not in (select drop_id from $drops_base)) as left_value,
    (select count(distinct drop_id) from $tokens) as right_value, 1 as ok""")
def _(a):
    ids = a.tokens.select("drop_id").distinct()
    captured = a.drops_base.join(ids, "drop_id", "left_semi").select(F.lit(1).alias("x"))
    missing = ids.join(a.drops_base, "drop_id", "left_anti").select(F.lit(1).alias("x"))
    return D.arithmetic({"captured_plus_missing": (captured.unionByName(missing).agg(F.count("*")), ids.agg(F.count("*")))})


@query("d20_export_manifest", """
  select 'segment_count' as rule, 'export_manifest' as entity, collection_id || ':items' as key, '' as detail from $collections where collection_id % 25 = 0
    and collection_id in (select collection_id from $collection_items)
  union all select 'record_id_repeated', 'export_manifest', collection_id || ':suggestions', '' from (select collection_id, drop_id from $suggested_drops where curation_status = 'approved' and drop_id % 50 = 1) x group by collection_id
  union all select 'segment_count', 'export_manifest', collection_id || ':suggestions', '' from (select collection_id, drop_id from $suggested_drops where curation_status = 'approved' and drop_id % 50 = 1) x group by collection_id""")
def _(a):
    counts = export_manifest(a)
    claims = counts.selectExpr("collection_id", "stack(2, 'items', items, 'suggestions', suggestions) as (segment, count)").where("count > 0")
    claims = claims.withColumn("count", F.col("count") + F.when((F.col("segment") == "items") & (F.col("collection_id") % 25 == 0), 1).otherwise(0))
    items = a.collection_items.select("collection_id", F.lit("items").alias("segment"), F.col("item_id").alias("record_id"))
    approved = a.suggested_drops.where("curation_status = 'approved'")
    doubled = approved.unionByName(approved.where("drop_id % 50 = 1"))
    records = items.unionByName(doubled.select("collection_id", F.lit("suggestions").alias("segment"), F.col("suggestion_id").alias("record_id")))
    return D.manifest_consistency(claims, records)


@query("d24_nested_limit", """
  select 'nested_limit_reached' as rule, 'moments' as entity, moment_id::varchar as key, count(*)::varchar as detail from $moment_drops group by moment_id having count(*) >= 2""")
def _(a):
    return D.reached_limit(nested_moments(a), "moments", "id", "drops", 2)


@query("w05_strict_key_order", """
  select 'order_invalid' as rule, 'tokens_file' as entity, file || ':' || seq as key, '' as detail from (
    select file, seq, k, lag(k) over (partition by file order by seq) as p from (
      select event_id % 4 as file, event_id // 4 as seq, case when event_id % 97 = 0 then 0 else event_id end as k from $events) x) y where k <= p""")
def _(a):
    rows = a.events.select((F.col("event_id") % 4).alias("file"), F.floor(F.col("event_id") / 4).alias("seq"),
                           F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("event_id")).alias("k"))
    return D.strict_order(rows, "file", "seq", "k", "tokens_file")
