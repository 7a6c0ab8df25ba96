"""S and D-21..D-23: sources, sinks, layouts and what is read back from them.

Sinks write into a fresh folder below the session's shared checkpoint folder and are read back whole.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..domain import CATALOG_SNAPSHOT, HOLDINGS_SNAPSHOT, MEDIA_BASE
from ..functions import ordering as O
from ..functions import rules as R
from ..operators import audit as D
from ..operators import browse as B
from ..operators import exports as X
from ..operators import quality as Q
from ..operators import relations as J
from ..session import parts_for, scratch_path, written
from ..sources import clustered as K
from ..sources import layout as S
from .joins import layers
from .quality import SQL as QUALITY
from .registry import ORACLES, query

TOKEN_SCHEMA = "source_uid string, token_id bigint, drop_id bigint, minted_on bigint, owner_address_norm string, network string, transfer_count bigint"


@query("s01_table_scan", "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_shipdate >= timestamp '2001-01-01' and l_quantity > 40")
def _(a):
    return S.scan(a.spark, f"{a.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_suppkey"],
                  "l_shipdate >= timestamp_ntz'2001-01-01' and l_quantity > 40", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("s04_json_lines", """
  select case when doc_id % 20 = 1 then 'blank_line' when doc_id % 20 = 2 then 'bad_json' when doc_id % 20 = 3 then 'not_object' else 'ok' end as verdict,
    count(*) as n, sum(case when doc_id % 20 in (1, 2, 3) then 0 else n_chars end)::bigint as chars from documents group by 1""")
def _(a):
    path = scratch_path(a.spark, "lines")
    good = F.to_json(F.struct("doc_id", "text", "lang", "n_chars"))
    k = F.col("doc_id") % 20
    line = F.when(k == 1, "  ").when(k == 2, F.concat(good, F.lit(","), good)).when(k == 3, F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    a.documents.select(line.alias("value")).write.text(path)
    lines = S.json_lines(a.spark, path)
    chars = F.when(F.col("verdict") == "ok", F.from_json("line", "n_chars bigint")["n_chars"])
    return lines.groupBy("verdict").agg(F.count("*").alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))


def nested(a):
    """Moments as the source delivers them: id, name and at most two nested drops."""
    lists = a.moment_drops.groupBy("moment_id").agg(F.sort_array(F.collect_list(F.struct("moment_id", "drop_id"))).alias("drops"))
    rows = a.moments.select(F.col("moment_id").alias("id"), F.col("description").alias("name"), "moment_id").join(lists, "moment_id", "left")
    return rows.select("id", "name", F.coalesce("drops", F.array().cast("array<struct<moment_id:bigint,drop_id:bigint>>")).alias("drops"))


def stored_pages(a):
    path = scratch_path(a.spark, "pages")
    S.write_pages(nested(a), path, "moments", 100)
    return S.read_pages(a.spark, path)


@query("s05_raw_pages", """
  select 'moments' as entity, (m.moment_id - 1) // 100 + 1 as page, (m.moment_id - 1) % 100 as position, m.moment_id as id, m.description as name, coalesce(d.n, 0) as drops
  from $moments m left join (select moment_id, count(*) as n from $moment_drops group by 1) d on d.moment_id = m.moment_id""")
def _(a):
    return S.page_rows(stored_pages(a)).withColumn("drops", F.size("drops"))


@query("s06_parent_and_children", """
  select collection_id as parent_id, row_number() over (partition by collection_id order by url_id) - 1 as position, url_id, url from $collection_urls""")
def _(a):
    path = scratch_path(a.spark, "parents")
    urls = a.collection_urls.groupBy("collection_id").agg(F.sort_array(F.collect_list(F.struct("url_id", "url"))).alias("urls"))  # at most four
    a.collections.select("collection_id", "title").join(urls, "collection_id", "left").write.json(path)
    schema = "collection_id bigint, title string, urls array<struct<url_id:bigint,url:string>>"
    parents, children = S.split_children(a.spark.read.schema(schema).json(path), "collection_id", "urls")
    return children


@query("s07_bridge_rows", """
  select 'row' as kind, moment_id::varchar as key, drop_id::varchar as detail from $moment_drops where moment_id % 400 <> 0
  union all select 'nested_parent_mismatch', moment_id::varchar, '0' from $moment_drops where moment_id % 400 = 0
  union all select 'duplicate_pair', moment_id || ':' || drop_id, '2' from $moment_drops where moment_id % 300 = 0 and moment_id % 400 <> 0""")
def _(a):
    parents = nested(a).withColumn("drops", F.when(F.col("id") % 400 == 0, F.transform("drops", lambda d: d.withField("moment_id", F.lit(0).cast("bigint"))))
                                   .when(F.col("id") % 300 == 0, F.concat("drops", "drops")).otherwise(F.col("drops")))
    rows, bad = S.bridge_rows(parents)
    return rows.select(F.lit("row").alias("kind"), F.col("moment_id").cast("string").alias("key"), F.col("drop_id").cast("string").alias("detail")).unionByName(
        bad.select(F.col("rule").alias("kind"), "key", "detail"))


@query("s08_ordered_json_sink", "select count(*) as rows, 1 as same_digest, 0 as out_of_order from $tokens")
def _(a):
    path = scratch_path(a.spark, "tokens-json")
    S.write_ordered_json(a.tokens, path, ["source_uid"])
    back = a.spark.read.schema(TOKEN_SCHEMA).json(path)
    facts = S.artifact_facts(back)
    same = F.col("digest") == S.artifact_facts(a.tokens).select("digest").scalar()
    # Files are ranges of the key: ordered when no file starts before another one ends.
    spans = back.groupBy(F.input_file_name().alias("file")).agg(F.min("source_uid").alias("lo"), F.max("source_uid").alias("hi"))
    # One row per file reaches this window.
    overlap = spans.withColumn("before", F.lag("hi").over(W.orderBy("lo"))).where("before > lo")
    return facts.select("rows", R.flag(same).alias("same_digest"), overlap.agg(F.count("*")).scalar().alias("out_of_order"))


@query("s10_quarantine_sink", """
  select drop_id::varchar as primary_key, reasons, 'drops' as entity from $drop_judged where reasons <> ''
  union all select source_uid, reasons, 'tokens' from $token_judged where reasons <> ''""", QUALITY)
def _(a):
    schema = "primary_key string, reasons array<string>, record string"
    parts = []
    for entity, judged, key in (("drops", Q.judge_drops(a.raw_drops), "drop_id"), ("tokens", Q.judge_tokens(a.raw_tokens), "source_uid")):
        path = scratch_path(a.spark, f"rejects-{entity}")
        S.write_rejects(Q.rejected(judged, key), path)
        back = a.spark.read.schema(schema).json(path)
        parts.append(back.select("primary_key", F.array_join("reasons", ",").alias("reasons"), F.lit(entity).alias("entity")))
    return parts[0].unionByName(parts[1])


def export_rows(a):
    return X.export_rows(J.export_records(a.tokens, layers(a), MEDIA_BASE, CATALOG_SNAPSHOT), HOLDINGS_SNAPSHOT, "2024-06-01T00:00:00.000Z")


J14 = ORACLES["j14_export_records"]
EXPORT = f"""select '{HOLDINGS_SNAPSHOT}' as snapshot_id, '2024-06-01T00:00:00.000Z' as snapshot_at, owner_address_norm as queried_address, source_uid, token_id, drop_id,
  title, start_date, end_date, city, country, event_url, network, minted_on, transfer_count, artwork_url,
  case when is_private = 1 then 'true' else 'false' end as is_private, case when is_hidden = 1 then 'true' else 'false' end as is_hidden from ({J14}) j"""


def _cell(c):
    text = f"coalesce({c}::varchar, '')"
    return f"""'"' || replace(case when regexp_matches({text}, '^[\\t\\r\\n ]*[=+@-]') then '''' || {text} else {text} end, '"', '""') || '"'"""


CSV_HEADER = ",".join(f'"{c}"' for c in X.CSV_COLUMNS)


@query("s11_csv_sink", f"select {' || chr(44) || '.join(_cell(c) for c in X.CSV_COLUMNS)} as line from ({EXPORT}) x")
def _(a):
    path = scratch_path(a.spark, "export-csv")
    rows = export_rows(a)
    lines = rows.withColumn("line", X.csv_line(list(X.CSV_COLUMNS))).select("queried_address", "token_id", "source_uid", "line")
    S.write_csv(lines, CSV_HEADER, path, "queried_address", ["token_id", "source_uid"], parts=parts_for(a.lineitem))
    return S.read_csv_lines(a.spark, path).select("line")


@query("s12_json_sink", f"select * from ({EXPORT}) x")
def _(a):
    path = scratch_path(a.spark, "export-json")
    rows = export_rows(a)
    S.write_json(rows, path)
    back = a.spark.read.schema(rows.schema).json(path)
    return back.withColumn("is_private", F.col("is_private").cast("string")).withColumn("is_hidden", F.col("is_hidden").cast("string"))


@query("n6_export_cells", f"select source_uid, {', '.join(_cell(c) + ' as ' + c for c in ('title', 'city', 'event_url', 'artwork_url'))} from ({EXPORT}) x")
def _(a):
    names = ["title", "city", "event_url", "artwork_url"]
    quoted = [F.concat(F.lit('"'), F.replace(R.csv_cell(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"')).alias(c) for c in names]
    return export_rows(a).select("source_uid", *quoted)


@query("s13_collector_layout", "select drop_id, token_id, source_uid, owner_address_norm from $tokens")
def _(a):
    path = scratch_path(a.spark, "collectors")
    S.write_collector_layout(a.tokens, path)
    return K.read_all(a.spark, path)


@query("k03_asked_owner_pages", """
  select owner_address_norm, token_id, source_uid, drop_id, n as page_rank, case when total > 24 then 1 else 0 end as has_next from (
    select *, row_number() over (partition by owner_address_norm order by token_id desc, source_uid desc) as n,
      count(*) over (partition by owner_address_norm) as total from $tokens) x
  where n <= 24 and owner_address_norm in (select owner_address_norm from $collections)""")
def _(a):
    path = scratch_path(a.spark, "owners")
    S.write_owner_layout(a.tokens, path)
    return B.owner_holdings(K.read_keys(a.spark, path, "owner_address_norm", a.collections.select("owner_address_norm")), per_key=24)


@query("k04_asked_drop_pages", """
  select drop_id, owner_address_norm, token_id, source_uid, minted_on, network, transfer_count, n as page_rank,
    case when total > 48 then 1 else 0 end as has_next from (
    select *, row_number() over (partition by drop_id order by token_id desc, source_uid desc, owner_address_norm desc) as n,
      count(*) over (partition by drop_id) as total from $tokens) x
  where n <= 48 and drop_id in (select drop_id from $suggested_drops where curation_status = 'approved')""")
def _(a):
    path = scratch_path(a.spark, "collectors")
    tokens = written(a.tokens, "tokens")  # worked out once for the copy and the details
    S.write_collector_layout(tokens, path)
    asked = written(a.suggested_drops.where("curation_status = 'approved'").select("drop_id").distinct(), "asked-drops")
    refs = K.read_keys(a.spark, path, "drop_id", asked)
    return B.drop_collectors(refs, O.only(tokens, asked, "drop_id"), per_key=48, parts=parts_for(tokens))


@query("s14_range_read", """
  select owner_address_norm, token_id, source_uid from $tokens where owner_address_norm >= '0x' || lpad('20', 40, '0') and owner_address_norm < '0x' || lpad('50', 40, '0')""")
def _(a):
    path = scratch_path(a.spark, "owners")
    S.write_owner_layout(a.tokens, path)
    bounds = ["0x" + digits.rjust(40, "0") for digits in ("20", "50")]
    return K.read_between(a.spark, path, "owner_address_norm", *bounds).select("owner_address_norm", "token_id", "source_uid")


@query("s14_address_prefixes", """
  select substr(address, 3, 1) as prefix, count(*) as n, sum(case when address >= '0x' || rpad(substr(address, 3, 1), 40, '0') then 1 else 0 end)::bigint as in_bounds
  from (select '0x' || substr(sha256(source_uid), 1, 40) as address from $tokens) x group by 1""")
def _(a):
    rows = a.tokens.select(F.concat(F.lit("0x"), F.substring(F.sha2("source_uid", 256), 1, 40)).alias("address"))
    tagged = S.with_prefix(rows, "address", 1)
    inside = F.lit(False)
    for digit in "0123456789abcdef":
        low, high = S.prefix_bounds(digit)
        span = F.col("address") >= low
        inside = inside | ((F.col("prefix") == digit) & (span if high is None else span & (F.col("address") < high)))
    return tagged.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if(inside).alias("in_bounds"))


@query("s15_id_shards", """
  select shard, count(*) as n, min(token_id) as low, max(token_id) as high from (
    select token_id, (select min(i) from range(0, 7) r(i) where token_id <= (u * (i + 1)) // 7) as shard from (select token_id, (select max(token_id) from $tokens) as u from $tokens) x) y group by shard""")
def _(a):
    upper = a.tokens.agg(F.max("token_id").alias("u")).scalar()
    sharded = a.tokens.select("token_id", S.id_shard(F.col("token_id"), upper, 7).alias("shard"))
    return sharded.groupBy("shard").agg(F.count("*").alias("n"), F.min("token_id").alias("low"), F.max("token_id").alias("high"))


@query("s16_file_inventory", """
  select path, drop_id, byte_length, sha256, outcome from (
    select 'art/' || drop_id || case when drop_id % 40 = 1 then '.png' else '.webp' end as path, case when drop_id % 40 <> 1 then drop_id end as drop_id, byte_length, sha256,
      case when drop_id % 40 = 1 then 'bad_name' when drop_id % 30 = 2 then 'duplicate' else 'ok' end as outcome from $artwork_files
    union all select 'old/' || drop_id || '.webp', drop_id, byte_length + 1, sha256, 'duplicate' from $artwork_files where drop_id % 30 = 2 and drop_id % 40 <> 1
    union all select 'old/' || drop_id || '.webp', drop_id, byte_length + 1, sha256, 'ok' from $artwork_files where drop_id % 30 = 2 and drop_id % 40 = 1) x""")
def _(a):
    c = F.col
    text = c("drop_id").cast("string")
    main = a.artwork_files.select(F.concat(F.lit("art/"), text, F.when(c("drop_id") % 40 == 1, ".png").otherwise(".webp")).alias("path"), "byte_length", "sha256")
    old = a.artwork_files.where("drop_id % 30 = 2").select(F.concat(F.lit("old/"), text, F.lit(".webp")).alias("path"), (c("byte_length") + 1).alias("byte_length"), "sha256")
    return S.inventory(main.unionByName(old))


@query("d21_raw_page_audit", """
  select 'order_invalid' as rule, 'pages' as entity, 'moments:' || page as key, '' as detail from $d21 group by page having max(page % 7) = 3 and count(*) > 1
  union all select 'nested_relation_unsafe', 'pages', 'moments:' || page, '' from $d21 where drops >= 2 group by page
  union all select 'page_gap', 'pages', 'moments:' || page, '' from $d21 where page % 11 = 6 group by page
  union all select 'row_count_mismatch', 'entities', 'moments', ''""", {
    "d21": """select (m.moment_id - 1) // 100 + 1 as page, coalesce(d.n, 0) as drops from $moments m left join (select moment_id, count(*) as n from $moment_drops group by 1) d on d.moment_id = m.moment_id
      where ((m.moment_id - 1) // 100 + 1) % 11 <> 5"""})
def _(a):
    pages = stored_pages(a)
    # Every seventh page is reversed, every eleventh is lost.
    tampered = pages.where("page % 11 <> 5").withColumn("rows", F.when(F.col("page") % 7 == 3, F.reverse("rows")).otherwise(F.col("rows")))
    claims = a.moments.agg(F.max("moment_id").alias("upper_bound"), F.count("*").alias("expected_rows")).select(F.lit("moments").alias("entity"), "*")
    return D.page_audit(tampered, claims, 2)


@query("d22_rebuilt_relations", """
  select moment_id, drop_id, case when drop_id < 1000000000 then 'removed' else 'added' end as change, '' as changed_columns
  from (select moment_id, drop_id from $moment_drops where moment_id % 250 = 0 union all select distinct moment_id, drop_id + 1000000000 from $moment_drops where moment_id % 260 = 0) x""")
def _(a):
    rebuilt, _bad = S.bridge_rows(S.page_rows(stored_pages(a)))
    extra = a.moment_drops.where("moment_id % 260 = 0").select("moment_id", (F.col("drop_id") + 1000000000).alias("drop_id"))
    stored = a.moment_drops.where("moment_id % 250 <> 0").unionByName(extra)
    mark = lambda df: df.withColumn("present", F.lit(1))
    return D.compare_rows(mark(rebuilt), mark(stored), ["moment_id", "drop_id"])


@query("d23_file_checksums")
def _(a):
    path = scratch_path(a.spark, "artifacts")
    a.tokens.write.parquet(path)
    found = S.read_listing(a.spark, path, "*.parquet").drop("content")
    low = found.agg(F.min("path").alias("p")).scalar()
    listed = found.withColumn("sha256", F.when(F.col("path") == low, F.lit("0" * 64)).otherwise(F.col("sha256")))
    return D.file_checksums(listed, found).withColumn("key", F.regexp_extract("key", "([^/]+)$", 1))
