"""C: full-text index and search, on an index stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import search as T
from ..session import scratch_path
from .registry import query

IDX = "select distinct doc_id, strip_accents(lower(t)) as token from (select doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*')) as t from documents) x"
NAMES = "select distinct p_partkey + 1 as doc_id, lower(t) as token from (select p_partkey, unnest(regexp_extract_all(concat_ws(' ', p_name, p_type), '[A-Za-z0-9]+')) as t from part) x"
SEARCHES = {"ring": "Red RING", "prefix": "wid sma", "city": "large", "two": "re th"}




def stored(a, docs, key, columns):
    path = scratch_path(a.spark, "index")
    T.write_index(docs, key, columns, path)
    return path


def names(a):
    return a.part.select((F.col("p_partkey") + 1).alias("drop_id"), "p_name", "p_type")


def earlier(a):
    """The documents as an index of an earlier day may have had them: some missing, some with another text, some since gone."""
    missing = F.col("doc_id") % 70 == 3
    changed = F.when(F.col("doc_id") % 90 == 7, F.concat(F.lit("olden wording "), "text")).otherwise(F.col("text"))
    own = a.documents.where(~missing).select("doc_id", changed.alias("text"))
    gone = a.documents.where(F.col("doc_id") % 80 == 4).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("gone "), "text").alias("text"))
    return own.unionByName(gone)


@query("c13_token_index", f"select doc_id, token from ({IDX}) i")
def _(a):
    return T.postings(a.spark, stored(a, a.documents, "doc_id", ["text"]))


@query("c14_drop_search", f"""
  select q as query, d.drop_id, d.start_date from (values ('ring', ['red', 'ring']), ('prefix', ['wid', 'sma']), ('city', ['large'])) s(q, ts), $drops_base d
  where is_private = 0 and not exists (select 1 from (select unnest(ts) as term) u where not exists (
    select 1 from $names i where i.doc_id = d.drop_id and case when length(term) < 3 then i.token = term else starts_with(i.token, term) end))""", {"names": NAMES})
def _(a):
    searches = {k: v for k, v in SEARCHES.items() if k != "two"}
    hits = T.find(a.spark, stored(a, names(a), "drop_id", ["p_name", "p_type"]), searches)
    drops = B.public_drops(a.drops_base).select(F.col("drop_id").alias("doc_id"), "start_date")
    return hits.join(drops, "doc_id").select("query", F.col("doc_id").alias("drop_id"), "start_date").orderBy(F.desc("start_date"), F.desc("drop_id"))


HITS = """
  select 'two' as query, d.doc_id from (select distinct doc_id from $docidx) d where exists (select 1 from $docidx i where i.doc_id = d.doc_id and token = 're')
    and exists (select 1 from $docidx i where i.doc_id = d.doc_id and token = 'th')
  union all select 'accent', d.doc_id from (select distinct doc_id from $docidx) d where exists (select 1 from $docidx i where i.doc_id = d.doc_id and starts_with(token, 'elle'))
    and exists (select 1 from $docidx i where i.doc_id = d.doc_id and starts_with(token, 'ere'))"""
ASKED = {"two": "re th", "accent": "Elle ère"}


@query("c14_document_search", HITS, {"docidx": IDX})
def _(a):
    return T.find(a.spark, stored(a, a.documents, "doc_id", ["text"]), ASKED)


@query("c14_updated_search", HITS, {"docidx": IDX})
def _(a):
    path = stored(a, earlier(a), "doc_id", ["text"])
    T.update_index(a.documents, "doc_id", ["text"], path)
    return T.find(a.spark, path, ASKED | {"old": "olden wording", "gone": "gone"})


@query("c15_index_freshness", """
  with d as (select doc_id, coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false) as worded from documents)
  select case when doc_id % 70 = 3 or not worded and doc_id % 90 <> 7 then 'not_indexed' else 'stale' end as rule, 'index' as entity, doc_id::varchar as key, '' as detail
  from d where doc_id % 70 = 3 or not worded or doc_id % 90 = 7
  union all select 'indexed_without_source', 'index', (doc_id + 1000000000)::varchar, '' from d where doc_id % 80 = 4""")
def _(a):
    return T.freshness(a.documents, "doc_id", ["text"], stored(a, earlier(a), "doc_id", ["text"]))


@query("c15_index_update", f"select doc_id, token from ({IDX}) i")
def _(a):
    path = stored(a, earlier(a), "doc_id", ["text"])
    T.update_index(a.documents, "doc_id", ["text"], path)
    return T.postings(a.spark, path)
