"""The registered queries of the operators, with production parameters, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    brown_lm, chat_windows, decontamination, exact_dedup, filter_audit, mixing, ngram_join, prefix_trie, quality, token_counts, token_files,
    toxicity, url_filter,
)
from .common import fold, read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = toxicity.tag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), columns=["doc_id"])
    return tagged.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), columns=["doc_id"])
    ids = F.col("item_ids")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_windows.digests(chat_windows.format_windows(turns))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.summary(prefix_trie.build(*prefix_trie.rebuilt(turns)))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(read(spark, sf_dir, "documents"))
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_toxicity, op3_quality, op4_decontamination, op5_brown_lm,
        op6_token_counts, op7_chat_windows, op8_url_filter, op9_exact_dedup, op10_mixing,
        op11_filter_audit, op12_prefix_trie, op13_token_files,
    )
}

_LOWER = f"translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}')"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_SPACED = r"[^\x20\x09-\x0D]+"
_TERMS = " or ".join(f"contains(host, '{t}')" for t in url_filter.TERMS)

ORACLES: dict[str, str] = {
    "op4_decontamination": rf"""
with item as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_LOWER}, '{decontamination.WORD}') as w from benchmark),
gram as (select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as gram
         from (select item, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
doc as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{decontamination.WORD}') as w from documents),
spot as (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from doc, (select distinct size from gram) where len(w) >= size),
hit as (select r, i, spot.size, item from spot join gram on gram.size = spot.size and gram = array_to_string(w[i:i + spot.size - 1], ' ')),
word as (select r, count(distinct p) as n from (select r, unnest(range(i, i + size)) as p from hit) group by r),
named as (select r, count(distinct item) as n, sha256(string_agg(distinct item, ',' order by item)) as ids from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(word.n, 0) as bigint) as n_hit, cast(coalesce(named.n, 0) as bigint) as n_items,
       coalesce(ids, sha256('')) as items_sha256, coalesce(word.n, 0) > 0 as contaminated
from doc left join word using (r) left join named using (r)""",
    "op8_url_filter": f"""
with place as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
rule(verdict, h, p) as (values {_RULES}),
fit as (select page_id, host, path, max_by(struct_pack(rule := h || p, verdict := verdict), length(h || p)) as best
        from place join rule on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all),
listed as (select *, {_TERMS} as listed from place)
select l.page_id, l.host, l.path, best.rule as rule, coalesce(best.verdict, case when listed then 'block' else 'allow' end) as verdict, listed
from listed l left join (select distinct * from fit) f on l.page_id = f.page_id and l.host = f.host and l.path = f.path""",
    "op9_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""",
    "op11_filter_audit": rf"""
with doc as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
label as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels where doc_id is not null group by doc_id),
fail as (select part, len(w) < {filter_audit.LEAST_WORDS} as a, 100 * len(list_distinct(w)) < {filter_audit.LEAST_DISTINCT} * len(w) as b,
                100 * len(regexp_extract_all(t, '[A-Z]')) > {filter_audit.MOST_CAPITALS} * length(t) as c, regexp_matches(t, '{filter_audit.MARKS}') as d,
                coalesce(doc_id > min(doc_id) over (partition by t), false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
         from doc left join label using (doc_id)),
cell as (select part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) as failed,
                count(*) as n, sum(good) as good, sum(toxic) as toxic from fail group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
sequence as (select concat(a.x, b.x, c.x, d.x, e.x) as filter_order
             from letter a join letter b on b.x <> a.x join letter c on c.x not in (a.x, b.x) join letter d on d.x not in (a.x, b.x, c.x)
             join letter e on e.x not in (a.x, b.x, c.x, d.x)),
place as (select filter_order, step, filter_order[step] as own, filter_order[1:step - 1] as earlier from sequence, (select unnest(range(1, 6)) as step)),
spot as (select part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) as fails,
              failed <> '' and translate(failed, earlier, '') <> failed as gone from place, cell),
metric as (select part, filter_order, cast(step as int) as step, own,
                  cast(sum(if(not fails and not gone, n, 0)) as bigint) as kept, cast(sum(if(fails and not gone, n, 0)) as bigint) as removed,
                  cast(sum(if(fails and gone, n, 0)) as bigint) as redundant, cast(sum(if(failed = own, n, 0)) as bigint) as unique_fails,
                  cast(sum(if(fails and not gone, good, 0)) as bigint) as good_lost, cast(sum(if(fails and not gone, toxic, 0)) as bigint) as toxic_lost
           from spot group by part, filter_order, step, own)
select * exclude (own), cast(sum(removed) over (partition by part, own) as bigint) as shapley from metric""",
    "op12_prefix_trie": rf"""
with own as (select conv_id as c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first) as turns
             from conversations where conv_id is not null group by conv_id),
head as (select c, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 as h from own),
conv as (select a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) as seq from head a left join own b on b.c = a.c - a.c % 20),
step as (select c, seq, unnest(range(0, len(seq) + 1)) as d from conv),
node as (select seq[1:d] as path, d, min(c) as conv_id, count(*) as n, list(c order by c) filter (where len(seq) = d) as ended from step group by 1, 2),
child as (select path[1:d - 1] as path, count(*) as n from node where d > 0 group by 1),
known as (select node.*, coalesce(child.n, 0) as n_children, if(d = 0, 0, (node.n - 1) * len(regexp_extract_all(path[d].t, '{_SPACED}'))) as saved
          from node left join child using (path)),
up as (select path[1:k] as path, saved, n_children from (select *, unnest(range(0, d + 1)) as k from known)),
below as (select path, count(*) filter (where n_children = 0) as n_leaves, sum(saved) as saved from up group by path)
select k.conv_id, k.d as depth, p.conv_id as parent_conv_id, k.n as n_convs, k.n_children, n_leaves, cast(below.saved as bigint) as saved_tokens,
       sha256(coalesce(array_to_string(k.ended, ','), '')) as ends_sha256
from known k join below on below.path = k.path left join node p on p.d = k.d - 1 and p.path = k.path[1:k.d - 1]""",
}
