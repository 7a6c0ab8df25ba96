"""Stored inverted index with layers, and AND / prefix matching for any number of queries at once.

An index is a folder of tables, each cut by `layer`:

* `postings` (token, doc_id), cut by `shard` too: ranges of (token, doc_id), sorted, so that a token lies in few shards and a
  frequent one is spread over several;
* `vocabulary` (token, shard, docs), sorted by token: which shards hold a token, and how many postings it has there;
* `documents` (doc_id, digest, tokens): the documents that the layer indexes;
* `dead` (doc_id, gone): documents of layer `gone` that this layer replaces or takes away;
* `commits`: one row, written last. A layer without it does not count and is written anew by the next update.

Layer 0 is the whole table. An update compares digests and writes one more layer with the changed documents alone.
Searches meet the vocabulary first, by ranges that the scan can skip row groups with, and then read just the shards found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from .audit import violation
from .relations import union_all

PREFIX = 3  # terms of this length and more match by prefix
RANGES = 64  # ranges of tokens a scan is asked for; more terms are covered by this many ranges

TABLES = {
    "postings": "token string, doc_id bigint, layer int, shard int",
    "vocabulary": "token string, shard int, docs bigint, layer int",
    "documents": "doc_id bigint, digest string, tokens int, layer int",
    "dead": "doc_id bigint, gone int, layer int",
}


def index(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct (token, doc). Tokens are made distinct inside each document, so the index needs no shuffle."""
    text = F.concat_ws(" ", *columns)
    return docs.select(F.col(key).alias("doc_id"), F.explode(X.tokens(text)).alias("token"))


def _texts(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.concat_ws(" ", *columns).alias("text")).withColumn("digest", F.sha2("text", 256))


def _write_layer(texts: DataFrame, dead: DataFrame, path: str, layer: int, shards: int | None) -> None:
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(rows: DataFrame, table: str, cut: str | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(cut) if cut else writer).parquet(f"{path}/{table}/layer={layer}")

    # Texts are cut into tokens once; dealing by range would do it again for its sample, and the counts once more.
    texts = written(texts.select("doc_id", "digest", X.tokens(F.col("text")).alias("tokens")), "index-tokens")
    rows = texts.select("doc_id", F.explode("tokens").alias("token"))
    ranged = rows.repartitionByRange(shards, "token", "doc_id").sortWithinPartitions("token", "doc_id")
    put(ranged.select("token", "doc_id", F.spark_partition_id().alias("shard")), "postings", "shard")
    posted = _read(spark, path, "postings").where(F.col("layer") == layer)
    # Counts of a token and shard; written by range of the token, so that row groups hold neighbouring tokens.
    counts = posted.groupBy("token", "shard").agg(F.count("*").alias("docs"))
    put(counts.repartitionByRange("token", "shard").sortWithinPartitions("token"), "vocabulary")
    put(texts.select("doc_id", "digest", F.size("tokens").alias("tokens")), "documents")
    put(dead.select("doc_id", "gone"), "dead")
    put(spark.range(1).select(F.lit(shards).alias("shards")), "commits")


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{path}/{table}")


def layers(spark: SparkSession, path: str) -> int:
    """Number of committed layers; one row each."""
    return spark.read.schema("shards int, layer int").parquet(f"{path}/commits").agg(F.max("layer")).first()[0] + 1


def write_index(docs: DataFrame, key: str, columns: list[str], path: str, shards: int | None = None) -> None:
    """Layer 0 of a new index over the texts of `columns`, joined by blanks. `key` must be unique and not NULL."""
    texts = _texts(docs, key, columns)
    none = texts.select("doc_id", F.lit(0).alias("gone")).limit(0)
    _write_layer(texts, none, path, 0, shards)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, digest, tokens, layer) of the documents as last indexed."""
    every = _read(spark, path, "documents").where(F.col("layer") < layers(spark, path))
    return every.join(_dead(spark, path), ["doc_id", "layer"], "left_anti")


def _dead(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "dead").where(F.col("layer") < layers(spark, path)).select("doc_id", F.col("gone").alias("layer"))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, token) of the documents as last indexed."""
    every = _read(spark, path, "postings").where(F.col("layer") < layers(spark, path))
    return every.join(_dead(spark, path), ["doc_id", "layer"], "left_anti").select("doc_id", "token")


def update_index(docs: DataFrame, key: str, columns: list[str], path: str, shards: int | None = None) -> bool:
    """Brings an index up to `docs` by one more layer of the changed documents; False if nothing has changed."""
    spark = docs.sparkSession
    texts = _texts(docs, key, columns)
    had = documents(spark, path).select("doc_id", F.col("digest").alias("_had"), F.col("layer").alias("gone"))
    both = had.join(texts.select("doc_id", "digest"), "doc_id", "full_outer").where(~F.col("_had").eqNullSafe(F.col("digest")))
    changes = written(both.select("doc_id", "gone", F.col("digest").isNotNull().alias("new")), "index-changes")
    if changes.isEmpty():
        return False
    changed = texts.join(changes.where("new").select("doc_id"), "doc_id", "left_semi")
    _write_layer(changed, changes.where("gone is not null"), path, layers(spark, path), shards)
    return True


def compact(spark: SparkSession, path: str, docs: DataFrame, key: str, columns: list[str], target: str, shards: int | None = None) -> None:
    """The documents of `docs` that the index knows as they are now, as layer 0 of a new index."""
    texts = _texts(docs, key, columns).join(documents(spark, path).select("doc_id", "digest"), ["doc_id", "digest"], "left_semi")
    _write_layer(texts.select("doc_id", "text", "digest"), texts.select("doc_id", F.lit(0).alias("gone")).limit(0), target, 0, shards)


# Searches -------------------------------------------------------------------------------------
def parsed(searches: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """(query, term, number of the term, terms of the query)."""
    out = []
    for name, raw in searches.items():
        found = sorted({X.fold_text(t) for t in X.parse_query(raw)})
        out += [(name, term, i, len(found)) for i, term in enumerate(found)]
    return out


def _after(prefix: str) -> str | None:
    """The first string above all that begin with `prefix`; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        if code <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None


def token_ranges(terms: list[str], most: int = RANGES) -> list[tuple[str, str | None]]:
    """At most `most` ranges [low, high) that hold every token some term can match."""
    spans = sorted({(t, _after(t) if len(t) >= PREFIX else t + "\0") for t in terms})
    size = -(-len(spans) // most)
    out = []
    for i in range(0, len(spans), size or 1):
        some = spans[i : i + size]
        highs = [high for _, high in some]
        out.append((some[0][0], None if None in highs else max(highs)))
    return out


def within(ranges: list[tuple[str, str | None]]) -> Column:
    test = F.lit(False)
    for low, high in ranges:
        one = F.col("token") >= low
        test = test | (one if high is None else one & (F.col("token") < high))
    return test


def find(spark: SparkSession, path: str, searches: dict[str, str]) -> DataFrame:
    """(query, doc_id) of the indexed documents in which every term of a query hits.

    A term of `PREFIX` characters or more hits the tokens that begin with it, a shorter one just itself. The scan of the
    vocabulary is given ranges of tokens, that of the postings these and the layers and shards in which the vocabulary found
    a token; what is collected for this is one number for each shard and layer.
    """
    rows = parsed(searches)
    asked = spark.createDataFrame(rows, "query string, term string, bit int, terms int")
    ranges = within(token_ranges([term for _, term, _, _ in rows]))
    words = _read(spark, path, "vocabulary").where(F.col("layer") < layers(spark, path)).where(ranges)
    exact = asked.where(F.length("term") < PREFIX).join(words, F.col("term") == F.col("token"))
    head = lambda c: F.substring(c, 1, PREFIX)
    begun = asked.where(F.length("term") >= PREFIX).join(words, head("term") == head("token")).where(F.startswith("token", "term"))
    columns = ["query", "bit", "terms", "token", "shard", "layer"]
    tokens = written(union_all(exact.select(*columns), begun.select(*columns)), "search-tokens")
    places = sorted({r["layer"] * (1 << 32) + r["shard"] for r in tokens.select("layer", "shard").distinct().collect()})
    read = _read(spark, path, "postings").where(F.col("layer").isin(sorted({p >> 32 for p in places}))).where(F.col("shard").isin(sorted({p & 0xFFFFFFFF for p in places})))
    hits = read.where(ranges).join(tokens, ["token", "shard", "layer"]).join(_dead(spark, path), ["doc_id", "layer"], "left_anti")
    full = hits.groupBy("query", "doc_id", "terms").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("_hit"))
    return full.where(F.col("_hit") == F.expr("shiftleft(1, terms) - 1")).select("query", "doc_id")


def freshness(docs: DataFrame, key: str, columns: list[str], path: str) -> DataFrame:
    """An index against its source: documents without a posting, indexed ones without a source, texts that have changed
    since, and documents whose postings are not as many as their tokens."""
    spark = docs.sparkSession
    now = _texts(docs, key, columns).select("doc_id", F.col("digest").alias("_now"))
    posted = postings(spark, path).groupBy("doc_id").agg(F.count("*").alias("_n"))
    had = documents(spark, path).join(posted, "doc_id", "left").select("doc_id", "digest", "tokens", F.coalesce("_n", F.lit(0)).alias("_n"))
    both = now.join(had, "doc_id", "full_outer")
    indexed = F.col("digest").isNotNull()
    rule = (
        F.when(indexed & F.col("_now").isNull(), F.when(F.col("_n") > 0, "indexed_without_source"))
        .when(~indexed | (F.col("_n") == 0), "not_indexed")
        .when(F.col("digest") != F.col("_now"), "stale")
        .when(F.col("tokens") != F.col("_n"), "postings_differ")
    )
    bad = both.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), "index", F.col("doc_id"))
