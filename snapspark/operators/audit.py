"""Integrity audits. Each returns violation rows (rule, entity, key, detail), so audits union into one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from .relations import union_all


def violation(rows: DataFrame, rule: Column | str, entity: str, key: Column, detail: Column | None = None) -> DataFrame:
    code = F.lit(rule) if isinstance(rule, str) else rule
    text = F.lit("") if detail is None else detail.cast("string")
    return rows.select(code.alias("rule"), F.lit(entity).alias("entity"), key.cast("string").alias("key"), text.alias("detail"))


def primary_key(rows: DataFrame, key: list[str], entity: str) -> DataFrame:
    """Keys with a NULL part, and keys held by more than one row."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    rule = F.when(null, "null_key").when(F.col("n") > 1, "duplicate_key")
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    bad = groups.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), entity, text, F.col("n"))


def check_constraints(rows: DataFrame, entity: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failed CHECK, from one pass over the table."""
    failed = F.array_compact(F.array(*[F.when(~cond, F.lit(name)) for name, cond in checks.items()]))
    bad = rows.withColumn("_rule", F.explode(failed))
    return violation(bad, F.col("_rule"), entity, F.col(key))


def foreign_keys(children: dict[str, tuple[DataFrame, str]], parent: DataFrame, target: str) -> DataFrame:
    """(name, checked, missing, empty) for all references to one parent, from one exchange of values.

    The references and the parent's own values are stacked and counted together by value, so the parent is dealt once and
    equal values of a child are counted before they are dealt. References of NULL are counted apart, in the tasks.
    """
    kind = parent.schema[target].dataType
    names = list(children)
    of = {name: child.select(F.col(column).cast(kind).alias("_v"), F.lit(i).alias("_i")) for i, (name, (child, column)) in enumerate(children.items())}
    stacked = union_all(parent.select(F.col(target).alias("_v"), F.lit(-1).alias("_i")), *of.values())
    # One row for each reference and value; NULL has its row for each reference as well.
    counts = stacked.groupBy("_v").agg(F.max(F.col("_i") == -1).alias("_k"), *[F.count_if(F.col("_i") == i).alias(f"_n{i}") for i in range(len(names))])
    empty = F.col("_v").isNull()
    total = lambda i, where: F.coalesce(F.sum(F.when(where, F.col(f"_n{i}"))), F.lit(0))
    totals = counts.agg(*[
        F.struct(F.lit(name).alias("name"), total(i, ~empty).alias("checked"), total(i, ~empty & ~F.col("_k")).alias("missing"), total(i, empty).alias("empty")).alias(f"_t{i}")
        for i, name in enumerate(names)])
    return totals.select(F.inline(F.array(*[F.col(f"_t{i}") for i in range(len(names))])))


def section_collections(items: DataFrame, links: DataFrame, sections: DataFrame) -> DataFrame:
    item = items.select("item_id", F.col("collection_id").alias("item_collection"))
    section = sections.select("section_id", F.col("collection_id").alias("section_collection"))
    linked = links.join(item, "item_id").join(section, "section_id")
    bad = linked.where(F.col("item_collection") != F.col("section_collection"))
    return violation(bad, "section_collection_mismatch", "item_sections", F.concat_ws(":", F.col("item_id").cast("string"), "section_id"))


def derived_arrays(view: DataFrame, items: DataFrame) -> DataFrame:
    """Collections whose listed drop ids differ from their items.

    Both sides are counted per (collection, drop), so no collection's ids are brought together.
    """
    listed = view.select("collection_id", F.explode("drop_ids").alias("drop_id"))
    both = union_all(
        listed.select("collection_id", "drop_id", F.lit(1).alias("l"), F.lit(0).alias("i")),
        items.select("collection_id", "drop_id", F.lit(0).alias("l"), F.lit(1).alias("i")),
    )
    pairs = both.groupBy("collection_id", "drop_id").agg(F.sum("l").alias("l"), F.sum("i").alias("i"))
    per = pairs.groupBy("collection_id").agg(
        F.sum("l").alias("listed"), F.sum("i").alias("items"), F.count_if(F.col("l") != F.col("i")).alias("different"),
        F.count_if(F.col("i") > 1).alias("duplicates"))
    rules = R.reasons(
        ("row_missing", (F.col("listed") == 0) & (F.col("items") > 0)),
        ("drop_ids_mismatch", (F.col("listed") > 0) & (F.col("different") > 0)),
        ("duplicate_membership", F.col("duplicates") > 0),
    )
    bad = per.withColumn("_rule", F.explode(rules))
    return violation(bad, F.col("_rule"), "collection_drop_ids", F.col("collection_id"), F.col("different"))


def collection_types(collections: DataFrame, artists: DataFrame, organizations: DataFrame) -> DataFrame:
    a = artists.select("collection_id").distinct().withColumn("_a", F.lit(True))
    o = organizations.select("collection_id").distinct().withColumn("_o", F.lit(True))
    rows = collections.join(a, "collection_id", "left").join(o, "collection_id", "left")
    has_a, has_o = F.coalesce("_a", F.lit(False)), F.coalesce("_o", F.lit(False))
    kind = F.coalesce("type", F.lit(""))
    valid = ((kind == "artist") & has_a & ~has_o) | ((kind == "organization") & has_o & ~has_a) | ((kind == "user") & ~has_a & ~has_o)
    return violation(rows.where(~valid), "type_relation_mismatch", "collections", F.col("collection_id"), kind)


def bridge_equals_nested(bridge: DataFrame, nested: DataFrame) -> DataFrame:
    """Bridge pairs that are not nested, and nested pairs without a bridge row."""
    b = bridge.select("moment_id", "drop_id").distinct().withColumn("_b", F.lit(1))
    n = nested.select(F.explode("drops").alias("d")).select("d.moment_id", "d.drop_id").distinct().withColumn("_n", F.lit(1))
    both = b.join(n, ["moment_id", "drop_id"], "full_outer")
    rule = F.when(F.col("_b").isNull(), "derivation_missing").when(F.col("_n").isNull(), "derivation_extra")
    bad = both.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), "moment_drops", F.concat_ws(":", F.col("moment_id").cast("string"), F.col("drop_id").cast("string")))


def orphans(child: DataFrame, column: str, parent: DataFrame, target: str, entity: str, key: str) -> DataFrame:
    bad = child.where(F.col(column).isNotNull()).join(parent.select(F.col(target).alias(column)).distinct(), column, "left_anti")
    return violation(bad, f"{column}_orphan", entity, F.col(key), F.col(column))


def nested_parent(rows: DataFrame, entity: str, key: str, children: str, pointer: str) -> DataFrame:
    """Nested children that point at another parent."""
    bad = rows.select(key, F.explode(children).alias("_c")).where(F.col(f"_c.{pointer}") != F.col(key))
    return violation(bad, "nested_parent_mismatch", entity, F.col(key), F.col(f"_c.{pointer}"))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's JSON; NULL fields are written out so that absent and NULL stay different rows."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def multiset_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (rows, bytes, digest) that depends on the multiset of rows, not on their order.

    Sums of 32-bit slices of the row digests are combined on the map side; equal digests mean equal multisets up
    to collisions. The digest is not that of an ordered byte stream.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = rows.select(F.octet_length(text).alias("_b"), F.sha2(text, 256).alias("_h"))
    slices = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(8)]
    total = hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("_b") + 1), F.lit(0)).alias("bytes"), *slices)
    packed = F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(8)])
    return total.select("rows", "bytes", F.sha2(packed, 256).alias("digest"))


def compare_captures(primary: dict[str, DataFrame], secondary: dict[str, DataFrame]) -> DataFrame:
    """Per artifact and field (rows, bytes, digest): both values and whether they agree."""
    def measure(tables: dict[str, DataFrame]) -> DataFrame:
        parts = []
        for name, df in tables.items():
            parts.append(multiset_digest(df, sorted(df.columns)).select(
                F.lit(name).alias("artifact"),
                F.explode(F.create_map(F.lit("rows"), F.col("rows").cast("string"), F.lit("bytes"), F.col("bytes").cast("string"),
                                       F.lit("digest"), F.col("digest"))).alias("field", "value")))
        return union_all(*parts)

    p = measure(primary).withColumnRenamed("value", "primary_value")
    s = measure(secondary).withColumnRenamed("value", "secondary_value")
    both = p.join(s, ["artifact", "field"], "full_outer")
    return both.withColumn("stable", R.flag(F.col("primary_value").eqNullSafe(F.col("secondary_value"))))


def compare_rows(primary: DataFrame, secondary: DataFrame, key: list[str]) -> DataFrame:
    """Added, removed and changed keys, with the columns that changed."""
    values = [c for c in primary.columns if c not in key]
    p = primary.select(*key, F.struct(*values).alias("_p"))
    s = secondary.select(*key, F.struct(*values).alias("_s"))
    both = p.join(s, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_p.{c}").eqNullSafe(F.col(f"_s.{c}")), F.lit(c)) for c in values]))
    state = F.when(F.col("_p").isNull(), "added").when(F.col("_s").isNull(), "removed").when(F.size(changed) > 0, "changed")
    marked = both.withColumn("change", state).where("change is not null")
    columns = F.when(F.col("change") == "changed", F.array_join(changed, ",")).otherwise(F.lit(""))
    return marked.select(*key, "change", columns.alias("changed_columns"))


def journal(expected: DataFrame, loaded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Shards missing from the journal, unknown to the plan, or recorded with other values."""
    e = expected.select(key, F.struct(*fields).alias("_e"))
    l = loaded.select(key, F.struct(*fields).alias("_l"))
    both = e.join(l, key, "full_outer")
    different = F.array_compact(F.array(*[F.when(~F.col(f"_e.{f}").eqNullSafe(F.col(f"_l.{f}")), F.lit(f)) for f in fields]))
    rule = F.when(F.col("_l").isNull(), "shard_missing").when(F.col("_e").isNull(), "shard_unknown").when(F.size(different) > 0, "shard_differs")
    bad = both.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), "import_shards", F.col(key), F.when(F.col("_rule") == "shard_differs", F.array_join(different, ",")).otherwise(""))


def journal_totals(loaded: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Journal row totals per table beside the tables' own counts."""
    logged = loaded.groupBy("table_name").agg(F.sum("row_count").alias("j"), F.lit(0).cast("bigint").alias("t"))
    counts = [df.agg(F.lit(0).cast("bigint").alias("j"), F.count("*").alias("t")).select(F.lit(n).alias("table_name"), "j", "t") for n, df in tables.items()]
    both = union_all(logged, *counts).groupBy("table_name").agg(F.sum("j").alias("journal_rows"), F.sum("t").alias("table_rows"))
    return both.withColumn("ok", R.flag(F.col("journal_rows") == F.col("table_rows")))


def arithmetic(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Named equalities between one-value frames."""
    parts = []
    for name, (left, right) in pairs.items():
        l, r = left.toDF("left_value"), right.toDF("right_value")
        parts.append(l.select(F.lit(name).alias("name"), F.coalesce("left_value", F.lit(0)).alias("left_value"),
                              F.coalesce(r.scalar(), F.lit(0)).alias("right_value")))
    return union_all(*parts).withColumn("ok", R.flag(F.col("left_value") == F.col("right_value")))


def shard_reconciliation(captured: DataFrame, final: DataFrame, shard: str) -> DataFrame:
    """Shards whose captured row count is not the final one; those are the ones to read again."""
    c = captured.groupBy(shard).agg(F.count("*").alias("captured"))
    f = final.groupBy(shard).agg(F.count("*").alias("final"))
    both = c.join(f, shard, "full_outer").na.fill(0, ["captured", "final"])
    return both.where(F.col("captured") != F.col("final"))


def projection_verdict(name: str, planned: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """(name, planned, loaded, missing, broken, ok): whether a loaded projection holds just the planned keys, each once.

    `broken` are loaded rows that no rule lets through, or that repeat a key.
    """
    p = planned.select(key).distinct().withColumn("_p", F.lit(1))
    counts = loaded.groupBy(key).agg(F.count("*").alias("_n"))
    both = p.join(counts, key, "full_outer")
    n, wanted = F.coalesce("_n", F.lit(0)), F.coalesce("_p", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = both.agg(
        total(wanted).alias("planned"), total(n).alias("loaded"), total(F.when((wanted == 1) & (n == 0), 1).otherwise(0)).alias("missing"),
        total(F.greatest(n - wanted, F.lit(0))).alias("broken"))
    return sums.select(F.lit(name).alias("name"), "*", R.flag((F.col("missing") == 0) & (F.col("broken") == 0)).alias("ok"))


def retry_list(captured: DataFrame, mismatches: DataFrame, shard: str, key: str) -> tuple[DataFrame, DataFrame]:
    """What a reset of the mismatched shards leaves, and per shard what is read again: rows taken out and the range of keys.

    A shard that the capture does not have at all is read again whole, without a range.
    """
    wrong = mismatches.select(shard)
    left = captured.join(wrong, shard, "left_anti")
    spans = captured.groupBy(shard).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    again = mismatches.join(spans, shard, "left").select(shard, F.col("captured").alias("removed"), "low", "high")
    return left, again


def manifest_consistency(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(collection, segment, count) claims against (collection, segment, record_id) rows."""
    per_id = records.groupBy("collection_id", "segment", "record_id").agg(F.count("*").alias("n"))
    measured = per_id.groupBy("collection_id", "segment").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))
    claims = manifest.groupBy("collection_id", "segment").agg(F.max("count").alias("count"), F.count("*").alias("listed"))
    both = claims.join(measured, ["collection_id", "segment"], "full_outer").na.fill(0, ["rows", "repeated"])
    rules = R.reasons(
        ("segment_missing", F.col("count").isNull() & (F.col("rows") > 0)),
        ("segment_repeated", F.col("listed") > 1),
        ("segment_count", F.col("count").isNotNull() & (F.col("count") != F.col("rows"))),
        ("record_id_repeated", F.col("repeated") > 0),
    )
    bad = both.withColumn("_rule", F.explode(rules))
    return violation(bad, F.col("_rule"), "export_manifest", F.concat_ws(":", F.col("collection_id").cast("string"), "segment"))


def page_audit(pages: DataFrame, claims: DataFrame, nested_limit: int) -> DataFrame:
    """Raw pages (entity, page, rows array) against (entity, upper_bound, expected_rows).

    A page is a bounded array, so order inside it is an array test; pages are chained by comparing the smallest id
    of each page with the largest id of the page before it.
    """
    ids = F.transform("rows", lambda r: r["id"])
    inner = F.exists(F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("a"),
                                  F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("b")), lambda p: p["b"] <= p["a"])
    unsafe = F.exists("rows", lambda r: r["drops"].isNull() | (F.size(r["drops"]) >= nested_limit))
    facts = pages.select("entity", "page", F.size(ids).alias("n"), F.coalesce(inner, F.lit(False)).alias("_disorder"),
                         F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"),
                         F.coalesce(unsafe, F.lit(False)).alias("_unsafe"))
    # Page numbers may have holes, so the chain runs over their rank.
    ranked = O.positions(facts, "entity", ["page"], "_seq")
    chained = O.with_previous(ranked, "entity", "_seq", ["last_id", "page"])
    rules = R.reasons(
        ("order_invalid", F.col("_disorder") | F.coalesce(F.col("first_id") <= F.col("prev_last_id"), F.lit(False))),
        ("page_gap", F.coalesce(F.col("prev_page"), F.lit(0)) + 1 != F.col("page")),
        ("nested_relation_unsafe", F.col("_unsafe")),
    )
    bad = chained.withColumn("_rule", F.explode(rules))
    per_page = violation(bad, F.col("_rule"), "pages", F.concat_ws(":", "entity", F.col("page").cast("string")))
    totals = facts.groupBy("entity").agg(F.sum("n").alias("_rows"), F.max("last_id").alias("_last")).join(claims, "entity", "full_outer")
    entity_rules = R.reasons(
        ("row_count_mismatch", ~F.col("_rows").eqNullSafe(F.col("expected_rows"))),
        ("upper_bound_mismatch", ~F.col("_last").eqNullSafe(F.col("upper_bound"))),
    )
    return per_page.unionByName(violation(totals.withColumn("_rule", F.explode(entity_rules)), F.col("_rule"), "entities", F.col("entity")))


def strict_order(rows: DataFrame, group: str, seq: str, key: str, entity: str) -> DataFrame:
    """Rows whose key is not greater than the key one place before them."""
    bad = O.with_previous(rows, group, seq, [key]).where(F.col(key) <= F.col(f"prev_{key}"))
    return violation(bad, "order_invalid", entity, F.concat_ws(":", F.col(group).cast("string"), F.col(seq).cast("string")))


def file_checksums(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, byte_length, sha256) list against the files found."""
    return journal(listed, found, "path", ["byte_length", "sha256"]).withColumn("entity", F.lit("files"))


def reached_limit(rows: DataFrame, entity: str, key: str, children: str, limit: int) -> DataFrame:
    """Parents whose nested list may have been cut by the fetch limit."""
    return violation(rows.where(F.size(children) >= limit), "nested_limit_reached", entity, F.col(key), F.size(children))
