"""Joins and set operations: layered drop metadata, star joins, memberships, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from ..session import bucketed, written

LAYER_COLUMNS = ["drop_id", "fancy_id", "title", "start_date", "end_date", "city", "country", "year",
                 "event_url", "image_url", "has_artwork", "token_count", "is_private", "is_hidden"]


def catalog_layer(drops: DataFrame, base: str, snapshot: str, include_private: bool = False) -> DataFrame:
    rows = drops if include_private else drops.where(F.col("is_private") == 0)
    url = R.artwork_url(base, snapshot, F.col("drop_id"))
    return rows.withColumn("image_url", url).withColumn("is_hidden", F.lit(0)).select(*LAYER_COLUMNS)


def card_layer(cards: DataFrame, base: str, catalog: str, collections: str, held_only: bool = True) -> DataFrame:
    """Private or hidden cards; an unnamed one gets a placeholder title."""
    rows = cards.where((F.col("is_private") == 1) | (F.col("is_hidden") == 1)) if held_only else cards
    url = R.card_artwork_url(base, F.col("image_object_key"), catalog, collections, F.col("drop_id"))
    return _layer(rows, url, "Private Drop #").withColumn(
        "is_private", R.flag(F.coalesce("private_value", F.lit("")) != "false")).select(*LAYER_COLUMNS)


def holding_layer(holding: DataFrame, base: str, catalog: str, holdings: str, collections: str) -> DataFrame:
    url = R.holding_artwork_url(base, F.col("image_object_key"), catalog, holdings, collections, F.col("drop_id"))
    return _layer(holding, url, "Archived Drop #").select(*LAYER_COLUMNS)


def _layer(rows: DataFrame, url: Column, placeholder: str) -> DataFrame:
    return (
        rows.withColumn("_url", url)
        .withColumn("has_artwork", R.flag(F.col("_url").isNotNull()))
        .withColumn("image_url", F.coalesce("_url", F.lit("")))
        .withColumn("title", F.coalesce("title", F.concat(F.lit(placeholder), F.col("drop_id").cast("string"))))
        .withColumn("fancy_id", F.coalesce("fancy_id", F.lit("")))
        .withColumn("token_count", F.coalesce("token_count", F.lit(0)))
        .withColumn("event_url", R.safe_url(F.col("event_url")))
    )


def with_fallback_artwork(presentation: Column, holding: Column) -> Column:
    """The presentation's own image; the holding image only when the presentation has none."""
    borrow = (presentation["has_artwork"] == 0) & (F.coalesce(holding["has_artwork"], F.lit(0)) == 1)
    return F.when(borrow, presentation.withField("image_url", holding["image_url"]).withField("has_artwork", F.lit(1))).otherwise(
        presentation
    )


def stack_layers(**layers: DataFrame) -> DataFrame:
    """One row per drop with one struct column per layer, from a single shuffle on the drop id."""
    fields = [c for c in LAYER_COLUMNS if c != "drop_id"]
    tagged = [df.select("drop_id", F.lit(name).alias("_layer"), F.struct(*fields).alias("_row")) for name, df in layers.items()]
    stacked = reduce(DataFrame.unionByName, tagged)
    # Drop ids are unique inside a layer, so each aggregate sees at most one row.
    picks = [F.max(F.when(F.col("_layer") == name, F.col("_row"))).alias(name) for name in layers]
    return stacked.groupBy("drop_id").agg(*picks)


def resolve_for_owner(layers: DataFrame) -> DataFrame:
    """Catalog, else private card, each with artwork fallback; else the holding drop."""
    shown = F.coalesce("catalog", "card")
    drop = F.when(shown.isNotNull(), with_fallback_artwork(shown, F.col("holding"))).otherwise(F.col("holding"))
    source = F.when(F.col("catalog").isNotNull(), "catalog").when(F.col("card").isNotNull(), "card").otherwise("holding")
    return layers.select("drop_id", source.alias("layer"), drop.alias("drop"))


def owner_tokens(tokens: DataFrame, layers: DataFrame, base: str, catalog: str) -> DataFrame:
    """Tokens with resolved drop metadata; unknown drops get a placeholder. The token table is joined once."""
    joined = tokens.join(resolve_for_owner(layers), "drop_id", "left")
    known = F.col("drop").isNotNull()
    fallback = F.concat(F.lit("Archived Drop #"), F.col("drop_id").cast("string"))
    return joined.select(
        *tokens.columns,
        F.coalesce("layer", F.lit("placeholder")).alias("layer"),
        F.coalesce(F.col("drop.title"), fallback).alias("title"),
        F.coalesce(F.col("drop.start_date"), F.lit("")).alias("start_date"),
        F.col("drop.city").alias("city"),
        F.coalesce(F.col("drop.year"), F.lit(0)).alias("year"),
        F.when(known, F.col("drop.image_url")).otherwise(R.artwork_url(base, catalog, F.col("drop_id"))).alias("image_url"),
        F.coalesce(F.col("drop.has_artwork"), F.lit(0)).alias("has_artwork"),
        F.coalesce(F.col("drop.token_count"), F.lit(0)).alias("drop_token_count"),
    )


def exact_drops(layers: DataFrame, stats: DataFrame) -> DataFrame:
    """Exact-id merge: holding fields override the presentation, artwork and reservations stay with it."""
    cat, card, hold = F.col("catalog"), F.col("card"), F.col("holding")
    shown = F.when(cat.isNull() | (cat["is_private"] == 1), F.coalesce(card, cat)).otherwise(cat)
    art = F.when(shown.isNotNull() & (shown["has_artwork"] == 1), shown).otherwise(F.coalesce(hold, shown))
    base = F.coalesce(hold, shown)
    merged = layers.withColumn("_shown", shown).withColumn("_base", base).withColumn("_art", art)
    total = stats.select("drop_id", "email_reservations_total")
    from_catalog = cat.isNotNull() & (cat["is_private"] == 0)
    return merged.join(total, "drop_id", "left").select(
        "drop_id",
        F.col("_base.title").alias("title"),
        F.col("_base.start_date").alias("start_date"),
        F.col("_base.city").alias("city"),
        F.col("_base.year").alias("year"),
        F.col("_base.token_count").alias("token_count"),
        F.col("_art.image_url").alias("image_url"),
        F.col("_art.has_artwork").alias("has_artwork"),
        F.greatest(F.coalesce(hold["is_private"], F.lit(0)), F.coalesce(F.col("_shown.is_private"), F.lit(0))).alias("is_private"),
        F.greatest(F.coalesce(hold["is_hidden"], F.lit(0)), F.coalesce(F.col("_shown.is_hidden"), F.lit(0))).alias("is_hidden"),
        F.when(from_catalog, F.coalesce("email_reservations_total", F.lit(0))).alias("catalog_reservations"),
    )


def export_records(tokens: DataFrame, layers: DataFrame, base: str, catalog: str, title_prefix: str = "Archived Item #") -> DataFrame:
    """Flat export rows. A catalog row uses only its own artwork; other rows may fall back to the holding image."""
    other = F.when(F.col("card").isNotNull(), with_fallback_artwork(F.col("card"), F.col("holding"))).otherwise(F.col("holding"))
    resolved = layers.select("drop_id", F.col("catalog").alias("cat"), F.when(F.col("catalog").isNull(), other).alias("alt"))
    joined = tokens.join(resolved, "drop_id", "left")

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"cat.{name}"), F.col(f"alt.{name}"))

    own_art = F.when(F.col("cat.has_artwork") == 1, R.artwork_url(base, catalog, F.col("drop_id")))
    alt_art = F.when(F.col("alt.image_url") != "", F.col("alt.image_url"))
    return joined.select(
        "source_uid", "token_id", "drop_id", "owner_address_norm", "network", "minted_on", "transfer_count",
        F.coalesce(either("title"), F.concat(F.lit(title_prefix), F.col("token_id").cast("string"))).alias("title"),
        F.coalesce(either("start_date"), F.lit("")).alias("start_date"),
        F.coalesce(either("end_date"), F.lit("")).alias("end_date"),
        either("city").alias("city"),
        either("country").alias("country"),
        R.safe_url(either("event_url")).alias("event_url"),
        F.coalesce(alt_art, own_art).alias("artwork_url"),
        F.coalesce(F.col("alt.is_private"), F.lit(0)).alias("is_private"),
        F.coalesce(F.col("alt.is_hidden"), F.lit(0)).alias("is_hidden"),
    )


def collection_details(collections, media, featured, verified, ui, organizations, base: str, snapshot: str) -> DataFrame:
    """Collections with publishable logo and banner, featured, verified and display settings; all by left joins."""
    stored = media.where((F.col("status") == "stored") & (F.col("eligible_for_publish") == 1))
    url = R.media_url(base, F.col("object_key"), R.content_addressed_key(F.col("object_key"), snapshot, "collections/media"))
    # Both roles come from one pass over the media instead of two joins.
    art = stored.where(F.col("role").isin("logo", "banner")).groupBy("collection_id").agg(
        F.max(F.when(F.col("role") == "logo", url)).alias("logo_url"),
        F.max(F.when(F.col("role") == "banner", url)).alias("banner_url"),
    )
    verifier = organizations.select(F.col("organization_id").alias("verified_by"), F.col("name").alias("verifier_name"))
    checked = verified.join(verifier, "verified_by", "left")
    return (
        collections.join(art, "collection_id", "left")
        .join(featured, "collection_id", "left")
        .join(checked, "collection_id", "left")
        .join(ui, "collection_id", "left")
    )


def memberships(items: DataFrame, collections: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct (collection, matched drop) pairs of the asked drops."""
    matched = O.only(items, keys, "drop_id").select("collection_id", "drop_id").distinct()
    return matched.join(collections.select("collection_id", "title"), "collection_id")


def item_sections(items: DataFrame, links: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of each item inside its own collection, in section order."""
    named = sections.select("section_id", "collection_id", F.col("position").alias("section_position"))
    linked = links.join(items.select("item_id", "collection_id"), "item_id").join(named, ["section_id", "collection_id"])
    ordered = F.array_sort(F.collect_list(F.struct("section_position", "position", "section_id")))
    return linked.groupBy("collection_id", "item_id").agg(ordered.alias("sections"))


def collection_map(moment_drops: DataFrame, items: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (moment, collection) pairs through shared drops; with `parts`, dealt by moment into so many partitions.

    What is dealt are the drops' lists of collections, as the pairs are many more.
    """
    if parts is None:
        pairs = items.select("drop_id", "collection_id").distinct()
        return moment_drops.join(pairs, "drop_id").select("moment_id", "collection_id").distinct()
    lists = id_lists(items.select("drop_id", "collection_id").repartition("drop_id").distinct(), "drop_id", "collection_id")
    linked = moment_drops.join(lists, "drop_id").select("moment_id", *IDS)
    return O.dealt(linked, parts, "moment_id").select("moment_id", listed_ids("collection_id")).distinct()


def collection_map_counts(moment_drops: DataFrame, collections: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Coverage counts of the bridge, (name, n) rows from one grouped pass for each table; `pairs` are distinct."""
    def counted(df: DataFrame, **numbers: str) -> DataFrame:
        row = df.agg(*[(F.count_distinct(column) if column else F.count("*")).alias(name) for name, column in numbers.items()])
        return row.unpivot([], list(numbers), "name", "n")

    known = items.select("drop_id").distinct().withColumn("_known", F.lit(1))
    matched = moment_drops.join(known, "drop_id", "left").agg(
        F.count("*").alias("moment_drop_relations"), F.count_distinct("moment_id").alias("moments_with_drop_relations"),
        F.count("_known").alias("matched_moment_drop_relations"))
    tables = [
        counted(collections, collections=""),
        counted(items, collections_with_drop_ids="collection_id", collection_drop_references="", unique_collection_drops="drop_id"),
        matched.unpivot([], matched.columns, "name", "n"),
        counted(pairs, mapped_moments="moment_id", mapped_collections="collection_id", moment_collection_pairs=""),
    ]
    return reduce(DataFrame.unionByName, tables)


def one_sided(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys present on one side only, with the side they are on."""
    l = left.select(*on).distinct().withColumn("_l", F.lit(1))
    r = right.select(*on).distinct().withColumn("_r", F.lit(1))
    both = l.join(r, on, "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return both.withColumn("side", side).where("side is not null").select(*on, "side")


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def collection_drop_union(items: DataFrame, artist_drops: DataFrame, artists: DataFrame, suggestions: DataFrame, parts: int | None = None) -> DataFrame:
    """Item, artist and approved suggestion drops of every collection, each pair once."""
    cols = ["collection_id", "drop_id"]
    by_artist = artist_drops.join(artists.select("artist_id", "collection_id"), "artist_id")
    approved = suggestions.where(F.col("curation_status") == "approved")
    return O.dealt(union_all(items.select(*cols), by_artist.select(*cols), approved.select(*cols)), parts, *cols).distinct()


def coverage_partition(referenced: DataFrame, available: DataFrame, unavailable: DataFrame, key: str | list[str], parts: int | None = None) -> DataFrame:
    """Every id with what is wrong about it: in both sets, in none, or not referenced at all.

    With a list of key columns, such as owner and drop, each owner's sets are checked apart.
    """
    keys = [key] if isinstance(key, str) else key

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("_set"))

    # Repeated keys need no DISTINCT of their own: the marks are a maximum.
    marks = union_all(tag(referenced, "referenced"), tag(available, "available"), tag(unavailable, "unavailable"))
    seen = O.dealt(marks, parts, *keys).groupBy(*keys).agg(*[F.max(F.col("_set") == n).alias(n) for n in ("referenced", "available", "unavailable")])
    rule = (
        F.when(F.col("available") & F.col("unavailable"), "overlap")
        .when(~F.col("referenced"), "unreferenced")
        .when(~F.col("available") & ~F.col("unavailable"), "missing")
    )
    return seen.withColumn("rule", rule).where("rule is not null").select(*keys, "rule")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


HEAVY_KEYS = 10_000  # keys that are spread at most; their rows are broadcast
HEAVY_PAIRS = 1_000_000  # pairs that one task makes of a key


def spread_join(left: DataFrame, right: DataFrame, on: str, pairs: int = HEAVY_PAIRS) -> DataFrame:
    """An inner join of which the pairs of one key are made by many tasks.

    Rows are counted by key on both sides first. A key with more than `pairs` pairs is heavy and cut into as many slices as it
    needs: rows of its larger side go to one slice each, those of the smaller side to all of them. The light keys are joined
    as they lie, so that a side that is stored by the key is not dealt again.
    """
    counts = [side.groupBy(on).agg(F.count("*").alias(f"_n{i}")) for i, side in enumerate((left, right))]
    sizes = counts[0].join(counts[1], on).withColumn("_pairs", F.col("_n0").cast("double") * F.col("_n1"))
    heavy = sizes.where(F.col("_pairs") > pairs).orderBy(F.desc("_pairs"), on).limit(HEAVY_KEYS)
    slices = F.least(F.ceil(F.col("_pairs") / pairs), F.greatest("_n0", "_n1")).cast("int")
    heavy = F.broadcast(written(heavy.select(on, slices.alias("_slices"), (F.col("_n0") >= F.col("_n1")).alias("_left_larger")), "heavy-keys"))
    light = left.join(heavy, on, "left_anti").join(right.join(heavy, on, "left_anti"), on)

    def dealt(side: DataFrame, spreads: Column) -> DataFrame:
        own = F.pmod(F.xxhash64(*side.columns), F.col("_slices")).cast("int")
        slice_of = F.when(spreads, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("_slices") - 1))
        return side.join(heavy, on).withColumn("_slice", F.explode(slice_of)).drop("_slices", "_left_larger")

    sides = dealt(left, F.col("_left_larger")), dealt(right, ~F.col("_left_larger"))
    return light.unionByName(sides[0].join(sides[1], [on, "_slice"]).drop("_slice"))


LIST_IDS = 100  # ids in one row of a list
IDS = ["_near", "_far"]  # a list of ids: of four bytes each, or in full where one does not fit into them
BUSY_ROWS = 100_000  # rows of one key that a task should meet
HEAVY_LISTS = 100_000  # pairs with a list that one task makes of a key


def _packed(ids: Column) -> list[Column]:
    lost = F.exists(ids, lambda x: x.isNotNull() & x.try_cast("int").isNull())
    return [F.when(~lost, F.transform(ids, lambda x: x.try_cast("int"))).alias(IDS[0]), F.when(lost, ids).alias(IDS[1])]


def id_lists(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, list): the values of distinct pairs in lists of at most `LIST_IDS`.

    A join that repeats the values of a key for each row of another table moves a row for each list then, not for each value.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(value)) - 1
    placed = pairs.select(key, F.col(value).cast("bigint").alias("_id"), F.floor(place / LIST_IDS).alias("_list"))
    lists = placed.groupBy(key, "_list").agg(F.collect_list(F.struct("_id")).alias("_ids"))  # as structs, NULL stays
    return lists.select(key, *_packed(F.transform("_ids", lambda x: x["_id"])))


def drop_collections(items: DataFrame) -> DataFrame:
    """(drop_id, list): the collections of each drop, in buckets of the drop."""
    return bucketed(items.select("drop_id", "collection_id"), "drop_collections", "drop_id", made=lambda rows: id_lists(rows.distinct(), "drop_id", "collection_id"))


def single_ids(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, list): each row's value as a list of its own."""
    return rows.select(key, *_packed(F.array(F.col(value).cast("bigint"))))


def listed_ids(name: str) -> Column:
    """The ids of a list, one row each."""
    return F.explode(F.coalesce(F.col(IDS[1]), F.col(IDS[0]).cast("array<bigint>"))).alias(name)


def busy_keys(key: str, *tables: DataFrame, rows: int = BUSY_ROWS) -> DataFrame:
    """(key, _slices): keys with more than `rows` rows in all tables, and the slices that their rows with lists are cut into."""
    counts = union_all(*[df.select(key) for df in tables]).groupBy(key).agg(F.count("*").alias("_n"))
    busy = counts.where(F.col("_n") > rows).orderBy(F.desc("_n"), key).limit(HEAVY_KEYS)
    return F.broadcast(written(busy.select(key, F.ceil(F.col("_n") / rows).cast("int").alias("_slices")), "busy-keys"))


def dealt_ids(lists: DataFrame, key: str, value: str, busy: DataFrame, parts: int | None) -> DataFrame:
    """(key, other columns, value, <value>_slice): the ids of lists, dealt by (key, slice) while they are still lists.

    All lists of a key go to one partition, those of a busy key are taken apart first and go to the slices of their ids. Equal
    (key, value) are in one slice, so a group by (key, slice, value) needs no other exchange.
    """
    part, others = f"{value}_slice", [c for c in lists.columns if c not in (key, *IDS)]
    near, far = (F.col(c) for c in IDS)
    ids = F.coalesce(far, near.cast("array<bigint>"))
    whole = F.array(F.struct(F.lit(0).alias(part), near.alias(IDS[0]), far.alias(IDS[1])))
    apart = F.transform(ids, lambda x: F.struct(
        F.pmod(F.xxhash64(x), F.col("_slices")).cast("int").alias(part), F.lit(None).cast("array<int>").alias(IDS[0]), F.array(x).alias(IDS[1])))
    cut = lists.join(busy, key, "left").select(key, *others, F.inline(F.when(F.col("_slices").isNull(), whole).otherwise(apart)))
    return O.dealt(cut, parts, key, part).select(key, *others, part, listed_ids(value))
