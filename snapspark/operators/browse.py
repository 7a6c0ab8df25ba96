"""Browse filters, projections, pages and exact lookups over the catalog, holdings and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from ..session import written

DROP_ORDERS: dict[str, O.Order] = {
    "recent": (("start_date", "desc"), ("drop_id", "desc")),
    "oldest": (("start_date", "asc"), ("drop_id", "asc")),
    "popular": (("token_count", "desc"), ("drop_id", "desc")),
}
HOLDING_ORDER: O.Order = (("token_id", "desc"), ("source_uid", "desc"))
COLLECTOR_ORDER: O.Order = (*HOLDING_ORDER, ("owner_address_norm", "desc"))
COLLECTION_ORDER: O.Order = (("updated_on", "desc"), ("collection_id", "desc"))
TOKEN_KEY = ["owner_address_norm", "token_id", "source_uid"]
TOKEN_DETAILS = ["minted_on", "network", "transfer_count"]
HOT_DROP = 50_000  # tokens of a drop that may lie in one partition
ROLE_RANK = {"logo": 1, "banner": 2, "mobile_banner": 3}


def public_drops(drops: DataFrame, year: int | None = None, kind: str | None = None) -> DataFrame:
    rows = drops.where(F.col("is_private") == 0)
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if kind is not None:  # an unknown type matches neither kind
        rows = rows.where(F.col("is_virtual") == {"virtual": 1, "in-person": 0}[kind])
    return rows


def drop_summary(drops: DataFrame, base: str, snapshot: str) -> DataFrame:
    return drops.select(
        "drop_id", "fancy_id", "title", "start_date", "city", "country",
        F.coalesce("year", F.lit(0)).alias("year"),
        "is_virtual",
        R.artwork_url(base, snapshot, F.col("drop_id")).alias("image_url"),
        R.flag(F.col("has_artwork") == 1).alias("has_artwork"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )


def with_drop_stats(drops: DataFrame, stats: DataFrame) -> DataFrame:
    """Detail rows: every drop with its reservation counts, 0 when it has none."""
    names = ["email_reservations_total", "email_reservations_minted", "email_reservations_unminted"]
    joined = drops.join(stats.select("drop_id", *names), "drop_id", "left")
    for name in names:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    return joined.withColumn("event_url", R.safe_url(F.col("event_url")))


def public_collections(
    collections: DataFrame, ui: DataFrame, year: int | None = None, kind: str = "all", searching: bool = False
) -> DataFrame:
    rows = collections
    if not searching:
        hidden = ui.where(F.col("is_visible_in_recent_list") == 0)
        rows = rows.join(hidden, "collection_id", "left_anti")
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if kind != "all":
        rows = rows.where(F.col("type") == kind)
    return rows


def collection_type(col: Column) -> Column:
    return F.when(col.isin("artist", "organization", "user"), col)


def lookup_ids(keys: DataFrame, drops: DataFrame) -> DataFrame:
    """Each asked id once with its drop; `available` is 0 for private and unknown ids."""
    public = drops.where(F.col("is_private") == 0).withColumn("_found", F.lit(1))
    joined = keys.select("drop_id").distinct().join(public, "drop_id", "left")
    return joined.withColumn("available", R.flag(F.col("_found").isNotNull())).drop("_found")


def search_text(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose whole record, as JSON with its nulls, contains the text without regard to case."""
    record = F.lower(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    return rows.where(record.contains(text.lower()))


def unpivot_branding(collections: DataFrame) -> DataFrame:
    """(id, collection, role, url) for every non-empty logo or banner URL."""
    long = collections.select(
        "collection_id",
        F.col("logo_image_url").alias("logo"),
        F.col("banner_image_url").alias("banner"),
    ).unpivot("collection_id", ["logo", "banner"], "role", "source_url")
    named = long.where(R.nonempty(F.col("source_url")))
    return named.withColumn("reference_id", F.concat_ws(":", F.col("collection_id").cast("string"), "role"))


def redacted_cards(cards: DataFrame, base: str, catalog: str, collections: str) -> DataFrame:
    """Cards with every field blanked unless visible; hidden wins over private."""
    vis = R.visibility(F.lit(True), F.col("is_hidden"), F.col("private_value"))
    seen = vis == "visible"
    shown = [c for c in ("fancy_id", "title", "description", "start_date", "end_date", "year", "city", "country",
                         "is_virtual", "token_count", "transfer_count", "featured_on", "moments_uploaded")]
    image = R.card_artwork_url(base, F.col("image_object_key"), catalog, collections, F.col("drop_id"))
    has_claims = F.coalesce("email_claims_minted", "email_claims_reserved", "email_claims_total").isNotNull()
    return cards.select(
        "drop_id",
        vis.alias("visibility"),
        *[F.when(seen, F.col(c)).alias(c) for c in shown],
        F.when(seen, R.safe_url(F.col("event_url"))).alias("event_url"),
        F.when(seen, image).alias("image_url"),
        F.when(seen, R.flag(has_claims)).alias("has_claims"),
    )


def drop_collectors(
    refs: DataFrame, tokens: DataFrame, keys: DataFrame | None = None, per_key: int | None = None, parts: int | None = None
) -> DataFrame:
    """Collectors of each drop through the drop-ordered copy of the tokens; a page is cut before the tokens are joined.

    With `parts` (`session.parts_for`), pages and tokens are dealt by drop into as many partitions and meet there, so that a
    page is not moved a second time; a reference must name the drop of its token. Drops with more than `HOT_DROP` tokens, and
    rows without a drop, are not dealt so: their pages are cut before an exchange and meet the tokens by the key of the
    tokens, as all pages do without `parts`.
    """
    wanted = O.only(refs, keys, "drop_id")
    if per_key is None:
        return _with_tokens(wanted, tokens)
    if parts is None:
        return _with_tokens(O.page_per_key(wanted, "drop_id", COLLECTOR_ORDER, per_key), tokens)
    hot = tokens.groupBy(F.col("drop_id").alias("_hot")).count().where((F.col("count") > HOT_DROP) | F.col("_hot").isNull())
    hot = written(hot.select("_hot"), "hot-drops")
    any_hot, is_hot = not hot.isEmpty(), F.col("drop_id").eqNullSafe(F.col("_hot"))
    calm = [df.join(hot, is_hot, "left_anti") if any_hot else df for df in (wanted, tokens)]
    dealt_refs, dealt_tokens = (O.dealt(df, parts, "drop_id") for df in calm)
    found = _with_tokens_there(O.page_per_key(dealt_refs, "drop_id", COLLECTOR_ORDER, per_key), dealt_tokens)
    if not any_hot:
        return found
    hot_refs, hot_tokens = (df.join(hot, is_hot, "left_semi") for df in (wanted, tokens))
    return found.unionByName(_with_tokens(O.page_per_key(hot_refs, "drop_id", COLLECTOR_ORDER, per_key), hot_tokens))


def _with_tokens(refs: DataFrame, tokens: DataFrame) -> DataFrame:
    return refs.join(tokens.select(*TOKEN_KEY, *TOKEN_DETAILS), TOKEN_KEY)


def _with_tokens_there(page: DataFrame, tokens: DataFrame) -> DataFrame:
    """`_with_tokens` for sides that are dealt by drop. Only the drop is a key of this join, as Spark would deal both sides again
    by a longer one; a token is compared with the rows of its drop's page."""
    own = tokens.select(F.col("drop_id").alias("_drop"), *[F.col(c).alias(f"_{c}") for c in TOKEN_KEY], *TOKEN_DETAILS)
    same = F.lit(True)
    for c in ("token_id", "source_uid", "owner_address_norm"):
        same = same & (F.col(f"_{c}") == F.col(c))
    joined = own.join(page, (F.col("_drop") == F.col("drop_id")) & F.coalesce(same, F.lit(False)))
    return joined.select(*TOKEN_KEY, *[c for c in page.columns if c not in TOKEN_KEY], *TOKEN_DETAILS)


def owner_holdings(tokens: DataFrame, keys: DataFrame | None = None, per_key: int | None = None) -> DataFrame:
    rows = O.only(tokens, keys, "owner_address_norm")
    return rows if per_key is None else O.page_per_key(rows, "owner_address_norm", HOLDING_ORDER, per_key)


def over_bound(rows: DataFrame, key: str, bound: int, rule: str, entity: str) -> DataFrame:
    """Audit rows for keys holding more rows than allowed; nothing is cut."""
    counts = rows.groupBy(key).count().where(F.col("count") > bound)
    return counts.select(
        F.lit(rule).alias("rule"),
        F.lit(entity).alias("entity"),
        F.col(key).cast("string").alias("key"),
        F.concat(F.col("count").cast("string"), F.lit(f" > {bound}")).alias("detail"),
    )


def with_role_rank(media: DataFrame) -> DataFrame:
    rank = F.coalesce(F.create_map(*[F.lit(v) for kv in ROLE_RANK.items() for v in kv])[F.col("role")], F.lit(4))
    return media.withColumn("role_rank", rank)
