"""Fail-closed publication rules and the documents built from public rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from ..session import bucketed, written
from .aggregates import chain_key, preservation_state
from .relations import HEAVY_LISTS, IDS, busy_keys, dealt_ids, drop_collections, id_lists, single_ids, spread_join, union_all


def drop_scope(moment_drops: DataFrame, hidden: DataFrame) -> DataFrame:
    """Linked moments with `hidden` = 1 when any linked drop is hidden; one combined pass over the bridge."""
    marked = moment_drops.join(hidden.select("drop_id", F.lit(1).alias("_h")), "drop_id", "left")
    return marked.groupBy("moment_id").agg(F.max(F.coalesce("_h", F.lit(0))).alias("hidden"))


def public_moments(moments, visibility, moment_drops, hidden, suppressions) -> DataFrame:
    """Visible, linked to a drop, to no hidden drop, and not actively suppressed."""
    visible = visibility.where(F.col("is_public") == 1)
    open_links = drop_scope(moment_drops, hidden).where(F.col("hidden") == 0)
    stopped = suppressions.where(F.col("active") == 1)
    return (
        moments.join(visible, "moment_id", "left_semi")
        .join(open_links, "moment_id", "left_semi")
        .join(stopped, "moment_id", "left_anti")
    )


def public_capsules(capsules, visibility, suppressions) -> DataFrame:
    visible = visibility.where(F.col("is_public") == 1)
    return capsules.join(visible, "capsule_id", "left_semi").join(suppressions.where(F.col("active") == 1), "capsule_id", "left_anti")


def source_visibility(moments: DataFrame, moment_drops: DataFrame, hidden: DataFrame) -> DataFrame:
    """Publicity and scope label decided from the source relations alone."""
    joined = moments.select("moment_id").join(drop_scope(moment_drops, hidden), "moment_id", "left")
    scope = F.when(F.col("hidden") == 1, "hidden_drop").when(F.col("hidden") == 0, "drop_linked").otherwise("without_drop")
    return joined.select("moment_id", R.flag(F.col("hidden") == 0).alias("is_public"), scope.alias("source_scope"))


def merge_hidden(primary: DataFrame, generic: DataFrame | None = None) -> DataFrame:
    """Hidden drops with the earliest time and the lists naming them. Generic lists count only when passed."""
    lists = [primary.select("drop_id", "hidden_on", F.lit("moments").alias("source"))]
    if generic is not None:
        lists.append(generic.select("drop_id", "hidden_on", F.lit("drops").alias("source")))
    both = F.concat_ws("+", F.max(F.when(F.col("source") == "moments", "moments")), F.max(F.when(F.col("source") == "drops", "drops")))
    return union_all(*lists).groupBy("drop_id").agg(F.min("hidden_on").alias("hidden_on"), both.alias("source"))


def capsule_visibility(capsules: DataFrame, capsule_moments: DataFrame, public: DataFrame) -> DataFrame:
    linked = capsule_moments.join(public, "moment_id", "left_semi").select("capsule_id").distinct().withColumn("_ok", F.lit(1))
    joined = capsules.select("capsule_id").join(linked, "capsule_id", "left")
    scope = F.when(F.col("_ok") == 1, "linked_public_moment").otherwise("without_public_moment")
    return joined.select("capsule_id", R.flag(F.col("_ok") == 1).alias("is_public"), scope.alias("source_scope"))


def browse_moments(public, moment_drops, pairs, public_media, author=None, drop_id=None, collection_id=None, kind=None) -> DataFrame:
    """Public moments that meet every given filter."""
    rows = public
    if author is not None:
        rows = rows.where(F.col("author_address_norm") == author)
    if drop_id is not None:
        rows = rows.join(moment_drops.where(F.col("drop_id") == drop_id), "moment_id", "left_semi")
    if collection_id is not None:
        rows = rows.join(pairs.where(F.col("collection_id") == collection_id), "moment_id", "left_semi")
    if kind is not None:
        rows = with_media_kind(rows, public_media, kind)
    return rows


def with_media_kind(moments: DataFrame, public_media: DataFrame, kind: str) -> DataFrame:
    wanted = public_media.where(R.media_kind(F.col("archive_content_type")) == kind)
    return moments.join(wanted, "moment_id", "left_semi")


def scoped_counts(relation: DataFrame, public: DataFrame, scope: str) -> DataFrame:
    return relation.join(public, "moment_id", "left_semi").groupBy(scope).agg(F.count("*").alias("n"))


def capsule_relations(capsule_moments: DataFrame, capsules: DataFrame) -> DataFrame:
    return capsule_moments.join(capsules, "capsule_id")


def personal_counts(public: DataFrame, tags: DataFrame, capsules: DataFrame) -> DataFrame:
    """Authored and distinct tagged moments and owned capsules per address, from one stacked aggregate."""
    authored = public.select(F.col("author_address_norm").alias("address"), F.lit("authored_moments").alias("kind"))
    tagged = tagged_moments(tags, public).select(F.col("address_norm").alias("address"), F.lit("tagged_moments").alias("kind"))
    owned = capsules.select(F.col("owner_address_norm").alias("address"), F.lit("owned_capsules").alias("kind"))
    rows = union_all(authored, tagged, owned)
    kinds = ("authored_moments", "tagged_moments", "owned_capsules")
    return rows.groupBy("address").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def tagged_moments(tags: DataFrame, public: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Distinct public moments that tag each address."""
    pairs = O.only(tags, keys, "address_norm").select("address_norm", "moment_id").distinct()
    return pairs.join(public, "moment_id", "left_semi")


def collection_profiles(details, urls, media, sections, artists, organizations) -> DataFrame:
    """Collection documents: detail columns plus five ordered lists, in parts (`ordering.with_lists`)."""
    key = "collection_id"
    safe = urls.withColumn("url", R.safe_url(F.col("url")))
    lists = [
        O.Listed(safe, (("url_id", "asc"),), ["url_id", "url"], "urls"),
        O.Listed(media, (("role_rank", "asc"), ("role", "asc")), ["role", "object_key"], "media"),
        O.Listed(sections, (("position", "asc"), ("section_id", "asc")), ["section_id", "name"], "sections"),
        O.Listed(artists, (("artist_id", "asc"),), ["artist_id", "name"], "artists"),
        O.Listed(organizations, (("organization_id", "asc"),), ["organization_id"], "organizations"),
    ]
    return O.with_lists(details, key, lists)


def _summary(public, counts, previews, moment_drops, pairs) -> tuple[DataFrame, list[O.Listed]]:
    key = "moment_id"
    preview = previews.select(key, F.col("media_key").alias("preview_key"))
    rows = public.join(counts, key, "left").na.fill(0, ["source_media_count", "media_count"])
    rows = rows.withColumn("media_state", preservation_state(F.col("source_media_count"), F.col("media_count"))).join(preview, key, "left")
    drops = O.Listed(moment_drops, (("drop_id", "asc"),), ["drop_id"], "drops")
    return rows, [drops, O.Listed(pairs, (("collection_id", "asc"),), ["collection_id"], "collections")]


def moment_summaries(public, counts, previews, moment_drops, pairs) -> DataFrame:
    """Summary documents of public moments, in parts."""
    rows, lists = _summary(public, counts, previews, moment_drops, pairs)
    return O.with_lists(rows, "moment_id", lists)


def moment_details(public, counts, previews, moment_drops, pairs, public_media, links, tags, capsule_rows) -> DataFrame:
    """Detail documents: summaries plus media, links, tags and capsules in order, in parts."""
    rows, lists = _summary(public, counts, previews, moment_drops, pairs)
    media = public_media.where("moment_id is not null").withColumn("kind", R.media_kind(F.col("archive_content_type")))
    media_columns = ["media_key", "kind", "mime_type", "object_key", "byte_length", "duration_ms", "width", "height", "position"]
    safe_links = links.withColumn("url", R.safe_url(F.col("url"), https_only=True))
    sides = [
        O.Listed(media, (("position", "asc"), ("created_at", "asc"), ("media_key", "asc")), media_columns, "media"),
        O.Listed(safe_links, (("link_id", "asc"),), ["link_id", "url", "title"], "links"),
        O.Listed(tags, (("tag_id", "asc"),), ["tag_id", "address", "ens"], "tags"),
        O.Listed(capsule_rows, (("capsule_id", "asc"),), ["capsule_id", "external_id", "title", "url"], "capsules"),
    ]
    return O.with_lists(rows, "moment_id", [*lists, *sides])


def drop_statistics(ids: DataFrame, cards: DataFrame, chains: DataFrame) -> DataFrame:
    """Statistics per asked drop. Visibility is settled before the chain rows of the visible ids are read."""
    wanted = ids.select("drop_id").distinct()
    card = cards.select("drop_id", "is_hidden", "private_value", "token_count", "transfer_count", F.lit(1).alias("_card"))
    vis = R.visibility(F.col("_card").isNotNull(), F.col("is_hidden"), F.col("private_value"))
    classed = wanted.join(card, "drop_id", "left").withColumn("visibility", vis)
    visible = classed.where(F.col("visibility") == "visible").select("drop_id")
    rows = chains.join(visible, "drop_id", "left_semi").withColumn("chain_key", chain_key(F.col("chain")))
    # Chains are a short fixed vocabulary; a drop has one row per chain.
    by_chain = rows.groupBy("drop_id").agg(
        F.array_sort(F.collect_list(F.struct("chain_key", F.col("token_count").alias("tokens"), F.col("transfer_count").alias("transfers")))).alias("by_chain"))
    seen = F.col("visibility") == "visible"
    return classed.join(by_chain, "drop_id", "left").select(
        "drop_id", "visibility", F.when(seen, F.col("token_count")).alias("token_count"),
        F.when(seen, F.coalesce("transfer_count", F.lit(0))).alias("transfer_count"), "by_chain")


def held_drop_status(tokens: DataFrame, known: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct held drops per owner with whether any layer can show them."""
    pairs = O.dealt(tokens.select("owner_address_norm", "drop_id"), parts, "owner_address_norm", "drop_id").distinct()
    joined = pairs.join(known.select("drop_id", F.lit(1).alias("_k")), "drop_id", "left")
    status = F.when(F.col("_k") == 1, "available").otherwise("unavailable")
    return joined.select("owner_address_norm", "drop_id", status.alias("status"))


def personal_references(tokens, authored, tagged, moment_drops, owned_drops, parts: int | None = None) -> DataFrame:
    """(owner, drop) pairs a person refers to: held, through authored and tagged moments, through owned collections."""
    held = tokens.select(F.col("owner_address_norm").alias("owner"), "drop_id")
    moments = O.dealt(union_all(
        authored.select(F.col("author_address_norm").alias("owner"), "moment_id"),
        tagged.select(F.col("address_norm").alias("owner"), "moment_id"),
    ), parts, "moment_id").distinct()
    through = moments.join(moment_drops, "moment_id").select("owner", "drop_id")
    return O.dealt(union_all(held, through, owned_drops.select("owner", "drop_id")), parts, "owner", "drop_id").distinct()


def personal_collections(tokens, items, collections, authored, tagged, pairs, parts: int | None = None) -> DataFrame:
    """(owner, collection) pairs a person needs: memberships of held drops, owned, and through moments.

    The lists of collections of drops and moments are joined and dealt by owner as they are; only then are they pairs. `pairs`
    are distinct.
    """
    held = bucketed(tokens.select(F.col("owner_address_norm").alias("owner"), "drop_id"), "held_drops", "drop_id", made=DataFrame.distinct)
    member = spread_join(held, drop_collections(items), "drop_id", HEAVY_LISTS)
    owned = collections.where("owner_address_norm is not null").select(F.col("owner_address_norm").alias("owner"), "collection_id")
    moments = written(union_all(
        authored.select(F.col("author_address_norm").alias("owner"), "moment_id"),
        tagged.select(F.col("address_norm").alias("owner"), "moment_id"),
    ), "owner-moments")
    # A stored copy of a few MB may hold millions of rows: by its size on disk it would be broadcast.
    through = moments.hint("merge").join(id_lists(pairs, "moment_id", "collection_id"), "moment_id")
    lists = union_all(*[df.select("owner", *IDS) for df in (member, through)], single_ids(owned, "owner", "collection_id"))
    links = dealt_ids(lists, "owner", "collection_id", busy_keys("owner", held, moments, owned), parts)
    return links.distinct().select("owner", "collection_id")


def moment_associations(moments: DataFrame, owner: str, pairs: DataFrame) -> DataFrame:
    """(owner, collection, moment) rows; kept as rows because one collection may hold very many moments.

    `pairs` are distinct, so distinct (owner, moment) rows make distinct results, which are many times more.
    """
    owned = moments.select(F.col(owner).alias("owner"), "moment_id").distinct()
    return owned.join(pairs, "moment_id").select("owner", "collection_id", "moment_id")


def joined_text(values: Column, field: str) -> Column:
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.coalesce(v[field].cast("string"), F.lit(""))), ","), F.lit(""))
