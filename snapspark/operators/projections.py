"""Typed projections of captured entities from declarative field specs; violations name table and field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

# Field specs: column -> (source column, rule). Captured values arrive as text.
ID, INT, INT_NULL, COUNT, COUNT_NULL = "id", "int", "int_null", "count", "count_null"
TEXT, TEXT_NULL, TEXT_TRIM, FLAG, FLAG_NULL, LOWER, ADDRESS = "text", "text_null", "text_trim", "flag", "flag_null", "lower", "address"

COLLECTION_SPECS: dict[str, dict[str, tuple[str, str]]] = {
    "collections": {
        "collection_id": ("id", ID), "slug": ("slug", TEXT), "title": ("title", TEXT), "description": ("description", TEXT_NULL), "type": ("type", TEXT_NULL),
        "type_rank": ("type_rank", INT_NULL), "year": ("year", INT_NULL), "created_by": ("created_by", TEXT_NULL), "owner_address": ("owner_address", TEXT_NULL),
        "owner_address_norm": ("owner_address", ADDRESS), "external_url": ("external_url", TEXT_NULL), "logo_image_url": ("logo_image_url", TEXT_NULL),
        "banner_image_url": ("banner_image_url", TEXT_NULL), "created_on": ("created_on", TEXT), "updated_on": ("updated_on", TEXT)},
    "collection_items": {"item_id": ("id", ID), "collection_id": ("collection_id", ID), "drop_id": ("drop_id", ID), "created_on": ("created_on", TEXT_NULL)},
    "collection_sections": {"section_id": ("id", LOWER), "collection_id": ("collection_id", ID), "name": ("name", TEXT_NULL), "position": ("position", INT)},
    "collection_item_sections": {"item_id": ("item_id", ID), "section_id": ("section_id", LOWER), "position": ("position", INT)},
    "collection_urls": {"url_id": ("id", ID), "collection_id": ("collection_id", ID), "url": ("url", TEXT)},
    "collection_ui_settings": {
        "collection_id": ("collection_id", ID), "primary_color": ("primary_color", TEXT_NULL), "highlight_color": ("highlight_color", TEXT_NULL),
        "dark_color": ("dark_color", TEXT_NULL), "grey_color": ("grey_color", TEXT_NULL), "white_color": ("white_color", TEXT_NULL),
        "is_visible_in_recent_list": ("is_visible_in_recent_list", FLAG), "toggle_elements": ("toggle_elements", FLAG)},
    "collection_media": {
        "collection_id": ("collection_id", ID), "role": ("role", TEXT), "source_url": ("source_url", TEXT), "object_key": ("object_key", TEXT_NULL),
        "content_type": ("content_type", TEXT_NULL), "byte_length": ("byte_length", COUNT_NULL), "sha256": ("sha256", TEXT_NULL), "status": ("status", TEXT)},
    "collection_artists": {
        "artist_id": ("id", LOWER), "collection_id": ("collection_id", INT_NULL), "ens": ("ens", TEXT_NULL), "name": ("name", TEXT_NULL),
        "slug": ("slug", TEXT_NULL), "created_at": ("created_at", TEXT)},
    "collection_artist_drops": {"artist_id": ("artist_id", LOWER), "drop_id": ("drop_id", ID)},
    "collection_organizations": {
        "organization_id": ("id", ID), "collection_id": ("collection_id", INT_NULL), "name": ("name", TEXT), "slug": ("slug", TEXT), "created_on": ("created_on", TEXT)},
    "verified_collections": {"collection_id": ("collection_id", ID), "verified_by": ("verified_by", INT_NULL), "verified_on": ("verified_on", TEXT)},
    "featured_collections": {"collection_id": ("collection_id", ID), "featured_on": ("featured_on", TEXT)},
    "suggested_drops": {
        "suggestion_id": ("id", ID), "collection_id": ("collection_id", ID), "drop_id": ("drop_id", ID), "suggested_by": ("suggested_by", TEXT_NULL),
        "curation_status": ("curation_status", TEXT), "created_on": ("created_on", TEXT), "reviewed_on": ("reviewed_on", TEXT_NULL)},
    "collection_drop_cards": {
        "drop_id": ("id", ID), "fancy_id": ("fancy_id", TEXT), "title": ("name", TEXT), "description": ("description", TEXT_NULL), "start_date": ("start_date", TEXT),
        "end_date": ("end_date", TEXT), "year": ("year", INT), "city": ("city", TEXT_NULL), "country": ("country", TEXT_NULL), "is_virtual": ("virtual", FLAG_NULL),
        "channel": ("channel", TEXT_NULL), "platform": ("platform", TEXT_NULL), "timezone": ("timezone", TEXT_NULL)},
    "collection_drop_stats_by_chain": {
        "drop_id": ("drop_id", ID), "chain": ("chain", TEXT_NULL), "created_on": ("created_on", COUNT_NULL), "token_count": ("token_count", COUNT),
        "transfer_count": ("transfer_count", COUNT)},
}
MOMENT_SPECS: dict[str, dict[str, tuple[str, str]]] = {
    "moments": {
        "moment_id": ("id", LOWER), "display_id": ("display_id", TEXT_NULL), "author": ("author", TEXT_TRIM), "author_address_norm": ("author", ADDRESS),
        "description": ("description", TEXT_NULL), "cid": ("cid", TEXT_NULL), "token_id": ("token_id", TEXT_NULL), "legacy_drop_id": ("drop_id", INT_NULL),
        "created_on": ("created_on", TEXT), "updated_on": ("updated_on", TEXT_NULL), "updated": ("updated", FLAG_NULL)},
    "moment_media": {
        "media_key": ("key", LOWER), "moment_id": ("moment_id", TEXT_NULL), "mime_type": ("mime_type", TEXT_NULL), "source_hash": ("hash", TEXT_NULL),
        "source_status": ("status", TEXT), "byte_length": ("byte_length", COUNT_NULL)},
    "moment_links": {"link_id": ("id", ID), "moment_id": ("moment_id", LOWER), "title": ("title", TEXT_NULL), "url": ("url", TEXT_NULL)},
    "moment_user_tags": {"tag_id": ("id", ID), "moment_id": ("moment_id", LOWER), "address": ("address", TEXT_TRIM), "address_norm": ("address", ADDRESS), "ens": ("ens", TEXT_TRIM)},
    "capsules": {
        "capsule_id": ("id", ID), "external_id": ("external_id", TEXT_NULL), "owner": ("owner", TEXT_TRIM), "owner_address_norm": ("owner", ADDRESS),
        "title": ("title", TEXT_NULL), "url": ("url", TEXT_NULL), "created_on": ("created_on", TEXT)},
}


def _field(source: Column, rule: str) -> tuple[Column, Column]:
    """(typed value, failure condition) of one field."""
    text = source.cast("string")
    number = text.try_cast("bigint")
    whole = F.coalesce(text.rlike(r"^-?\d+$"), F.lit(False)) & R.safe_integer(number)
    absent = text.isNull()
    if rule == ID:
        return number, ~(whole & (number > 0))
    if rule == INT:
        return number, ~whole
    if rule == INT_NULL:
        return number, ~absent & ~whole
    if rule == COUNT:
        return number, ~(whole & (number >= 0))
    if rule == COUNT_NULL:
        return number, ~absent & ~(whole & (number >= 0))
    if rule == TEXT:
        return text, ~R.nonempty(text)
    if rule == TEXT_NULL:
        return text, F.lit(False)
    if rule == TEXT_TRIM:
        trimmed = R.trimmed(text)
        return F.when(trimmed != "", trimmed), F.lit(False)
    if rule == LOWER:
        return F.lower(text), ~R.nonempty(text)
    if rule == ADDRESS:
        return R.address(text, trim=True), F.lit(False)
    flag = F.when(text.isin("true", "1"), 1).when(text.isin("false", "0"), 0)
    return flag, (flag.isNull() if rule == FLAG else ~absent & flag.isNull())


def typed(rows: DataFrame, table: str, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """Every field typed by its rule, with `violations` naming the fields that broke it."""
    fields = {name: _field(F.col(source), rule) for name, (source, rule) in spec.items()}
    broken = R.reasons(*[(f"{table}.{name}", failed) for name, (_, failed) in fields.items()])
    return rows.select(*[value.alias(name) for name, (value, _) in fields.items()], broken.alias("violations"))


def flat_drop(rows: DataFrame) -> DataFrame:
    """Nested captured drops as flat rows; a hidden_drop record makes the row hidden, privacy fails closed."""
    private = R.private_value(F.col("private"))
    hidden = F.col("hidden_drop").isNotNull()
    broken = R.reasons(
        ("drops.id", ~R.safe_integer(F.col("id"), 1)),
        ("drops.fancy_id", F.col("fancy_id").isNull()),
        ("drops.name", F.col("name").isNull()),
        ("drops.start_date", ~R.nonempty(F.col("start_date"))),
        ("drops.end_date", ~R.nonempty(F.col("end_date"))),
        ("drops.private", private["known"] == 0),
    )
    return rows.select(
        F.col("id").alias("drop_id"), "fancy_id", F.col("name").alias("title"), "start_date", "end_date",
        private["value"].alias("private_value"), private["is_private"].alias("is_private"), R.flag(hidden).alias("is_hidden"),
        F.col("hidden_drop.hidden_on").alias("hidden_on"), broken.alias("violations"))
