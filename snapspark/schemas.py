"""Declared table shapes and CHECK constraints; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import rules as R

# DDL text, as readers take it.
SCHEMAS = {
    "drops": (
        "drop_id bigint, fancy_id string, title string, description string, start_date string, end_date string, city string, "
        "country string, event_url string, year int, is_virtual int, is_private int, channel string, platform string, "
        "location_type string, timezone string, created_at string"
    ),
    "raw_tokens": (
        "source_uid string, token_id bigint, drop_id bigint, minted_on bigint, owner_address string, network string, transfer_count bigint"
    ),
    "tokens": (
        "source_uid string, token_id bigint, drop_id bigint, minted_on bigint, owner_address_norm string, network string, transfer_count bigint"
    ),
    "email_stats": (
        "drop_id bigint, email_reservations_total bigint, email_reservations_minted bigint, email_reservations_unminted bigint"
    ),
    "raw_page": (
        "entity string, page bigint, response struct<data:struct<rows:array<struct<id:bigint,name:string,"
        "drops:array<struct<moment_id:bigint,drop_id:bigint>>>>>>"
    ),
    "moments": "id bigint, name string, drops array<struct<moment_id:bigint,drop_id:bigint>>",
}

# CHECK clauses per table: rule name -> condition every row must meet (NULL passes, as in SQL).
CHECKS: dict[str, dict[str, Column]] = {}


def checks() -> dict[str, dict[str, Column]]:
    """Built on first use because columns need a running session."""
    if not CHECKS:
        c = F.col
        CHECKS.update(
            {
                "drops": {
                    "drop_id_positive": c("drop_id") > 0,
                    "is_virtual_flag": c("is_virtual").isin(0, 1),
                    "is_private_flag": c("is_private").isin(0, 1),
                    "fancy_id_present": F.length("fancy_id") > 0,
                    "date_range": c("end_date") >= c("start_date"),
                },
                "tokens": {
                    "owner_shape": c("owner_address_norm").rlike("^0x[0-9a-f]{40}$"),
                    "minted_on_range": c("minted_on") >= 0,
                    "transfer_count_range": c("transfer_count") >= 0,
                },
                "moment_media": {
                    "status_known": R.media_status(c("raw_status")).isNotNull(),
                    "sha_shape": c("archive_sha256").rlike(R.SHA256),
                    "public_needs_object": ~((c("raw_status") == "public_stored") & (c("object_key").isNull() | c("archive_content_type").isNull())),
                },
                "collection_media": {
                    "role_known": c("role").isin("logo", "banner", "mobile_banner"),
                    "eligible_is_stored": ~((c("eligible_for_publish") == 1) & (c("status") != "stored")),
                },
            }
        )
    return CHECKS


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """For flat tables: stop before any job starts when a declared column is absent; otherwise project the declared shape."""
    wanted = [part.split()[0] for part in SCHEMAS[table].split(", ")]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df.select(*wanted)
