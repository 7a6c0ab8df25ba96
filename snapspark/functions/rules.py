"""Column rules: small native expressions used by the table jobs and operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls as U

# Fixed values ---------------------------------------------------------------------------------
MEDIA_EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/avif": "avif",
    "image/heic": "heic",
    "image/x-adobe-dng": "dng",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/quicktime": "mov",
    "audio/mpeg": "mp3",
    "audio/mp4": "m4a",
    "audio/ogg": "ogg",
    "audio/wav": "wav",
    "audio/x-wav": "wav",
    "audio/flac": "flac",
    "audio/aac": "aac",
    "application/octet-stream": "bin",
}
MEDIA_STATUSES = ("pending", "public_stored", "private_stored", "missing", "quarantined", "failed")
MEDIA_STATUS_ALIASES = {
    "isolated": "private_stored",
    "private": "private_stored",
    "public": "public_stored",
    "not_found": "missing",
    "error": "failed",
    "quarantined_stored": "quarantined",
    "source_missing": "missing",
    "oversize": "failed",
    "unattempted": "pending",
}
STORED_STATUSES = ("public_stored", "private_stored", "quarantined_stored")
ADDRESS = "^0x[0-9a-fA-F]{40}$"
SHA256 = "^[0-9a-f]{64}$"
SNAPSHOT_ID = "^[a-z0-9][a-z0-9._-]{0,63}$"
MAX_SAFE_INTEGER = 2**53 - 1
MAX_URL_LENGTH = 2048


@dataclass(frozen=True)
class MediaHosts:
    """Hosts the archive trusts; give the archive's own."""

    original: str = "origin.example.org"
    thumbnail: str = "thumbs.example.org"
    hls: str = "hls.example.org"
    legacy: str = "legacy.example.org"
    trusted_images: tuple[str, ...] = ("images.example.org",)
    dead_images: str = "dead.example.org"
    recovered_images: str = "recovered.example.org"


def lookup(col: Column, mapping: dict[str, str]) -> Column:
    """Value of a fixed mapping, NULL when absent."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.create_map(*pairs)[col]


def flag(cond: Column) -> Column:
    """1 / 0, with NULL conditions read as 0."""
    return F.when(cond, 1).otherwise(0)


def safe_integer(col: Column, minimum: int | None = None) -> Column:
    """True when the value is present, inside the exactly representable range and not below `minimum`."""
    low = -MAX_SAFE_INTEGER if minimum is None else minimum
    return col.isNotNull() & col.between(low, MAX_SAFE_INTEGER)


def nonempty(col: Column) -> Column:
    return col.isNotNull() & (F.length(col) > 0)


def reasons(*rules: tuple[str, Column]) -> Column:
    """Array of the codes whose failure condition holds."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for code, failed in rules]))


def trimmed(col: Column) -> Column:
    """Without white space at the ends, as text tools see it: tabs, line ends, no-break spaces and byte order marks too."""
    return F.regexp_replace(col, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def escaped(text: str) -> str:
    """Text as a pattern that matches just itself."""
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def address(col: Column, trim: bool = False) -> Column:
    value = trimmed(col) if trim else col
    return F.when(value.rlike(ADDRESS), F.lower(value))


def content_type(col: Column) -> Column:
    value = F.lower(F.trim(F.substring_index(col, ";", 1)))
    return F.when(value == "image/jpg", "image/jpeg").when(value != "", value)


def media_extension(col: Column) -> Column:
    return lookup(F.lower(F.trim(col)), MEDIA_EXTENSIONS)


def media_kind(col: Column) -> Column:
    value = F.lower(col)
    return (
        F.when(value.startswith("image/"), "image")
        .when(value.startswith("video/"), "video")
        .when(value.startswith("audio/"), "audio")
        .otherwise("other")
    )


def media_status(col: Column) -> Column:
    """One of the six statuses, or NULL for a value outside the vocabulary."""
    mapped = F.coalesce(lookup(col, MEDIA_STATUS_ALIASES), col)
    return F.when(mapped.isin(*MEDIA_STATUSES), mapped)


def content_key(prefix: Column | str, sha: Column, extension: Column) -> Column:
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("/sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit("."), extension)


def moment_object_key(snapshot: str, target: str, sha: Column, extension: Column) -> Column:
    space = "original" if target == "public" else "private/original"
    return content_key(f"snapshots/{snapshot}/moments/{space}", sha, extension)


def public_media(snapshot: str, status: Column, key: Column, sha: Column, ctype: Column) -> Column:
    """Publishable only when stored publicly under exactly the content-addressed key."""
    expected = moment_object_key(snapshot, "public", sha, media_extension(ctype))
    return F.coalesce((status == "public_stored") & sha.rlike(SHA256) & (key == expected), F.lit(False))


def source_uid(prefix: str, item: Column, chain: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), item.cast("string"), F.lit(":"), chain)


def artwork_url(base: str, snapshot: str, drop_id: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/snapshots/{snapshot}/artwork/"), drop_id.cast("string"), F.lit(".webp"))


def archive_artwork_key(key: Column, snapshot: str, drop_id: Column) -> Column:
    return key == F.concat(F.lit(f"snapshots/{snapshot}/artwork/"), drop_id.cast("string"), F.lit(".webp"))


def content_addressed_key(key: Column, snapshot: str, space: str) -> Column:
    """The folder must be the digest prefix, the snapshot and family the expected ones."""
    pattern = rf"^snapshots/{escaped(snapshot)}/{space}/sha256/([0-9a-f]{{2}})/\1[0-9a-f]{{62}}\.(png|jpg|gif|webp|avif)$"
    return key.rlike(pattern)


def media_url(base: str, key: Column, valid: Column) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), F.concat(F.lit(base.rstrip("/") + "/"), key))


def card_artwork_url(base: str, key: Column, catalog: str, collections: str, drop_id: Column) -> Column:
    valid = archive_artwork_key(key, catalog, drop_id) | content_addressed_key(key, collections, "collections/drop-artwork")
    return media_url(base, key, valid)


def holding_artwork_url(base: str, key: Column, catalog: str, holdings: str, collections: str, drop_id: Column) -> Column:
    valid = (
        archive_artwork_key(key, catalog, drop_id)
        | content_addressed_key(key, collections, "collections/drop-artwork")
        | content_addressed_key(key, holdings, "holdings/drop-artwork")
    )
    return media_url(base, key, valid)


def safe_url(col: Column, https_only: bool = False) -> Column:
    """The URL in normal form (see `urls`) when it is short, http(s), with a host and free of credentials, else NULL."""
    schemes = ("https",) if https_only else ("http", "https")
    # Lengths are in UTF-16 units, as the archive counts them.
    units = F.length(col) + F.regexp_count(col, F.lit("[^\\x{0}-\\x{FFFF}]"))
    given = F.when(units <= MAX_URL_LENGTH, col)

    def whole(parts: Column) -> Column:
        return F.when(parts["scheme"].isin(*schemes) & ~parts["credentials"], U.written(parts))

    at_once = U.plain(given) & given.rlike(f"^(?:{'|'.join(schemes)}):")
    return F.when(at_once, given).otherwise(U.let(U.parse(given), whole))


def with_image_url(df: DataFrame, column: str, hosts: MediaHosts) -> DataFrame:
    """Add `url` (what to fetch, in normal form and without a fragment) and `code` (OK, REWRITTEN, or why it is refused); a
    known dead host is rewritten."""

    def judged(parts: Column) -> Column:
        fine = F.coalesce((parts["scheme"] == "https") & ~parts["credentials"] & parts["port"].isNull(), F.lit(False))
        code = (
            F.when(~fine, "INVALID_SOURCE_URL")
            .when(parts["host"] == hosts.dead_images, "REWRITTEN")
            .when(~parts["host"].isin(*hosts.trusted_images), "SOURCE_HOST_NOT_ALLOWED")
            .otherwise("OK")
        )
        moved = U.written(parts, F.lit(hosts.recovered_images), fragment=False)
        url = U.let(code, lambda c: F.when(c == "REWRITTEN", moved).when(c == "OK", U.written(parts, fragment=False)))
        return F.struct(code.alias("code"), url.alias("url"))

    return df.withColumn("_judged", U.let(U.parse(F.col(column)), judged)).select("*", "_judged.code", "_judged.url").drop("_judged")


def gateway_label(url: Column, media_key: Column, hosts: MediaHosts) -> Column:
    """original / thumbnail / hls / legacy / other, by exact URL text."""
    return (
        F.when(url == F.concat(F.lit(f"https://{hosts.original}/"), media_key), "original")
        .when(url == F.concat(F.lit(f"https://{hosts.thumbnail}/thumbnails/"), media_key, F.lit(".webp")), "thumbnail")
        .when(url == F.concat(F.lit(f"https://{hosts.hls}/"), media_key, F.lit("/"), media_key, F.lit(".m3u8")), "hls")
        .when(url.rlike(rf"^https://{escaped(hosts.legacy)}/[A-Za-z0-9._-]{{1,500}}$"), "legacy")
        .otherwise("other")
    )


def csv_cell(col: Column, any_space: bool = False) -> Column:
    """Neutralise spreadsheet formulas; NULL becomes an empty cell."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    lead = r"^(\s*[=+\-@])" if any_space else r"^([\t\r\n ]*[=+\-@])"
    return F.regexp_replace(text, lead, "'$1")


def canonical_instant(col: Column) -> Column:
    """ISO text with milliseconds and Z that names a real instant."""
    shape = col.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & (F.substring(col, 12, 2) < "24")
    return F.coalesce(shape & F.try_to_timestamp(col).isNotNull(), F.lit(False))


def piped(values: Column) -> Column:
    """A list column as one ` | ` separated cell; NULL elements become empty."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), " | ")


def private_value(col: Column) -> Column:
    """struct(value, is_private, known): only an explicit false opens a row."""
    text = col.cast("string")
    known = text.isNull() | text.isin("true", "false")
    return F.struct(
        F.when(known, text).alias("value"),
        F.when(text == "false", 0).otherwise(1).alias("is_private"),
        flag(known).alias("known"),
    )


def visibility(exists: Column, hidden: Column, private: Column) -> Column:
    return (
        F.when(~exists, "missing")
        .when(F.coalesce(hidden, F.lit(1)) != 0, "hidden")
        .when(F.coalesce(private, F.lit("")) != "false", "private")
        .otherwise("visible")
    )
