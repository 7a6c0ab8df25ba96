"""SQL fragments shared by the DuckDB checks."""

from ..domain import CATALOG_SNAPSHOT, COLLECTIONS_SNAPSHOT, HOLDINGS_SNAPSHOT, MOMENTS_SNAPSHOT
from ..functions.rules import MEDIA_EXTENSIONS, MEDIA_STATUS_ALIASES, MEDIA_STATUSES


def _case(col: str, mapping: dict[str, str], other: str = "null") -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + f" else {other} end"


EXT_SQL = _case("lower(trim(archive_content_type))", MEDIA_EXTENSIONS)
STATUS_RAW = _case("raw_status", MEDIA_STATUS_ALIASES, "raw_status")
STATUS_SQL = f"case when ({STATUS_RAW}) in {MEDIA_STATUSES} then ({STATUS_RAW}) end"
PUBLIC_MEDIA = f"""(({STATUS_SQL}) = 'public_stored' and regexp_matches(archive_sha256, '^[0-9a-f]{{64}}$')
  and object_key = 'snapshots/{MOMENTS_SNAPSHOT}/moments/original/sha256/' || substr(archive_sha256, 1, 2) || '/' || archive_sha256 || '.' || ({EXT_SQL}))"""
CLASS_SQL = """case when c.drop_id is null then 'missing' when c.is_hidden <> 0 then 'hidden'
  when coalesce(c.private_value, '') <> 'false' then 'private' else 'visible' end"""


def key_ok(column: str, drop_id: str, snapshot: str, space: str) -> str:
    path = f"snapshots/{snapshot}/{space}/sha256/"
    return f"""(regexp_matches({column}, '^{path}[0-9a-f]{{2}}/[0-9a-f]{{64}}[.](png|jpg|gif|webp|avif)$')
      and substr({column}, {len(path) + 1}, 2) = substr({column}, {len(path) + 4}, 2))"""


def archive_key(column: str, drop_id: str) -> str:
    return f"({column} = 'snapshots/{CATALOG_SNAPSHOT}/artwork/' || {drop_id} || '.webp')"


CARD_KEY_OK = f"""coalesce({archive_key('image_object_key', 'drop_id')} or {key_ok('image_object_key', 'drop_id', COLLECTIONS_SNAPSHOT, 'collections/drop-artwork')}, false)"""
HOLD_KEY_OK = f"""coalesce({archive_key('image_object_key', 'drop_id')} or {key_ok('image_object_key', 'drop_id', COLLECTIONS_SNAPSHOT, 'collections/drop-artwork')}
  or {key_ok('image_object_key', 'drop_id', HOLDINGS_SNAPSHOT, 'holdings/drop-artwork')}, false)"""


def SAFE_URL(col: str, schemes: str = "https?") -> str:
    return f"case when length({col}) <= 2048 and regexp_matches({col}, '^(?i){schemes}://[^/?#@ ]+([/?#]|$)') then {col} end"
