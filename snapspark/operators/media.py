"""Media planning: signatures, plans, capture logs, recovery strategies, manifests, object sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordering as O
from ..functions import rules as R
from .audit import violation
from .relations import union_all

PERMANENT_HTTP = (403, 404, 410)  # fixed values
TERMINAL_ARTWORK_HTTP = (401, 403, 404, 410)
TERMINAL_ARTWORK_CODES = ("EMPTY_SOURCE", "UNSUPPORTED_MEDIA")
CAPTURE_STATUSES = (*R.STORED_STATUSES, "source_missing", "oversize", "failed")


@dataclass(frozen=True)
class ArtworkHosts:
    """Where drop artwork may come from; `storage_prefix` is the older home of the same paths."""

    asset: str = "assets.example.org"
    storage: str = "storage.example.org"
    storage_prefix: str = "/media"


def detect_type(content: Column, declared: Column) -> Column:
    """Media type from the first bytes; ISO files and TIFF-based raws also need the declared type.

    Only the leading 36 bytes are looked at, whatever the size of the object.
    """
    head = F.hex(F.substring(content, 1, 36))

    def at(offset: int, *signatures: str) -> Column:
        out = F.lit(False)
        for s in signatures:
            out = out | (F.substring(head, 2 * offset + 1, len(s)) == s)
        return out

    def text(offset: int, *words: str) -> Column:
        return at(offset, *[w.encode().hex().upper() for w in words])

    kind = R.content_type(declared)
    # ISO brands are the bytes after the first eight; compared as text with other bytes blanked.
    brands = F.translate(F.decode(F.substring(content, 9, 28), "ISO-8859-1"), "\n", " ")
    iso = (
        F.when(brands.rlike("avif|avis"), "image/avif")
        .when(brands.rlike("heic|heix|hevc|hevx|heim|heis|mif1|msf1") & (kind == "image/heic"), "image/heic")
        .when(brands.rlike("M4A |M4B |M4P ") | kind.isin("audio/x-m4a", "audio/mp4"), "audio/mp4")
        .when(brands.rlike("qt  "), "video/quicktime")
        .otherwise("video/mp4")
    )
    second = F.conv(F.substring(head, 3, 2), 16, 10).cast("int")
    return (
        F.when(F.octet_length(content) < 4, None)
        .when(at(0, "FFD8FF"), "image/jpeg")
        .when(at(0, "89504E470D0A1A0A"), "image/png")
        .when(text(0, "GIF87a", "GIF89a"), "image/gif")
        .when(text(0, "RIFF") & text(8, "WEBP"), "image/webp")
        .when(text(0, "RIFF") & text(8, "WAVE"), "audio/wav")
        .when(text(0, "OggS"), "audio/ogg")
        .when(text(0, "fLaC"), "audio/flac")
        .when(text(0, "ID3") | (at(0, "FF") & (second.bitwiseAND(224) == 224)), "audio/mpeg")
        .when(at(0, "1A45DFA3"), "video/webm")
        .when(at(0, "49492A00", "4D4D002A") & (kind == "image/x-adobe-dng"), "image/x-adobe-dng")
        .when(text(4, "ftyp"), iso)
    )


def type_compatible(declared: Column, detected: Column) -> Column:
    kind = R.content_type(declared)
    return kind.isNull() | (kind == detected) | ((kind == "audio/x-m4a") & (detected == "audio/mp4"))


def labelled_gateways(gateways: DataFrame, hosts: R.MediaHosts) -> DataFrame:
    return gateways.withColumn("label", R.gateway_label(F.col("url"), F.col("media_key"), hosts))


def gateway_choices(gateways: DataFrame, hosts: R.MediaHosts) -> DataFrame:
    """Per media the first gateway (by id) of each label and how many originals there are, in one aggregate."""
    labelled = labelled_gateways(gateways, hosts)

    def first(label: str) -> Column:
        picked = F.when(F.col("label") == label, F.struct("gateway_id", "url", "type", "metadata"))
        return F.min_by(picked, F.when(F.col("label") == label, F.col("gateway_id"))).alias(label)

    return labelled.groupBy("media_key").agg(
        *[first(label) for label in ("original", "thumbnail", "hls", "legacy")],
        F.count_if(F.col("label") == "original").alias("originals"),
    )


def media_plan(media, moments, scope, gateways, hosts: R.MediaHosts) -> DataFrame:
    """One plan row per media: chosen original, why it may or may not be public, and where it goes.

    `scope` holds (moment_id, hidden) of moments linked to a drop.
    """
    # Facts per moment first: the media join them once, on a key that may be very uneven.
    known = moments.select("moment_id", F.lit(1).alias("_moment")).join(scope, "moment_id", "left")
    rows = media.join(known, "moment_id", "left")
    rows = rows.join(gateway_choices(gateways, hosts).select("media_key", "original", "originals"), "media_key", "left")
    eligibility = (
        F.when(F.col("_moment").isNull(), "orphan_media")
        .when(F.coalesce(F.col("source_status"), F.lit("")) != "PROCESSED", "source_not_processed")
        .when(F.col("hidden").isNull(), "moment_without_drop")
        .when(F.col("hidden") == 1, "hidden_drop")
        .otherwise("public")
    )
    size = F.get_json_object("original.metadata", "$.size").cast("bigint")
    public = F.col("eligibility") == "public"
    return rows.withColumn("eligibility", eligibility).select(
        "media_key",
        "moment_id",
        F.col("original.gateway_id").alias("gateway_id"),
        F.col("original.url").alias("source_url"),
        R.content_type(F.coalesce(F.col("original.type"), F.col("mime_type"))).alias("declared_content_type"),
        F.when(size > 0, size).alias("declared_byte_length"),
        "source_status",
        "eligibility",
        R.flag(public).alias("public_eligible"),
        F.when(F.col("original").isNotNull(), F.when(public, "public").otherwise("private")).alias("target"),
        F.greatest(F.coalesce("originals", F.lit(0)) - 1, F.lit(0)).alias("alternates"),
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count("*").alias("planned"),
        F.count("source_url").alias("source_available"),
        F.count_if(F.col("source_url").isNull()).alias("source_missing"),
        F.count_if(F.col("target") == "public").alias("public"),
        F.count_if(F.col("target") == "private").alias("private"),
        F.coalesce(F.sum("alternates"), F.lit(0)).alias("alternates"),
    )


def latest(log: DataFrame, key: str = "media_key", seq: str = "seq") -> DataFrame:
    """The last record of each key; one combined aggregate, however long a key's history is."""
    values = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("_r")).select(key, "_r.*")


def needs_recovery(status: Column, public_eligible: Column) -> Column:
    failed = status.isin("failed", "oversize", "source_missing")
    return F.coalesce(status.isNotNull() & (failed | ((public_eligible == 1) & (status != "public_stored"))), F.lit(False))


def requires_retry(status: Column, error: Column, http: Column) -> Column:
    permanent = F.coalesce((error == "SOURCE_HTTP_ERROR") & http.isin(*PERMANENT_HTTP), F.lit(False))
    return F.coalesce(status == "failed", F.lit(False)) & ~permanent


def capture_audit(log: DataFrame, plan: DataFrame, snapshot: str) -> DataFrame:
    """History rows whose status, routing or stored fields are not what the plan allows."""
    p = plan.select("media_key", F.col("target").alias("planned_target"), "public_eligible", F.lit(1).alias("_p"))
    rows = log.join(p, "media_key", "left")
    stored = F.col("status").isin(*R.STORED_STATUSES)
    public = (F.col("public_eligible") == 1) & (F.col("planned_target") == "public")
    private = (F.col("public_eligible") == 0) & (F.coalesce("planned_target", F.lit("")) != "public")
    routed = (
        ((F.col("status") == "public_stored") & public & (F.col("target") == "public"))
        | ((F.col("status") == "private_stored") & private & (F.col("target") == "private"))
        | ((F.col("status") == "quarantined_stored") & public & (F.col("target") == "private"))
    )
    extra = F.coalesce(F.col("target"), F.col("object_key"), F.col("sha256"), F.col("byte_length").cast("string"), F.col("content_type")).isNotNull()
    expected = F.when(F.col("target") == "public", R.moment_object_key(snapshot, "public", F.col("sha256"), R.media_extension(F.col("content_type")))).otherwise(
        R.moment_object_key(snapshot, "private", F.col("sha256"), R.media_extension(F.col("content_type"))))
    rules = R.reasons(
        ("unplanned", F.col("_p").isNull()),
        ("status_invalid", ~F.col("status").isin(*CAPTURE_STATUSES)),
        ("unstored_with_object", ~stored & extra),
        ("routing_invalid", stored & ~F.coalesce(routed, F.lit(False))),
        ("object_key_invalid", stored & ~F.coalesce(F.col("object_key") == expected, F.lit(False))),
    )
    bad = rows.withColumn("_rule", F.explode(rules))
    return violation(bad, F.col("_rule"), "capture_log", F.concat_ws(":", "media_key", F.col("seq").cast("string")))


def alias_members(media: DataFrame, choices: DataFrame, captured: DataFrame) -> DataFrame:
    """(digest, media) rows of media that share a digest and have an original, with their stored object.

    The candidates of a digest stay as rows; pairs of media are never formed.
    """
    stored = captured.where(F.col("status").isin(*R.STORED_STATUSES) & F.col("object_key").isNotNull()).select(
        "media_key", F.col("object_key").alias("stored_key"), F.col("sha256").alias("stored_sha"))
    hashed = media.where(F.col("source_hash").rlike(R.SHA256)).select("media_key", "source_hash")
    with_original = hashed.join(choices.where("original is not null").select("media_key", F.col("original.gateway_id").alias("gateway_id")), "media_key")
    rows = with_original.join(stored, "media_key", "left")
    same = F.col("stored_sha") == F.col("source_hash")
    return rows.select("source_hash", "media_key", "gateway_id", F.when(same, F.col("stored_key")).alias("preserved_key"))


def alias_summary(media: DataFrame, members: DataFrame) -> DataFrame:
    """Per media the number of other members with its digest, the first of them, and how many are preserved.

    The two smallest keys and the counts of a digest answer this for every member, so the work stays linear.
    """
    totals = members.groupBy("source_hash").agg(F.count("*").alias("_n"), F.count("preserved_key").alias("_preserved"))
    two = O.top_per_key(members.select("source_hash", "media_key"), "source_hash", (("media_key", "asc"),), 2, "_r")
    heads = two.groupBy("source_hash").agg(
        F.max(F.when(F.col("_r") == 1, F.col("media_key"))).alias("_k1"), F.max(F.when(F.col("_r") == 2, F.col("media_key"))).alias("_k2"))
    own = members.select("media_key", F.lit(1).alias("_own"), R.flag(F.col("preserved_key").isNotNull()).alias("_own_preserved"))
    # The media meet the per-digest facts in one last join, so AQE can split a digest that very many media share.
    facts = totals.join(heads, "source_hash")
    rows = media.select("media_key", "source_hash").join(own, "media_key", "left").join(facts, "source_hash")
    return rows.select(
        "media_key",
        "source_hash",
        (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("aliases"),
        F.when(F.col("_k1") == F.col("media_key"), F.col("_k2")).otherwise(F.col("_k1")).alias("first_alias"),
        (F.col("_preserved") - F.coalesce("_own_preserved", F.lit(0))).alias("preserved"),
    ).where("aliases > 0")


def recovery_strategies(plan: DataFrame, captured: DataFrame, choices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ordered strategies per media that needs recovery. Alias candidates are the members of the digest."""
    c = F.col
    rows = (
        captured.join(plan.select("media_key", "target", "public_eligible", "source_status", "eligibility").withColumnRenamed("target", "planned_target"), "media_key")
        .where(needs_recovery(c("status"), c("public_eligible")))
        .join(choices, "media_key", "left")
        .join(aliases.select("media_key", "first_alias", "aliases"), "media_key", "left")
    )
    public = (c("public_eligible") == 1) | (F.coalesce("planned_target", F.lit("")) == "public")
    target = F.when(public, "public").otherwise("private")
    retry = requires_retry(c("status"), c("error_code"), c("http_status"))
    gone = F.coalesce(c("http_status").isin(*PERMANENT_HTTP), F.lit(False))
    missing = c("status") == "source_missing"
    none = F.lit(None).cast("string")

    def strategy(kind, fidelity, goal, gateway, reason=none) -> Column:
        wrap = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(F.lit(kind).alias("kind"), F.lit(fidelity).alias("fidelity"), wrap(goal).alias("target"),
                        gateway.alias("gateway_id"), wrap(reason).alias("reason"))

    found = F.array_compact(F.array(
        F.when(c("original").isNotNull() & retry, strategy("retry_primary", "original", target, c("original.gateway_id"))),
        F.when(c("original").isNotNull() & (c("status") == "oversize"), strategy("multipart_original", "original", target, c("original.gateway_id"))),
        F.when(F.coalesce(c("http_status") == 403, F.lit(False)) & c("first_alias").isNotNull(),
               strategy("hash_alias_original", "original", target, c("first_alias"))),
        F.when(missing & c("legacy").isNotNull(), strategy("legacy_original", "original", target, c("legacy.gateway_id"))),
        F.when(c("thumbnail").isNotNull() & (missing | gone), strategy("thumbnail_derivative", "derivative", "private", c("thumbnail.gateway_id"))),
        F.when(c("hls").isNotNull() & ((c("status") == "oversize") | missing | gone),
               strategy("hls_derivative", "derivative", "private", c("hls.gateway_id"))),
    ))
    reason = F.when(c("source_status") == "INVALID", "invalid_media_without_recoverable_gateway").otherwise("no_fixed_recovery_candidate")
    fallback = (
        F.when(public, strategy("public_original_required", "none", "public", none, reason))
        .when(retry, strategy("private_recovery_required", "none", "private", none, "retryable_source_without_fixed_candidate"))
        .otherwise(strategy("metadata_only", "none", "private", none, reason))
    )
    return rows.select(
        "media_key", "status", "error_code", "http_status", target.alias("target"), "public_eligible",
        F.when(F.size(found) > 0, found).otherwise(F.array(fallback)).alias("strategies"))


def strategy_candidates(strategies: DataFrame, gateways: DataFrame, media: DataFrame, hosts: R.MediaHosts) -> DataFrame:
    """(media_key, kind, rank, gateway_id, source_url, required_sha256): every candidate of every strategy that fetches something.

    A legacy strategy has all legacy gateways of its media, in the order of their ids; the others have one candidate. What is
    fetched as an original must have the digest that the source gave for the media, if it gave one.
    """
    c = F.col
    rows = strategies.select("media_key", F.explode("strategies").alias("s")).select("media_key", "s.kind", "s.fidelity", "s.gateway_id").where("gateway_id is not null")
    legacy = c("kind") == "legacy_original"
    labelled = labelled_gateways(gateways, hosts)
    own = labelled.where(c("label") == "legacy").select("media_key", "gateway_id", c("url").alias("source_url"))
    ranked = O.positions(own, "media_key", ["gateway_id"], "rank")
    many = rows.where(legacy).drop("gateway_id").join(ranked, "media_key")
    urls = labelled.select("media_key", "gateway_id", c("url").alias("source_url"))
    one = rows.where(~legacy).join(urls, ["media_key", "gateway_id"], "left").withColumn("rank", F.lit(0).cast("bigint"))
    hashes = media.select("media_key", c("source_hash").alias("required_sha256"))
    joined = many.unionByName(one).join(hashes, "media_key", "left")
    required = F.when(c("fidelity") == "original", c("required_sha256"))
    return joined.select("media_key", "kind", "rank", "gateway_id", "source_url", required.alias("required_sha256"))


def effective_manifest(plan: DataFrame, captured: DataFrame, recovered: DataFrame) -> DataFrame:
    """The final state of every planned media: finished capture, recovered original, other stored capture, missing, as captured."""
    cap = captured.select("media_key", F.struct("status", "object_key", "sha256", "byte_length", "content_type").alias("cap"))
    rec = recovered.select("media_key", F.struct("status", "target", "quarantined", "object_key", "sha256", "byte_length", "content_type").alias("rec"))
    rows = plan.join(cap, "media_key", "left").join(rec, "media_key", "left")
    c = F.col
    public = (c("public_eligible") == 1) | (F.coalesce("target", F.lit("")) == "public")
    stored = F.coalesce(c("cap.status").isin(*R.STORED_STATUSES), F.lit(False))
    terminal = stored & (~public | (c("cap.status") == "public_stored"))
    original = F.coalesce(c("rec.status") == "original_stored", F.lit(False))
    planned = needs_recovery(c("cap.status"), c("public_eligible"))
    gone = planned & F.coalesce(c("rec.status").isin("derivative_stored", "metadata_only"), F.lit(False))
    rec_public = F.coalesce(c("rec.target") == "public", F.lit(False))
    status = (
        F.when(terminal, c("cap.status"))
        .when(original, F.when(rec_public, "public_stored").when(c("rec.quarantined") == 1, "quarantined_stored").otherwise("private_stored"))
        .when(stored, c("cap.status"))
        .when(gone, "source_missing")
        .otherwise(F.coalesce(c("cap.status"), F.lit("unattempted")))
    )
    use_rec = ~terminal & original
    blank = ~terminal & ~original & ~stored & gone

    def value(name: str) -> Column:
        return F.when(use_rec, c(f"rec.{name}")).when(~blank, c(f"cap.{name}"))

    key = F.when(use_rec, F.when(rec_public, c("rec.object_key"))).when(stored & (c("cap.status") == "public_stored"), c("cap.object_key"))
    done = F.when(public, original & rec_public & (c("rec.quarantined") != 1)).otherwise(
        F.coalesce(c("rec.status").isin("original_stored", "derivative_stored", "metadata_only"), F.lit(False)))
    return rows.select(
        "media_key", "public_eligible", key.alias("object_key"), value("sha256").alias("sha256"), value("byte_length").alias("byte_length"),
        value("content_type").alias("content_type"), status.alias("status"), R.flag(planned & ~terminal & ~done).alias("unresolved"))


def completeness(manifest: DataFrame) -> DataFrame:
    facts = manifest.agg(
        F.count_if(F.col("unresolved") == 1).alias("unresolved"),
        F.count_if((F.col("public_eligible") == 1) & (F.col("status") != "public_stored")).alias("not_public"),
        F.count_if(F.col("status").isin("failed", "oversize", "unattempted")).alias("open"),
    )
    return facts.select(
        "unresolved",
        R.flag((F.col("unresolved") == 0) & (F.col("not_public") == 0)).alias("projection_ready"),
        R.flag((F.col("unresolved") == 0) & (F.col("open") == 0)).alias("complete"))


def stored_objects(records: DataFrame) -> DataFrame:
    """One row per (target, object key); `conflict` marks keys whose records disagree about the object."""
    descriptor = F.struct("sha256", "byte_length", "content_type")
    grouped = records.groupBy("target", "object_key").agg(
        F.min(descriptor).alias("_lo"), F.max(descriptor).alias("_hi"), F.count("*").alias("references"))
    return grouped.select("target", "object_key", F.col("_lo.sha256").alias("sha256"), F.col("_lo.byte_length").alias("byte_length"),
                          "references", R.flag(F.col("_lo") != F.col("_hi")).alias("conflict"))


def artwork_actions(referenced: DataFrame, archive: DataFrame, seed: DataFrame, reuse: DataFrame) -> DataFrame:
    """Exactly one action per referenced drop, first match: archive, seed, collection-reuse, capture."""
    names = {"archive": archive, "seed": seed, "collection-reuse": reuse}
    marks = union_all(
        referenced.select("drop_id", F.lit("referenced").alias("_m")),
        *[df.select("drop_id", F.lit(n).alias("_m")) for n, df in names.items()])
    sets = marks.groupBy("drop_id").agg(*[F.max(F.col("_m") == n).alias(f"_{i}") for i, n in enumerate(["referenced", *names])])
    action = F.when(F.col("_1"), "archive").when(F.col("_2"), "seed").when(F.col("_3"), "collection-reuse").otherwise("capture")
    return sets.where("_0").select("drop_id", action.alias("action"))


def legacy_twin(url: Column, hosts: ArtworkHosts) -> Column:
    plain = url.rlike(rf"^https://{R.escaped(hosts.asset)}(/[^?#]*)?$")
    return F.when(plain, F.concat(F.lit(f"https://{hosts.storage}{hosts.storage_prefix}"), F.regexp_extract(url, r"^https://[^/]+(.*)$", 1)))


def canonical_source(url: Column, hosts: ArtworkHosts) -> Column:
    asset, storage = R.escaped(hosts.asset), R.escaped(hosts.storage + hosts.storage_prefix)
    return F.coalesce(url.rlike(rf"^https://({asset}(/[^?#@]*)?|{storage}/[^?#@]*)$"), F.lit(False))


def source_candidates(raw_json: Column, source_url: Column, hosts: ArtworkHosts) -> Column:
    """Gateway originals each with its twin, then the twin and the image URL; only canonical ones, first kept."""
    shape = "drop_image struct<gateways:array<struct<id:string,type:string,url:string>>>"
    gateways = F.from_json(raw_json, shape)["drop_image"]["gateways"]
    originals = F.filter(F.coalesce(gateways, F.array()), lambda g: g["type"] == "ORIGINAL")
    listed = F.flatten(F.transform(originals, lambda g: F.array(g["url"], legacy_twin(g["url"], hosts))))
    every = F.concat(listed, F.array(legacy_twin(source_url, hosts), source_url))
    return F.array_distinct(F.filter(every, lambda u: u.isNotNull() & canonical_source(u, hosts)))


def terminal_unavailable(status: Column, candidates: Column, attempts: Column) -> Column:
    """Failed, every candidate tried in order, each with a permanent failure."""
    def permanent(a: Column) -> Column:
        return a["code"].isin(*TERMINAL_ARTWORK_CODES) | ((a["code"] == "SOURCE_HTTP_ERROR") & a["http"].isin(*TERMINAL_ARTWORK_HTTP))

    tried = F.transform(attempts, lambda a: a["url"])
    return (status == "failed") & (tried == candidates) & F.forall(attempts, lambda a: F.coalesce(permanent(a), F.lit(False)))


def gateway_candidates(raw_json: Column, image_url: Column) -> Column:
    """Gateway originals, then the image URL, each URL once."""
    shape = "drop_image struct<gateways:array<struct<id:string,type:string,url:string>>>"
    gateways = F.coalesce(F.from_json(raw_json, shape)["drop_image"]["gateways"], F.array())
    originals = F.transform(F.filter(gateways, lambda g: (g["type"] == "ORIGINAL") & g["url"].isNotNull()), lambda g: g["url"])
    image = F.when(R.nonempty(image_url), F.array(image_url)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(originals, image))


def publication_plan(lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of object lists (kind -> (rows, disposition)), unique by key, conflicts marked."""
    columns = ["key", "sha256", "byte_length"]
    rows = union_all(*[df.select(*columns).withColumn("kind", F.lit(k)).withColumn("disposition", F.lit(d)) for k, (df, d) in lists.items()])
    descriptor = F.struct("kind", "disposition", "sha256", "byte_length")
    grouped = rows.groupBy("key").agg(F.min(descriptor).alias("_lo"), F.max(descriptor).alias("_hi"))
    return grouped.select("key", "_lo.*", R.flag(F.col("_lo") != F.col("_hi")).alias("conflict"))


def artwork_references(plan: DataFrame, captured: DataFrame) -> DataFrame:
    """Status per planned artwork: reused when the archive has it, else the capture's status, else pending."""
    rows = plan.join(captured.select("drop_id", F.col("status").alias("_s")), "drop_id", "left")
    status = F.when(F.col("reuse_key").isNotNull(), "reused").otherwise(F.coalesce("_s", F.lit("pending")))
    return rows.select("drop_id", status.alias("status"))


def archive_objects(files: DataFrame, drops: DataFrame, snapshot: str, base: str) -> DataFrame:
    """Object manifest of the image inventory with catalog presence and publish eligibility."""
    known = drops.select("drop_id").distinct().withColumn("_k", F.lit(1))
    rows = files.join(known, "drop_id", "left")
    key = F.concat(F.lit(f"snapshots/{snapshot}/artwork/"), F.col("drop_id").cast("string"), F.lit(".webp"))
    return rows.select("drop_id", key.alias("object_key"), R.artwork_url(base, snapshot, F.col("drop_id")).alias("public_url"),
                       R.flag(F.col("_k").isNotNull()).alias("catalog_exists"),
                       R.flag(F.col("_k").isNotNull() & (F.col("state") == "ok")).alias("eligible"))


def recovery_coverage(plan: DataFrame, captured: DataFrame, recovery: DataFrame, fields: list[str]) -> DataFrame:
    """Recovery rows missing, extra, or disagreeing with the capture they answer."""
    expected = captured.join(plan.select("media_key", "public_eligible"), "media_key").where(needs_recovery(F.col("status"), F.col("public_eligible")))
    e = expected.select("media_key", F.struct(*fields).alias("_e"))
    a = recovery.select("media_key", F.struct(*fields).alias("_a"))
    both = e.join(a, "media_key", "full_outer")
    different = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}")), F.lit(f)) for f in fields])), ",")
    rule = F.when(F.col("_a").isNull(), "recovery_missing").when(F.col("_e").isNull(), "recovery_extra").when(different != "", "recovery_differs")
    bad = both.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), "recovery_plan", F.col("media_key"), F.when(F.col("_rule") == "recovery_differs", different).otherwise(""))


def recovery_audit(log: DataFrame, plan: DataFrame, recovery: DataFrame) -> DataFrame:
    """Recovery history rows that their plan and strategy do not allow."""
    c = F.col
    p = plan.select("media_key", c("target").alias("planned_target"), c("public_eligible").alias("planned_eligible"), F.lit(1).alias("_p"))
    r = recovery.select("media_key", "strategies", c("target").alias("recovery_target"), F.lit(1).alias("_r"))
    rows = log.join(p, "media_key", "left").join(r, "media_key", "left")
    used = F.try_element_at(F.filter("strategies", lambda s: s["kind"] == c("strategy")), F.lit(1))
    fidelity = F.coalesce(used["fidelity"], F.lit(""))
    public = (c("planned_eligible") == 1) | (F.coalesce("planned_target", F.lit("")) == "public")
    unplanned = c("_p").isNull() | c("_r").isNull()
    original = c("status") == "original_stored"
    bad_original = (fidelity != "original") | ((c("target") == "public") & (~public | (c("quarantined") == 1))) | (
        (c("target") == "private") & public & (c("quarantined") != 1))
    rules = R.reasons(
        ("unplanned", unplanned),
        ("status_invalid", ~c("status").isin("original_stored", "derivative_stored", "metadata_only", "failed")),
        ("original_invalid", ~unplanned & original & bad_original),
        ("derivative_invalid", ~unplanned & (c("status") == "derivative_stored") & (fidelity != "derivative")),
        ("metadata_invalid", ~unplanned & (c("status") == "metadata_only") & (public | (F.coalesce(used["kind"], F.lit("")) != "metadata_only"))),
    )
    bad = rows.withColumn("_rule", F.explode(rules))
    return violation(bad, F.col("_rule"), "recovery_log", F.col("media_key"), c("strategy"))


def branding_audit(references: DataFrame, log: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """References without a final record, records nobody planned, changed sources, unknown statuses, stored rows without a digest."""
    final = latest(log, "reference_id").select("reference_id", F.struct("source_url", "status", "sha256").alias("_f"))
    plan = references.select("reference_id", F.col("source_url").alias("_url"))
    both = plan.join(final, "reference_id", "full_outer")
    c = F.col
    present = c("_f").isNotNull()
    rules = R.reasons(
        ("record_missing", ~present),
        ("record_unexpected", c("_url").isNull()),
        ("reference_mismatch", present & c("_url").isNotNull() & (c("_f.source_url") != c("_url"))),
        ("status_invalid", present & ~c("_f.status").isin(*statuses)),
        ("object_metadata_invalid", present & (c("_f.status") == "stored") & ~F.coalesce(c("_f.sha256").rlike(R.SHA256), F.lit(False))),
    )
    bad = both.withColumn("_rule", F.explode(rules))
    return violation(bad, c("_rule"), "branding", c("reference_id"))


def listing_audit(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Archive entries against the manifest: eligible entries must occur once with the stated size and checksum."""
    entries = listing.groupBy("path").agg(F.count("*").alias("_n"), F.min("byte_length").alias("_b"), F.max("crc").alias("_c"))
    both = manifest.join(entries, "path", "full_outer")
    c = F.col
    eligible = F.coalesce(c("eligible") == 1, F.lit(False))
    rule = (
        F.when(~eligible & c("_n").isNotNull(), "skipped")
        .when(eligible & c("_n").isNull(), "missing")
        .when(eligible & (c("_n") > 1), "duplicated")
        .when(eligible & (c("_b") != c("byte_length")), "size_differs")
        .when(eligible & (c("_c") != c("crc")), "crc_differs")
        .when(eligible, "matched")
    )
    return both.withColumn("outcome", rule).where("outcome is not null").select("path", "outcome")


def proof_audit(manifest: DataFrame, proofs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Eligible keys proven not at all, more than once, for another object, and proofs of unknown keys."""
    counted = proofs.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(*fields)).alias("_p"))
    both = manifest.select(key, F.struct(*fields).alias("_m")).join(counted, key, "full_outer")
    rule = (
        F.when(F.col("_m").isNull(), "proof_unknown")
        .when(F.col("_n").isNull(), "unproven")
        .when(F.col("_n") > 1, "proof_repeated")
        .when(F.col("_m") != F.col("_p"), "proof_differs")
    )
    bad = both.withColumn("_rule", rule).where("_rule is not null")
    return violation(bad, F.col("_rule"), "objects", F.col(key))


def manifest_coverage(media: DataFrame, manifest: DataFrame, snapshot: str) -> DataFrame:
    """Media rows and manifest rows must match by key; public rows must be whole and under their content key."""
    both = media.select("media_key", F.lit(1).alias("_m")).join(manifest.withColumn("_a", F.lit(1)), "media_key", "full_outer")
    c = F.col
    ext = R.media_extension(c("content_type"))
    whole = c("object_key").isNotNull() & c("sha256").rlike(R.SHA256) & c("byte_length").isNotNull() & c("content_type").isNotNull()
    public = F.coalesce(R.media_status(c("status")) == "public_stored", F.lit(False))
    rules = R.reasons(
        ("manifest_missing", c("_a").isNull()),
        ("manifest_extra", c("_m").isNull()),
        ("public_incomplete", public & ~F.coalesce(whole, F.lit(False))),
        ("public_key_invalid", public & whole & ~F.coalesce(c("object_key") == R.moment_object_key(snapshot, "public", c("sha256"), ext), F.lit(False))),
    )
    bad = both.withColumn("_rule", F.explode(rules))
    return violation(bad, c("_rule"), "media_manifest", c("media_key"))
