"""Known small cases: publication, aggregation, merging, paging, media types, packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapspark.functions import ordering as O
from snapspark.functions import rules as R
from snapspark.functions import text as X
from snapspark.operators import aggregates as G
from snapspark.operators import browse as B
from snapspark.operators import chunking as C
from snapspark.operators import media as M
from snapspark.operators import publication as P
from snapspark.operators import quality as Q
from snapspark.operators import relations as J
from snapspark.operators.exports import chunk_dataset


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_recent_order_breaks_ties_by_id(spark):
    drops = frame(spark, "drop_id int, start_date string, token_count int, is_private int, year int, is_virtual int",
                  (1, "2018-07-19T00:00:00.000Z", 1, 0, 2018, 0), (2, "2018-10-29T00:00:00.000Z", 1, 0, 2018, 0), (3, "2015-01-01T00:00:00.000Z", 1, 0, 2015, None),
                  (4, "2020-01-01T00:00:00.000Z", 9, 1, 2020, 1))
    public = B.public_drops(drops)
    assert [r.drop_id for r in O.page(public, B.DROP_ORDERS["recent"], 10).collect()] == [2, 1, 3]
    assert [r.drop_id for r in B.public_drops(drops, kind="in-person").orderBy("drop_id").collect()] == [1, 2]


def test_three_of_eight_moments_are_public(spark, rows):
    ids = [3, 2, 1, 10, 11, 12, 13, 14]
    moments = frame(spark, "moment_id int", *[(i,) for i in ids])
    visibility = frame(spark, "moment_id int, is_public int", *[(i, 0 if i == 12 else 1) for i in ids])
    links = frame(spark, "moment_id int, drop_id int", (3, 1001), (2, 1002), (1, 1001), (10, 999), (12, 1001), (13, 1001), (14, 1001), (14, 999))
    hidden = frame(spark, "drop_id int", (999,))
    stopped = frame(spark, "moment_id int, active int", (13, 1), (1, 0))
    assert rows(P.public_moments(moments, visibility, links, hidden, stopped)) == [(1,), (2,), (3,)]


def test_chain_projection_defaults_and_null_chain(spark, rows):
    chains = frame(spark, "drop_id int, chain string, token_count bigint, transfer_count bigint", (10, None, 2, 3), (11, "main", 5, 8))
    asked = frame(spark, "drop_id int", (10,), (11,), (12,))
    assert rows(G.chain_projection(asked, chains)) == [(10, 2, 3, 1, 0), (11, 5, 8, 1, 0), (12, 0, 0, 0, 0)]
    assert rows(chains.select(G.chain_key(F.col("chain")))) == [("n:",), ("s:main",)]
    audit = G.single_relation_audit(frame(spark, "drop_id int", (99,), (10,), (10,)), asked, "claims")
    assert [r[:3] for r in rows(audit)] == [("repeated_drop", "claims", "10"), ("unknown_drop", "claims", "99")]


def test_sums_beyond_safe_integers_are_flagged(spark, rows):
    tokens = frame(spark, "drop_id int, transfer_count bigint", (1, 2**53 - 1), (1, 1), (2, 5))
    assert rows(G.drop_totals(tokens)) == [(1, 2, None, 1), (2, 1, 5, 0)]


def test_private_fails_closed(spark):
    for value, expected in (("false", ("false", 0, 1)), ("true", ("true", 1, 1)), (None, (None, 1, 1)), ("unknown", (None, 1, 0))):
        assert tuple(one(spark, R.private_value(F.lit(value).cast("string")))) == expected


def test_collection_map_counts(spark, rows):
    links = frame(spark, "moment_id int, drop_id int", (1, 100))
    items = frame(spark, "collection_id int, drop_id int", (5, 100), (5, 101), (7, 100), (7, 102))
    collections = frame(spark, "collection_id int", (5,), (7,), (9,))
    pairs = J.collection_map(links, items)
    assert rows(pairs) == [(1, 5), (1, 7)]
    counts = {r.name: r.n for r in J.collection_map_counts(links, collections, items, pairs).collect()}
    assert counts == {"collections": 3, "collections_with_drop_ids": 2, "collection_drop_references": 4, "unique_collection_drops": 3, "moment_drop_relations": 1,
                      "moments_with_drop_relations": 1, "matched_moment_drop_relations": 1, "mapped_moments": 1, "mapped_collections": 2, "moment_collection_pairs": 2}


def test_hidden_merge_ignores_generic_lists_unless_passed(spark, rows):
    own = frame(spark, "drop_id int, hidden_on string", (1, "2024-02-01"), (2, None))
    generic = frame(spark, "drop_id int, hidden_on string", (1, "2024-01-01"), (3, None))
    assert rows(P.merge_hidden(own)) == [(1, "2024-02-01", "moments"), (2, None, "moments")]
    assert rows(P.merge_hidden(own, generic)) == [(1, "2024-01-01", "moments+drops"), (2, None, "moments"), (3, None, "drops")]


def test_rejected_rows_do_not_claim_a_name(spark):
    schema = "drop_id bigint, fancy_id string, title string, start_date string, end_date string, created_at string, year int, is_virtual int, is_private int"
    good = ("2020-01-01", "2020-01-02", "2020-01-03", 2020, None, 0)
    raw = frame(spark, schema, (1, "a", None, *good), (2, "a", "t", *good), (3, "a", "t", *good), (4, "a", None, *good))
    got = {r.drop_id: r.reasons for r in Q.judge_drops(raw).collect()}
    assert got == {1: ["invalid_title"], 2: [], 3: ["duplicate_fancy_id"], 4: ["invalid_title", "duplicate_fancy_id"]}


def test_null_mint_is_rejected_and_counted(spark):
    schema = "source_uid string, token_id bigint, drop_id bigint, minted_on bigint, owner_address string, network string, transfer_count bigint"
    owner = "0x" + "Ab" * 20
    raw = frame(spark, schema, ("u", 1, 7, None, owner, "n", 0), ("v", 1, 8, 5, owner, "n", 0), ("w", 2, 9, 5, "0x1", "n", 0))
    judged = Q.judge_tokens(raw)
    assert {r.source_uid: r.reasons for r in judged.collect()} == {"u": ["invalid_minted_on"], "v": [], "w": ["invalid_owner_address"]}
    seen = Q.token_observations(judged, frame(spark, "drop_id bigint", (9,))).collect()[0]
    assert tuple(seen) == (2, 1, 1)


def test_keyset_pages_concatenate_to_the_full_order(spark):
    data = [(i % 7, i) for i in range(100)]
    df = frame(spark, "k int, i int", *data)
    order = (("k", "desc"), ("i", "asc"))
    walked, cursor = [], None
    while True:
        got = O.page(df, order, 9, cursor).orderBy(*O.sort_columns(order)).collect()
        walked += [(r.k, r.i) for r in got]
        if not got or not got[0].has_next:
            break
        cursor = walked[-1]
    assert walked == sorted(data, key=lambda r: (-r[0], r[1]))


def test_keyset_skips_null_keys(spark):
    df = frame(spark, "k int, i int", (None, 1), (1, 2), (0, 3))
    assert [r.i for r in df.where(O.after((("k", "desc"), ("i", "asc")), (1, 5))).collect()] == [3]


@pytest.mark.parametrize("parts", [1, 3, 16, 300])
def test_positions_of_a_hot_group(spark, parts):
    data = [("hot", f"{i:05d}") for i in range(3000)] + [(f"g{i % 40}", f"{i:05d}") for i in range(500)]
    random.Random(3).shuffle(data)
    got = {(r.g, r.k): r.p for r in O.positions(frame(spark, "g string, k string", *data), "g", ["k"], "p", parts).collect()}
    by_group = {}
    for g, k in sorted(data):
        by_group.setdefault(g, []).append(k)
    assert got == {(g, k): i for g, ks in by_group.items() for i, k in enumerate(ks)}


def test_positions_in_few_groups_leave_the_rows_where_they_lie(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "5000 - id as k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = O.positions(df, "g", ["k"], "p", 7, few=True)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        got = {(r.g, r.k): r.p for r in placed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    groups = {g: sorted(5000 - i for i in range(5000) if i % 3 == g) for g in range(3)}
    assert got == {(g, k): i for g, ks in groups.items() for i, k in enumerate(ks)}


def test_previous_row_across_blocks(spark):
    df = frame(spark, "g int, s bigint, v bigint", *[(0, i, i * 10) for i in range(50)])
    got = {r.s: r.prev_v for r in O.with_previous(df, "g", "s", ["v"], block=7).collect()}
    assert got == {i: (None if i == 0 else (i - 1) * 10) for i in range(50)}


def test_list_parts_keep_a_key_of_any_size_whole(spark):
    df = frame(spark, "k int, v int, w string", *[(1, i, "a") for i in range(3)], *[(2, i, None) for i in range(5000)], (None, 7, "lost"))
    docs = frame(spark, "k int, title string", (1, "one"), (2, "two"))
    parts = O.with_lists(docs, "k", [O.Listed(df, (("v", "desc"),), ["v", "w"], "vs"), O.Listed(df.limit(0), (("v", "asc"),), ["v"], "none")]).collect()
    assert all(len(r.vs) <= O.LIST_PART and not r.none for r in parts)
    whole = {k: [v.v for r in sorted((r for r in parts if r.k == k), key=lambda r: r.part) for v in r.vs] for k in (1, 2)}
    assert whole == {1: [2, 1, 0], 2: list(range(4999, -1, -1))} and {r.part for r in parts if r.k == 2} == set(range(5))


def test_short_lists_are_dealt_by_key_once(spark):
    docs = frame(spark, "k int, title string", *[(i, f"t{i}") for i in range(40)])
    tags = frame(spark, "k int, v int, w string", *[(i % 50, i // 9, f"w{i}") for i in range(200)], (3, None, "n"))
    links = frame(spark, "k int, v int", *[(i % 20, i) for i in range(60)])
    lists = [O.Listed(tags, (("v", "desc"), ("w", "asc")), ["w"], "tags"), O.Listed(links, (("v", "asc"),), ["v"], "links")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = O.with_lists(docs, "k", lists)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        rows = whole.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 3  # one for the documents and one for each list
    assert whole.columns == ["k", "part", "title", "tags", "links"] and len(rows) == 40
    data = sorted([(i % 50, i // 9, f"w{i}") for i in range(200)], key=lambda r: (-r[1], r[2])) + [(3, None, "n")]
    assert {r.k: [t.w for t in r.tags] for r in rows} == {k: [w for i, _, w in data if i == k] for k in range(40)}
    assert {r.k: [x.v for x in r.links or []] for r in rows} == {k: [i for i in range(60) if i % 20 == k] for k in range(40)}


def test_documents_go_on_in_further_parts(spark):
    docs = frame(spark, "k int, title string", (1, "one"), (2, "two"), (3, "three"))
    tags = frame(spark, "k int, v int", *[(1, i) for i in range(7)], *[(2, i) for i in range(2)], *[(9, i) for i in range(9)])
    links = frame(spark, "k int, v string", *[(1, f"l{i:02d}") for i in range(12)])
    lists = [O.Listed(t, (("v", "asc"),), ["v"], name) for t, name in ((tags, "tags"), (links, "links"))]
    got = {(r.k, r.part): (r.title, [v.v for v in r.tags or []], [v.v for v in r.links or []]) for r in O.with_lists(docs, "k", lists, 5).collect()}
    names = [f"l{i:02d}" for i in range(12)]
    assert got == {
        (1, 0): ("one", [0, 1, 2, 3, 4], names[:5]), (1, 1): (None, [5, 6], names[5:10]), (1, 2): (None, [], names[10:]),
        (2, 0): ("two", [0, 1], []), (3, 0): ("three", [], []),
    }


def greedy(sizes, cap, max_rows):
    out, total, count, chunk = [], 0, 0, 0
    for size in sizes:
        if count and (total + size > cap or (max_rows and count >= max_rows)):
            chunk, total, count = chunk + 1, 0, 0
        total, count = total + size, count + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize("cap,max_rows,parts,fan", [(100, 0, 8, 32), (370, 0, 40, 3), (1000, 7, 40, 2), (3000, 0, 60, 2), (10_000, 900, 25, 4)])
def test_packing_equals_the_sequential_rule(spark, cap, max_rows, parts, fan):
    rnd = random.Random(cap)
    groups = {"hot": [rnd.choice([0, 1, 5, 30, 99, 100]) for _ in range(4000)], "even": [100] * 9, "tiny": [1, 1, 1], "none": [0, 0, 0]}
    for i in range(60):
        groups[f"g{i}"] = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))]
    data = [(g, i, s, f"x{i}") for g, sizes in groups.items() for i, s in enumerate(sizes)] + [("bad", 0, 5, ""), ("bad", 1, 50_000, ""), (None, 0, 3, None), (None, 1, 4, None)]
    df = frame(spark, "g string, i int, c bigint, text string", *data).repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        packed = C.pack(df, "g", ["i"], F.col("c"), cap, max_rows, fan=fan)
        assert packed.columns == ["g", "i", "c", "text", "chunk"]
        got = {(r.g, r.i): (r.c, r.text, r.chunk) for r in packed.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {(g, i): (groups[g][i], f"x{i}", c) for g, sizes in groups.items() for i, c in enumerate(greedy(sizes, cap, max_rows))}
    assert {k: v for k, v in got.items() if k[0] not in ("bad", None)} == want
    assert got[("bad", 0)][2] == 0 and got[("bad", 1)][2] is None and C.oversized(df, "g", F.col("c"), cap).count() == 1
    assert got[(None, 0)] == (3, None, 0) and got[(None, 1)] == (4, None, 0)


@pytest.mark.parametrize("cap,max_rows", [(50, 0), (400, 0), (400, 6), (100_000, 5), (100_000, 0)])
def test_maps_of_parts_compose_to_the_map_of_the_whole(cap, max_rows):
    rnd, rule = random.Random(cap + max_rows), C.Rule(cap, max_rows)
    for _ in range(30):
        parts = [np.array([rnd.choice([0, 1, 7, 50]) for _ in range(rnd.randint(1, 25))]) for _ in range(rnd.randint(2, 6))]
        whole, composed = C.Map(), None
        for part in parts:
            whole.add(rule, part)
            one = C.Map()
            for piece in np.array_split(part, 3):
                if len(piece):
                    one.add(rule, piece)
            composed = one if composed is None else C.Map.load(composed.dump()).then(rule, one)
        for state in [C.FRESH, *((rnd.randint(0, cap), rnd.randint(1, max_rows or 30), rnd.randint(0, 9)) for _ in range(20))]:
            assert whole.follow(rule, state) == composed.follow(rule, state)
            _, end = C._packed(rule, np.concatenate(parts), np.array([0]), [state])
            assert whole.follow(rule, state) == end


def test_packing_of_an_empty_table(spark):
    assert C.pack(frame(spark, "g string, i int, c bigint"), "g", ["i"], F.col("c"), 10).count() == 0


def test_statement_heads_commas_and_journals_count(spark):
    df = frame(spark, "g string, i int, c bigint", *[("a", i, 30) for i in range(6)], ("b", 0, 85), ("b", 1, 91))
    around = C.Frame(head=10, comma=5, shard_head=40, journal=60)
    got = {tuple(r) for r in C.shard_plan(df, "g", ["i"], F.col("c"), 10, 100, 300, around).select("g", "i", "statement", "bytes", "rows", "shard").collect()}
    # Two rows, a comma and a head take 75 bytes, three would take 110; two statements fill the 200 bytes left of a shard.
    assert got == {("a", None, 0, 75, 2, 0), ("a", None, 1, 75, 2, 0), ("a", None, 2, 75, 2, 1), ("b", None, 0, 95, 1, 0), ("b", 1, None, 101, 1, None)}


def test_shard_plan_reports_oversized_rows(spark):
    df = frame(spark, "g string, i int, c bigint", ("a", 0, 60), ("a", 1, 500), ("a", 2, 60), ("a", 3, 30), ("b", 0, 101), ("c", 0, None))
    got = {tuple(r) for r in C.shard_plan(df, "g", ["i"], F.col("c"), 10, 100, 1000).select("g", "i", "statement", "bytes", "rows", "shard").collect()}
    assert got == {("a", None, 0, 60, 1, 0), ("a", None, 1, 90, 2, 0), ("a", 1, None, 500, 1, None), ("b", 0, None, 101, 1, None), ("c", 0, None, None, 1, None)}


SIGNATURES = [
    (b"\xff\xd8\xff\xe0", None, "image/jpeg"), (b"\x89PNG\r\n\x1a\n", None, "image/png"), (b"GIF89a..", None, "image/gif"), (b"RIFF....WEBP", None, "image/webp"),
    (b"RIFF....WAVE", None, "audio/wav"), (b"OggS....", None, "audio/ogg"), (b"fLaC....", None, "audio/flac"), (b"ID3.....", None, "audio/mpeg"), (b"\xff\xfb\x90\x00", None, "audio/mpeg"),
    (b"\x1a\x45\xdf\xa3", None, "video/webm"), (b"II*\x00....", "image/x-adobe-dng", "image/x-adobe-dng"), (b"II*\x00....", None, None),
    (b"\x00\x00\x00\x18ftypavif", None, "image/avif"), (b"\x00\x00\x00\x18ftypheic", "image/heic", "image/heic"), (b"\x00\x00\x00\x18ftypheic", None, "video/mp4"),
    (b"\x00\x00\x00\x18ftypM4A ", None, "audio/mp4"), (b"\x00\x00\x00\x18ftypqt  ", None, "video/quicktime"), (b"\x00\x00\x00\x18ftypisom", None, "video/mp4"), (b"abc", None, None),
    (b"plain text", "image/png", None),
]


def test_media_signatures(spark):
    df = frame(spark, "i int, b binary, d string", *[(i, bytearray(b), d) for i, (b, d, _) in enumerate(SIGNATURES)])
    got = {r.i: r.t for r in df.select("i", M.detect_type(F.col("b"), F.col("d")).alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(SIGNATURES)}


def test_object_keys(spark):
    sha = "ab" + "0" * 62
    good = f"snapshots/c1/collections/media/sha256/ab/{sha}.png"
    for key, ok in ((good, True), (good.replace("/ab/", "/ac/"), False), (good.replace("c1", "c2"), False), (good + "x", False)):
        assert one(spark, R.content_addressed_key(F.lit(key), "c1", "collections/media")) is ok
    assert one(spark, R.archive_artwork_key(F.lit("snapshots/c1/artwork/7.webp"), "c1", F.lit(8))) is False


@pytest.mark.parametrize("url,want", [
    ("https://a.example/x", "https://a.example/x"), ("http://a.example", "http://a.example/"), ("HTTPS://a.example/x", "https://a.example/x"), ("ftp://a.example/x", None),
    ("javascript:alert(1)", None), ("https://u:p@a.example/", None), ("not a url", None), (None, None), ("https://a.example/" + "x" * 2048, None),
    ("https://my_host.example.org/a", "https://my_host.example.org/a"), ("https://a.example.org/a b", "https://a.example.org/a%20b"),
    ("https://a.example.org/a|b", "https://a.example.org/a|b"), ("https://a.example.org/%zz", "https://a.example.org/%zz"), ("https://münchen.de/x", "https://xn--mnchen-3ya.de/x"),
    ("https://[2001:db8::1]:8080/x", "https://[2001:db8::1]:8080/x"), ("https:///x", "https://x/"), ("https://a b.example/x", None), ("https://:80/x", None),
    ("https://a.example:80x/", None), ("https://@a.example/", "https://a.example/"), ("https://a.example?x=u@b", "https://a.example/?x=u@b")])
def test_safe_url(spark, url, want):
    assert one(spark, R.safe_url(F.lit(url).cast("string"))) == want


def test_host_patterns_match_just_the_host(spark):
    hosts = R.MediaHosts(legacy="files.media.a-b.org")
    label = lambda url: one(spark, R.gateway_label(F.lit(url), F.lit("k"), hosts))
    assert label("https://files.media.a-b.org/a") == "legacy"
    assert label("https://filesXmediaXa-bXorg/a") == label("https://files.mediaXa-b.org/a") == "other"
    own = M.ArtworkHosts(asset="one.two.three.four.org", storage="s.t.u.org", storage_prefix="/v.1")
    canonical = lambda url: one(spark, M.canonical_source(F.lit(url), own))
    assert canonical("https://one.two.three.four.org/x") and canonical("https://s.t.u.org/v.1/x")
    assert not canonical("https://one.two.threeXfour.org/x") and not canonical("https://s.t.u.org/vX1/x")
    twin = lambda url: one(spark, M.legacy_twin(F.lit(url), own))
    assert twin("https://one.two.three.four.org/x") == "https://s.t.u.org/v.1/x" and twin("https://one.two.threeXfour.org/x") is None


def test_trimmed(spark):
    assert one(spark, R.trimmed(F.lit("\t\u00a0\ufeff a b \r\n"))) == "a b"


def test_csv_cells(spark):
    for value, safe in (("=1+1", "'=1+1"), (" \t@x", "' \t@x"), ("a=b", "a=b"), (None, ""), ("-1", "'-1")):
        assert one(spark, R.csv_cell(F.lit(value).cast("string"))) == safe


def test_canonical_instant(spark):
    for value, ok in (("2024-01-01T00:00:00.000Z", True), ("2024-02-30T00:00:00.000Z", False), ("2024-01-01T00:00:00Z", False), ("2024-01-01T24:00:00.000Z", False), (None, False)):
        assert one(spark, R.canonical_instant(F.lit(value).cast("string"))) is ok


def test_fold_and_query_terms(spark):
    assert one(spark, X.tokens(F.lit("Élan ÉLAN naïve, Łódź ét 2x"))) == ["elan", "naive", "łodz", "et", "2x"]
    assert X.parse_query("  Red   RING! ") == ["red", "ring"]
    for bad in ("", "a", "one two three four five six", "x" * 33):
        with pytest.raises(ValueError):
            X.parse_query(bad)


def test_recovery_rules(spark):
    def retry(status, error, http):
        return one(spark, M.requires_retry(F.lit(status), F.lit(error).cast("string"), F.lit(http).cast("int")))

    assert retry("failed", "SOURCE_HTTP_ERROR", 404) is False
    assert retry("failed", "SOURCE_HTTP_ERROR", 500) is True
    assert retry("failed", None, None) is True
    assert retry("oversize", None, None) is False
    assert one(spark, M.needs_recovery(F.lit("private_stored"), F.lit(1))) is True
    assert one(spark, M.needs_recovery(F.lit(None).cast("string"), F.lit(1))) is False


def test_data_files_stay_below_the_target(spark):
    import json

    data = [("o", i, "x" * (i % 17)) for i in range(200)]
    df = frame(spark, "owner string, i int, t string", *data)
    files = {}
    for r in chunk_dataset(df, "owner", ["i"], 100, 1000).orderBy("i").collect():
        files.setdefault(r.chunk, []).append(json.dumps({"owner": r.owner, "i": r.i, "t": r.t}, separators=(",", ":")))
    sizes = [len(",".join(f)) + 100 for f in files.values()]
    assert max(sizes) < 1000
    # Next-fit: the first record of each file would not have fitted the file before it.
    starts = [f[0] for f in files.values()]
    assert all(size + 1 + len(start) >= 1000 for size, start in zip(sizes, starts[1:]))
