import hashlib

import pytest

from snapspark.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, row string, digest int"


def rows():
    out = [(i, f"text {i % 7}", "r", 1) for i in range(60)]
    out += [(None, "text 1", "r", 1), (None, None, None, None), (3, None, "x", 2), (4, "", "y", 2)]
    return out + [(100, "same", "a", 1)] * 3 + [(None, "nulls", "a", 1)] * 2 + [(200, "long " * 20_000, "l", 1), (201, "A", "u", 1), (202, "a", "u", 1)]


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_mark_and_keep(spark, k):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    groups = {}
    for doc_id, text, *_ in rows():
        groups.setdefault(text or "", []).append(doc_id)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = sorted((tuple(r) for r in E.mark(docs, k).collect()), key=str)
    want = [
        (i, top[t], len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    ]
    assert sorted(((g[0], g[1], g[2], g[4]) for g in got), key=str) == sorted(want, key=str)
    kept = [g for g in got if g[3]]
    assert sorted((g[0] for g in kept), key=str) == sorted(top.values(), key=str)
    left = E.keep(docs, k)
    assert left.columns == docs.columns
    assert sorted(((r["text"] or "", r["doc_id"]) for r in left.collect()), key=str) == sorted(top.items(), key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.mark(empty).count() == 0 and E.keep(empty).count() == 0


def test_misra_gries_keeps_every_frequent_digest(spark):
    import random

    rnd = random.Random(1)
    values = [b"a"] * 400 + [b"b"] * 300 + [str(i).encode() for i in range(900)]
    rnd.shuffle(values)
    digests = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(6)
    found = {bytes(r[0]) for r in E.candidates(digests, 8).collect()}
    assert {b"a", b"b"} <= found and len(found) <= 8
