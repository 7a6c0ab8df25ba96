"""The stored index: pruned reads, layers, prefix matching."""

import random
import re

import pytest
from pyspark.sql import functions as F

from snapspark.functions import text as X
from snapspark.operators import search as S

SCHEMA = "doc_id long, title string, body string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def tokens(*texts):
    return {X.fold_text(t) for t in re.findall(r"[^\W_]+", " ".join(t or "" for t in texts))}


def brute(rows, searches):
    out = set()
    for name, raw in searches.items():
        terms = {X.fold_text(t) for t in X.parse_query(raw)}
        for doc_id, *texts in rows:
            own = tokens(*texts)
            if all(any(t == term or len(term) >= S.PREFIX and t.startswith(term) for t in own) for term in terms):
                out.add((name, doc_id))
    return out


def some_rows(seed=1, n=300):
    rnd = random.Random(seed)
    words = ["red", "ring", "reading", "rings", "Élan", "elane", "a1", "re", "th", "the", "theory", "日本", "zeta", "ünïcode", "x9y", "ß"]
    return [(i, " ".join(rnd.choices(words, k=rnd.randrange(4))), rnd.choice([None, "the common word"]) if i % 9 else None) for i in range(n)]


SEARCHES = {"both": "Red ring", "short": "re", "fold": "elan", "theory": "the", "none": "absent word", "cjk": "日本 re", "many": "th re a1 ring zeta", "twice": "red RED"}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    S.write_index(docs(spark, some_rows()), "doc_id", ["title", "body"], path, shards=5)
    return path


def found(spark, path, searches=SEARCHES):
    return {tuple(r) for r in S.find(spark, path, searches).collect()}


def test_find_against_brute_force(spark, built):
    assert found(spark, built) == brute(some_rows(), SEARCHES) and len(found(spark, built)) > 50


def test_a_search_reads_few_files_of_the_stored_index(spark, built):
    hits = S.find(spark, built, {"one": "zeta"})
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "postings" in line)
    assert re.search(r"PartitionFilters: \[.*shard", scan) and "GreaterThanOrEqual(token,zeta)" in scan
    read = S._read(spark, built, "postings")
    places = {(r.layer, r.shard) for r in read.where("token = 'zeta'").select("layer", "shard").distinct().collect()}
    every = {(r.layer, r.shard) for r in read.select("layer", "shard").distinct().collect()}
    assert len(places) < len(every) == 5
    assert "shard#" in scan and all(str(s) in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1] for _, s in places)


def test_a_frequent_token_spans_shards(spark, built):
    counted = S._read(spark, built, "vocabulary").groupBy("token").agg(F.count("*").alias("shards"), F.sum("docs").alias("docs"))
    by_token = {r.token: (r.shards, r.docs) for r in counted.collect()}
    own = [tokens(*r[1:]) for r in some_rows()]
    assert {t: n for t, (_, n) in by_token.items()} == {t: sum(t in o for o in own) for t in set().union(*own)}
    assert max(shards for shards, _ in by_token.values()) > 1


def test_updates_are_layers_and_leave_the_rest_alone(spark, tmp_path):
    path, rows = str(tmp_path / "index"), some_rows(2, 120)
    S.write_index(docs(spark, rows), "doc_id", ["title", "body"], path, shards=3)
    for round_ in range(1, 4):
        rows = [(i, "zeta ring" if i % 7 == round_ else t, b) for i, t, b in rows if i % 11 != round_] + [(1000 * round_ + i, "red new", None) for i in range(3)]
        now = docs(spark, rows)
        assert {r.rule for r in S.freshness(now, "doc_id", ["title", "body"], path).collect()} >= {"stale"}
        assert S.update_index(now, "doc_id", ["title", "body"], path, shards=2)
        assert found(spark, path) == brute(rows, SEARCHES)
        listed = {(r.doc_id, r.token) for r in S.postings(spark, path).collect()}
        assert listed == {(i, t) for i, *texts in rows for t in tokens(*texts)}
        worded = {i for i, *texts in rows if tokens(*texts)}
        left = {(r.rule, r.key) for r in S.freshness(now, "doc_id", ["title", "body"], path).collect()}
        assert left == {("not_indexed", str(i)) for i, *_ in rows if i not in worded}
    assert S.layers(spark, path) == 4
    changed = S._read(spark, path, "documents").where("layer = 3").count()
    assert 0 < changed < len(rows) / 2
    assert not S.update_index(now, "doc_id", ["title", "body"], path)
    target = str(tmp_path / "small")
    S.compact(spark, path, now, "doc_id", ["title", "body"], target, shards=2)
    assert S.layers(spark, target) == 1 and found(spark, target) == brute(rows, SEARCHES)


def test_a_layer_without_commit_does_not_count(spark, tmp_path):
    path, rows = str(tmp_path / "index"), [(i, "red ring", None) for i in range(20)]
    S.write_index(docs(spark, rows), "doc_id", ["title", "body"], path, shards=2)
    torn = docs(spark, [(0, "zeta", None)])
    texts = S._texts(torn, "doc_id", ["title", "body"])
    S._write_layer(texts, spark.createDataFrame([(0, 0)], "doc_id long, gone int"), path, 1, 1)
    import shutil

    shutil.rmtree(f"{path}/commits/layer=1")
    assert found(spark, path, {"q": "red"}) == {("q", i) for i in range(20)} and found(spark, path, {"q": "zeta"}) == set()
    assert S.update_index(docs(spark, [(i, "red ring" if i else "theory", None) for i in range(20)]), "doc_id", ["title", "body"], path, shards=1)
    assert found(spark, path, {"q": "red", "z": "zeta", "t": "theory"}) == {("t", 0)} | {("q", i) for i in range(1, 20)}


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_index(docs(spark, []).where("false"), "doc_id", ["title", "body"], path, shards=2)
    assert found(spark, path) == set() and S.postings(spark, path).count() == 0
    assert S.update_index(docs(spark, some_rows(3, 30)), "doc_id", ["title", "body"], path, shards=2)
    assert found(spark, path) == brute(some_rows(3, 30), SEARCHES)


def test_ranges_of_many_terms_cover_all_of_them():
    rnd = random.Random(4)
    terms = ["".join(rnd.choices("abc日\U0010ffff", k=rnd.randrange(1, 6))) for _ in range(200)]
    for most in (1, 3, 64, 500):
        ranges = S.token_ranges(terms, most)
        assert len(ranges) <= most
        for term in terms:
            for token in (term, term + "a", term + "\U0010ffff") if len(term) >= S.PREFIX else (term,):
                assert any(low <= token and (high is None or token < high) for low, high in ranges)
