import pytest

import corpus_pipeline as P
from snapspark.llm import toxicity
from snapspark.llm.common import read, stored
from test_decontamination import brute as hits
from test_ngram_join import brute as near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = read(spark, SF, "documents")
    columns = docs.columns
    own = docs.orderBy("doc_id").limit(40).collect()
    item = read(spark, SF, "benchmark").first()["text"]
    rows = [(1000 + i, r["text"], r["lang"], r["source"], 0) for i, r in enumerate(own[:10])]
    rows += [(1100 + i, r["text"] + " tail", r["lang"], r["source"], 0) for i, r in enumerate(own[10:30]) if len(r["text"]) > 600]
    rows += [(1200, f"some words before {item} and behind", "en", None, 0), (1201, None, None, None, None), (1201, None, None, None, None), (None, "", "en", "src0", 0)]
    rows += [(2000 + i, f"{own[i % 40]['text'][:200]} you vile{i % 3} wretch number {i}", "en", "src1", 0) for i in range(40)]
    more = spark.createDataFrame(rows, docs.schema)
    docs.unionByName(more).select(*columns).write.parquet(f"{folder}/documents.parquet")
    labels = read(spark, SF, "labels")
    labels.unionByName(spark.createDataFrame([(2000 + i, 1, 1) for i in range(30)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    read(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_every_stage_does_its_work(spark, planted):
    docs, kept = read(spark, planted, "documents"), {}
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, planted), name)
        kept[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == before.columns
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    before, after = kept["toxicity"]
    scores = toxicity.tag(before, read(spark, planted, "labels")).where("score < 0.5")
    assert rows(after) == rows(scores) and not any((d or 0) >= 2000 for d, _ in rows(after)) and after.count() >= 200

    before, after = kept["exact_dedup"]
    best = {}
    for doc, text in rows(before):
        best[text or ""] = max((x for x in (best.get(text or ""), doc) if x is not None), default=None)
    assert sorted(((d, t or "") for d, t in rows(after)), key=str) == sorted(((d, t) for t, d in best.items()), key=str)

    before, after = kept["ngram_join"]
    found, _ = near(rows(before), 5, 80)
    alone = [d for d, n, _ in found if not n]
    assert sorted((d for d, _ in rows(after)), key=str) == sorted([*{c for _, n, c in found if n}, *alone], key=str)
    assert after.count() < before.count()

    before, after = kept["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read(spark, planted, "benchmark").collect()]
    clean = [d for d, _, n, _ in hits(rows(before), items, 10) if not n]
    assert [d for d, _ in rows(after)] == sorted(clean, key=str) and 1200 not in clean

    before, after = kept["mixing"]
    assert after.columns == [*before.columns, "copy"]
    copies = {}
    for r in after.collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    assert copies and all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in copies.values())


def test_run_and_empty_tables(spark, planted, tmp_path):
    assert P.run(spark, planted).count() > 0
    for table in ("documents", "labels", "benchmark"):
        read(spark, planted, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
