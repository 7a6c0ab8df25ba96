import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapspark.llm import toxicity as T
from snapspark.llm.common import fold


def test_marginals_match_enumeration():
    random = np.random.default_rng(1)
    chain = T.Chain(random.normal(size=T.SLOTS), random.normal(size=2), random.normal(size=(2, 2)))
    slots = random.integers(0, T.SLOTS, size=(11, T.FEATURES)).astype(np.int32)
    first = np.zeros(11, dtype=bool)
    first[[0, 4, 5]] = True
    marginal, pair = chain.messages(slots, first)
    score = chain.emission[slots].sum(axis=1)
    for a, b in ((0, 4), (4, 5), (5, 11)):
        total, single, double = 0.0, np.zeros(b - a), np.zeros((b - a, 4))
        for y in itertools.product((0, 1), repeat=b - a):
            moves = sum(chain.move[y[i - 1], y[i]] for i in range(1, b - a))
            p = np.exp(chain.start[y[0]] + sum(score[a + i] * y[i] for i in range(b - a)) + moves)
            total += p
            for i in range(b - a):
                single[i] += p * y[i]
                if i:
                    double[i, 2 * y[i - 1] + y[i]] += p
        assert np.allclose(single / total, marginal[a:b]) and np.allclose(double / total, pair[:, a:b].T)


def corpus(spark):
    docs = [(i, f"some plain words here number{i % 9} and more of them" + (" You IDIOTIC1 idiotic fool" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(0, 400, 2)] + [(None, 1, 1), (4, None, None), (6, 1, 1)]
    extra = [(None, None), (901, ""), (902, " .,! "), (903, "idiotic"), (903, "idiotic"), (904, "plain words " * 40_000), (905, "é idiotic!")]
    table = spark.createDataFrame([(*d, 0, "s") for d in docs + extra], "doc_id long, text string, score int, spans string").repartition(3)
    return table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_tags_spans_and_scores(spark):
    docs, labels = corpus(spark)
    got = T.tag(docs, labels, columns=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        toxic = "idiotic" in (r["text"] or "").lower()
        assert (r["score"] >= 0.5) == toxic
        for s in r["spans"]:
            assert "idiotic" in r["text"].encode()[s["start"] : s["end"]].decode().lower() or "fool" in r["text"]
        assert bool(r["spans"]) == toxic
    left = T.accepted(docs, labels)
    assert left.columns == docs.columns
    assert left.count() == sum(r["score"] < 0.5 for r in got)


def test_without_labels_nothing_is_toxic(spark):
    docs, labels = corpus(spark)
    none = T.tag(docs, labels.where("toxic = 0"))
    assert none.agg(F.max("score")).first()[0] == 0 and T.accepted(docs, labels.limit(0)).count() == docs.count()
    assert T.tag(docs.limit(0), labels).count() == 0


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = T.tag(docs, labels, columns=["doc_id", "lang"]).join(labels, "doc_id").where((fold(F.col("doc_id")) == 0) & (F.col("lang") == "en")).collect()
    toxic, plain = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([(p < t) + (p == t) / 2 for t in toxic for p in plain]) >= 0.9
    assert np.mean(np.array(plain) >= 0.5) <= 0.05


@pytest.mark.parametrize("size", [1, 2, 3, 50, 1000])
def test_running_products(size):
    steps = np.random.default_rng(size).random((4, size))
    got, running = T._scan_products(steps), np.eye(2)
    for i in range(size):
        running = running @ steps[:, i].reshape(2, 2)
        running /= running.sum()
        assert np.allclose(got[:, i], running.ravel())
