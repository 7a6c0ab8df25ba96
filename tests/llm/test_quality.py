import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from snapspark.llm import quality as Q
from snapspark.llm.common import fold


def test_isotonic_is_the_best_rising_fit():
    random = np.random.default_rng(2)
    total = random.integers(1, 30, size=40)
    good = random.binomial(total, np.clip(np.linspace(0.1, 0.9, 40) + random.normal(0, 0.2, 40), 0, 1))
    got = Q.isotonic(np.arange(40), good, total)
    assert (np.diff(got) >= -1e-12).all()
    # Max-min formula of the rising fit, with the blocks' own half observations left out by comparing block means.
    share = lambda a, b: good[a : b + 1].sum() / total[a : b + 1].sum()
    exact = np.array([max(min(share(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])
    for value in np.unique(got):
        block = np.flatnonzero(got == value)
        assert np.allclose(exact[block], share(block[0], block[-1]))


def test_normal_equations_do_not_depend_on_partitions(spark):
    random = np.random.default_rng(3)
    d = len(Q.STATISTICS)
    x, y = random.normal(size=(500, d)), random.integers(0, 2, 500)
    model = Q.Model(np.zeros(d), np.ones(d), random.normal(size=(d, 16)), random.uniform(0, 6, 16))
    rows = spark.sparkContext.parallelize(list(zip(x.tolist(), y.tolist())), 7)
    left, right = rows.mapPartitions(Q._normal_equations(model)).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), 2)
    z = model.features(x)
    assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ y)


def test_random_features_approximate_the_kernel():
    random = np.random.default_rng(5)
    d, width = len(Q.STATISTICS), Q.WIDTH * np.sqrt(len(Q.STATISTICS) / 4)
    model = Q.Model(np.zeros(d), np.ones(d), random.normal(size=(d, 20_000)) / width, random.uniform(0, 2 * np.pi, 20_000))
    x = random.normal(size=(6, d))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_statistics_of_odd_texts():
    texts = ["", None, " \n\n ", "word", "é" * 10, "A, b. C! " * 200_000, "|" * 50]
    found = Q.statistics(pa.array(texts))
    assert found.shape == (len(texts), len(Q.STATISTICS)) and np.isfinite(found).all() and not found[:2].any()
    assert np.allclose(found[5], Q.statistics(pa.array([texts[5]]))[0])


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "x"), (-2, "x")], "doc_id long, text string")
    scored = Q.score(docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("other")), labels)
    assert scored.count() == docs.count() + 4 and scored.where("score is null or score < 0 or score > 1").count() == 0
    rows = scored.join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([(b < g) + (b == g) / 2 for g in good for b in bad]) >= 0.9


def test_without_labels_every_score_is_one_half(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.score(docs, labels).collect()} == {0.5}
    assert Q.score(docs.limit(0), labels).count() == 0
