import random

import pytest
from pyspark.sql import functions as F

from snapspark.llm import mixing as M


def reshare(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped.add(min(over, key=lambda s: most * sizes[s] / weight[s]))


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_what_resharing_comes_to(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 5, 100, 1000, 10_000]) for i in range(rnd.randrange(1, 12))} | ({None: 40} if seed % 2 else {})
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(table).collect()}
    want = reshare(sizes, M.WEIGHTS, M.MOST)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def rows():
    rnd = random.Random(2)
    out = [(i, "w " * rnd.choice([1, 3, 10, 60, 400]), rnd.choice(["a", "b", "b", "c", None, "d"]), 5) for i in range(900)]
    return out + [(7, "same text", "a", 1)] * 3 + [(None, None, None, 1), (None, "x", "a", 1), (8, " \t", "e", 2), (9, "v " * 20_000, "b", 1)]


SCHEMA = "doc_id long, text string, source string, copies int"


@pytest.mark.parametrize("band_rows, bits", [(5, 12), (5, 2), (1000, 12)])
def test_mixture_comes_near_its_targets(spark, monkeypatch, band_rows, bits):
    monkeypatch.setattr(M, "BAND_BITS", bits)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = M.mix(docs, band_rows=band_rows).collect()
    assert len(got) == len(rows())
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(7), band_rows=band_rows).collect()))
    by_target = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        by_target.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, size), own in by_target.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2
        assert {r["copies"] for r in own} <= {int(target // size), int(target // size) + 1} if size else True
    drawn = M.draw(docs, band_rows=band_rows)
    assert drawn.columns == [*docs.columns, "copy"]
    assert drawn.count() == sum(r["copies"] for r in got)
    taken = {}
    for r in got:
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["copies"]
    for r in drawn.select("doc_id", M.words(F.coalesce("text", F.lit(""))).alias("size")).collect():
        taken[r["doc_id"], r["size"]] -= 1
    assert not any(taken.values())


def scaled(by_class, left):
    """Inclusion of each size class, by trying every number of certain classes."""
    order = sorted(by_class, key=lambda k: -by_class[k][1] / by_class[k][0])
    for certain in range(len(order) + 1):
        rest = left - sum(by_class[k][1] for k in order[:certain])
        weight = sum(by_class[k][1] ** 2 / by_class[k][0] for k in order[certain:])
        scale = max(rest, 0) / weight if weight else 0
        p = {k: 1.0 if i < certain else scale * by_class[k][1] / by_class[k][0] for i, k in enumerate(order)}
        if all(v <= 1 + 1e-12 for v in p.values()):
            return p


def ranking(spark, data, seed):
    """Who is taken, by a ranking in Python; only the random numbers come from the operator."""
    docs = spark.createDataFrame(data, SCHEMA)
    text = F.coalesce("text", F.lit(""))
    u = {(r[0], r[1] or ""): r[2:] for r in docs.select("doc_id", "text", M.uniform(F.col("doc_id"), F.xxhash64(text), seed), F.xxhash64(text), M.size_class(M.words(text))).collect()}
    by_source = {}
    for doc_id, text, source, *_ in data:
        by_source.setdefault(source, []).append((doc_id, text or "", len((text or "").split())))
    sizes = {s: sum(n for *_, n in own) for s, own in by_source.items()}
    target, out = reshare(sizes, M.WEIGHTS, M.MOST), {}
    for source, own in by_source.items():
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        left, classes = target[source] - whole * sizes[source], {}
        for doc_id, text, n in own:
            k = u[doc_id, text][2]
            classes[k] = (classes.get(k, (0, 0))[0] + 1, classes.get(k, (0, 0))[1] + n)
        p = scaled(classes, left)
        ranked = []
        for doc_id, text, n in own:
            r, tie, k = u[doc_id, text]
            q = 0.0 if p[k] >= 1 else 1.0 if p[k] <= 0 else (r / (1 - r)) * ((1 - p[k]) / p[k])
            ranked.append((q if p[k] >= 1 else 1.0 if p[k] <= 0 else q / (1 + q), doc_id is not None, doc_id or 0, n, tie, (doc_id, text)))
        so_far = 0
        for *_, n, _, key in sorted(ranked):
            extra = left > 0 and so_far + n / 2 <= left
            so_far += n if extra else 0
            if not extra:
                left = 0
            out.setdefault((source, key[0], n), []).append(whole + extra)
    return {k: sorted(v) for k, v in out.items()}, p


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_taken_are_those_of_the_ranking(spark, seed):
    data = rows()
    want, _ = ranking(spark, data, seed)
    text_sizes = {}
    for r in M.mix(spark.createDataFrame(data, SCHEMA), seed=seed, band_rows=50).collect():
        text_sizes.setdefault((r["doc_id"], r["size"]), []).append(r["copies"])
    merged = {}
    for (_, doc_id, n), copies in want.items():
        merged.setdefault((doc_id, n), []).extend(copies)
    assert {k: sorted(v) for k, v in text_sizes.items()} == {k: sorted(v) for k, v in merged.items()}


def test_inclusion_grows_with_the_size_and_is_met_over_seeds(spark):
    # One source gives a part of its words, the others are there to make it so.
    data = [(i, "w " * (20, 60, 200)[i % 3], "b", 0) for i in range(300)] + [(1000 + i, "w " * 200, "a", 0) for i in range(40)]
    docs = spark.createDataFrame(data, SCHEMA).coalesce(2)
    taken, seeds = {}, 15
    facts = M.stored(docs.select(*M.facts_of(docs)), "facts")
    for seed in range(seeds):
        for r in M.Cuts(facts, (1,), 3, seed, 1000).decide(facts.where("source = 'b'"), ["doc_id", "size"]).collect():
            taken[r["size"]] = taken.get(r["size"], 0) + r["copies"]
    rate = {size: n / (100 * seeds) for size, n in taken.items()}
    cut = M.Cuts(facts, (1,), 3, 0, 1000).table.where("of = 'b'").first()
    want = {size: cut["whole"] + cut["p"][k] for size, k in zip((20, 60, 200), docs.limit(3).select(M.size_class(M.words(F.col("text")))).toPandas().iloc[:, 0])}
    assert rate[20] < rate[60] < rate[200] and all(abs(rate[s] - want[s]) < 0.08 for s in rate)


def test_equal_rows_at_the_cut_are_split(spark):
    data = [(5, "w " * 10, "b", 0)] * 400 + [(i, "w " * 10, "a", 0) for i in range(100, 120)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = M.mix(docs, weights=(1,)).collect()
    own = [r for r in got if r["doc_id"] == 5]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 and len({r["copies"] for r in own}) == 2
    assert M.draw(docs, weights=(1,)).where("doc_id = 5").count() == sum(r["copies"] for r in own)


def test_many_sources_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    want = sorted(map(str, M.mix(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, M.mix(docs).collect())) == want


def test_the_cut_is_the_start_of_the_ranking(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 4), "a" if i % 3 else "b", 0) for i in range(600)], "doc_id long, text string, source string, x int")
    few, many = (sorted((r["doc_id"], r["copies"]) for r in M.mix(docs, band_rows=n).collect()) for n in (2, 10_000))
    assert few == many


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0 and M.draw(empty).count() == 0
