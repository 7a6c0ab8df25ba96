import math
import zlib
from collections import Counter

import numpy as np
import pytest

from snapspark.llm import brown_lm as B


def words(text):
    return (text or "").encode().lower().split() + [None]  # None: the end


def likelihood(n, of):
    into = np.zeros((B.ITEMS, B.CLASSES))
    into[np.arange(B.ITEMS), of] = 1
    pairs = into.T @ n @ into
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(pairs) - f(pairs.sum(axis=0)) - f(pairs.sum(axis=1))


def test_exchange_raises_the_likelihood_to_a_local_best():
    random = np.random.default_rng(1)
    n = np.zeros((B.ITEMS, B.ITEMS))
    n[:60, :60] = random.poisson(2 * (random.integers(0, 2, (60, 1)) == random.integers(0, 2, (1, 60))) + 0.2)
    n[B.START, :60] = 1
    n[:60, B.END] = 1
    one, many = B.exchange(n, passes=1), B.exchange(n, passes=50)
    assert likelihood(n, many) >= likelihood(n, one)
    for w in range(0, 60, 7):
        for k in range(B.CLASSES - 2):
            other = many.copy()
            other[w] = k
            assert likelihood(n, other) <= likelihood(n, many) + 1e-6


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (9001, ""), (9002, "Zzz zzz unseen"), (9002, "Zzz zzz unseen"), (9003, "the " * 60_000)], "doc_id long, text string")
    table = docs.unionByName(odd)
    return table, [tuple(r) for r in table.collect()]


def test_counts_and_base_scores(spark, corpus, monkeypatch):
    table, rows = corpus
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, base))
    for known in (B.KNOWN, 600):  # most counts at hand, or most met in the join
        monkeypatch.setattr(B, "KNOWN", known)
        got = B.score(table).collect()
        assert len(got) == len(want)
        for g, w in zip(sorted((tuple(r)[:6] for r in got), key=str), sorted(want, key=str)):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        scores = {(r["doc_id"], r["n_tokens"]): r["score"] for r in got}
        if known != 600:
            first = scores
    assert all(math.isclose(scores[k], first[k], rel_tol=1e-9) for k in scores)
    ours, base = (sum(r[c] for r in got if r["held_out"] and r["n_tokens"] > 5) for c in ("score", "base_score"))
    assert ours > base


def test_probabilities_sum_to_one(spark, corpus):
    table, rows = corpus
    model, counts = B.train(table.where("text is not null").select("text"))
    transition, emission = 10**model.transition, 10**model.emission
    assert np.allclose(transition.sum(axis=1), 1)
    words_of = {e: [] for e in range(B.ENDINGS)}
    frequent = set(model.frequent.view(np.int64).tolist())
    for r in counts.where("ending >= 0").collect():
        if r["word"] not in frequent:
            words_of[r["ending"]].append(r["n"])
    total = np.zeros(B.CLASSES)
    for item in range(B.ITEMS):
        # Words of an ending, and one unseen word.
        mass = emission[item] * (sum(c + 0.5 for c in words_of[item - B.WORDS]) + 0.5) if B.WORDS <= item < B.START else emission[item]
        total[model.of[item]] += mass
    filled = np.isin(np.arange(B.CLASSES), model.of)
    assert np.allclose(total[filled], 1)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = B.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert only["train_tokens"] == 0 and only["base_score"] == 0 and math.isfinite(only["score"])


def all_but_single(rows):
    """A number of known words that leaves out just those that occur once."""
    return sum(n > 1 for n in Counter(w for t in rows for w in words(t) if w).values()) + 1


@pytest.mark.parametrize("known, rounds", [(B.KNOWN, 1), (520, 1), (520, 4), ("twice", 1)])
def test_each_word_has_a_class_of_its_own(spark, monkeypatch, known, rounds):
    # Words of two kinds stand where the frequent `u` and `v` do; all end alike, and none is among the most frequent ones.
    random = np.random.default_rng(5)
    common = " ".join(f"c{i} c{i}" for i in range(600)) + " "
    kinds = (("p r", "u", "x"), ("q q", "v", "y"))
    texts = [" ".join(f"{a} {b if i % 4 < 2 else f'{c}{random.integers(40)}zzz'}" for i in range(80) for a, b, c in [kinds[i % 2]]) for _ in range(60)]
    texts += ["once0 u once1 v", "once2", "p once3 once4 once5"]
    docs = spark.createDataFrame([(common * 20,)] + [(t,) for t in texts], "text string")
    monkeypatch.setattr(B, "KNOWN", all_but_single([common * 20, *texts]) if known == "twice" else known)
    model, counts = B.train(docs)
    assert len(model.frequent) == B.WORDS
    classes = B.refine(docs, model, counts, rounds)
    assert classes.table.count() == counts.count()
    start = counts.mapInArrow(B.first_classes(spark.sparkContext.broadcast((model.frequent, model.of))), "word long, n long, class int")
    ours = counts.where("n between 2 and 39 and ending >= 0").select("word")
    assert start.join(ours, "word").select("class").distinct().count() == 1
    assert classes.table.join(ours, "word").select("class").distinct().count() > 1
    assert B.likelihood(classes.pairs) > B.likelihood(B.refine(docs, model, counts, rounds=0).pairs)
    # Class bigrams against the texts.
    of = {r["word"]: r["class"] for r in classes.table.collect()}
    pairs = np.zeros((B.CLASSES, B.CLASSES))
    for r in docs.collect():
        hashes = next(B.scan(B.pa.array([r["text"]]), B.SPACES, B.word_measures))[3].view(np.int64).tolist()
        line = [B.CLASSES - 2, *(of[h] for h in hashes), B.CLASSES - 1]
        np.add.at(pairs, (line[:-1], line[1:]), 1)
    assert (pairs == classes.pairs).all()
    # Words of each class, with the unseen one of each ending, share all of its mass.
    steps = B.steps_between(classes, model)
    mass = np.bincount(model.of[B.WORDS : B.START], minlength=B.CLASSES) * 0.5
    for r in classes.table.collect():
        mass[r["class"]] += r["n"] + 0.5
    assert np.allclose((10**steps * mass)[:, mass > 0], B.smoothed(classes.pairs)[:, mass > 0])


@pytest.mark.parametrize("known", [B.KNOWN, 520, "twice"])
def test_scores_follow_from_classes_and_counts(spark, corpus, monkeypatch, known):
    table, rows = corpus
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    monkeypatch.setattr(B, "KNOWN", all_but_single([t for i, t in rows if not held(i)]) if known == "twice" else known)
    learnt = spark.createDataFrame([(t or "",) for i, t in rows if not held(i)], "text string")
    model, counts = B.train(learnt)
    classes = B.refine(learnt, model, counts)
    assert known != "twice" or classes.cut == 2
    found = {r["word"]: (r["class"], r["n"]) for r in classes.table.collect()}
    mass = np.zeros(B.CLASSES)
    for own, n in found.values():
        mass[own] += n + 0.5
    for own in model.of[B.WORDS : B.START]:
        mass[own] += 0.5
    step = np.log10(B.smoothed(classes.pairs)) - np.log10(np.maximum(mass, 0.5))
    want = []
    for i, t in rows:
        _, _, _, hashes, endings = next(B.scan(B.pa.array([t or ""]), B.SPACES, B.word_measures))
        line, logs = [B.CLASSES - 2], math.log10(model.end_count + 0.5)
        for h, e in zip(hashes.view(np.int64).tolist(), endings.tolist()):
            own, n = found.get(h, (int(model.of[B.WORDS + e]), 0))
            line.append(own)
            logs += math.log10(n + 0.5)
        line.append(B.CLASSES - 1)
        want.append((i, len(hashes) + 1, logs + float(step[line[:-1], line[1:]].sum())))
    got = [(r["doc_id"], r["n_tokens"], r["score"]) for r in B.score(table).collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)


def test_cells_of_a_word_are_summed_over_batches():
    # One word over three batches, another inside the second; by the first, 1 stands behind class 5, 9 before class 7.
    pairs = np.ones((B.CLASSES, B.CLASSES))
    packed = lambda *cells: np.array(list(cells), dtype=B.CELL).tobytes()
    schema = B.pa.schema([("key", B.pa.int64()), ("word", B.pa.int64()), ("n", B.pa.int64()), ("class", B.pa.int32()), ("cells", B.pa.binary())])
    rows = [(3, 33, 9, 4, None), (3, None, None, None, packed((7, 4))), (5, None, None, None, packed((B.CLASSES + 5, 1))), (5, 55, 9, 4, None),
            (5, 56, 2, 4, None), (5, None, None, None, packed((7, 9), (B.CLASSES + 5, 2))), (9, 99, 1, B.CLASSES - 1, None)]
    seen = []

    def spy(near, n, own, p, single):
        seen.extend(zip(n.tolist(), near[:, 7].tolist(), near[:, B.CLASSES + 5].tolist()))
        return own

    original, B.best_classes = B.best_classes, spy
    try:
        for cuts in ([2, 4], [1, 3, 5, 6], [], range(1, 7)):
            seen.clear()
            bounds = [0, *cuts, len(rows)]
            batches = [B.pa.RecordBatch.from_arrays([B.pa.array([r[k] for r in rows[a:b]], f.type) for k, f in enumerate(schema)], schema=schema) for a, b in zip(bounds, bounds[1:])]
            out = list(B.choose(type("Held", (), {"value": pairs}))(iter(batches)))
            words = [w for b in out for w in b.column("word").to_pylist()]
            assert sorted(words) == [33, 55, 56, 99]
            assert sorted(seen) == [(1, 0.0, 0.0), (2, 9.0, 3.0), (9, 4.0, 0.0), (9, 9.0, 3.0)]
    finally:
        B.best_classes = original


def test_index_finds_all_and_nothing_else():
    random = np.random.default_rng(3)
    known = np.unique(random.integers(0, 2**64, 5000, dtype=np.uint64))
    known = np.unique(np.concatenate([known, known[:50] + np.uint64(1), np.array([0, 2**64 - 1], dtype=np.uint64)]))
    asked = np.concatenate([known, random.integers(0, 2**64, 5000, dtype=np.uint64)])
    place = B.Index(known).find(asked)
    assert (place[: len(known)] == np.arange(len(known))).all()
    assert all((p >= 0) == (a in set(known.tolist())) for a, p in zip(asked[len(known) :].tolist(), place[len(known) :].tolist()))
    assert (B.Index(known[:0]).find(asked) == -1).all()
