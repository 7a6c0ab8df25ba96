import random

import pytest

from snapspark.llm import ngram_join as J
from snapspark.llm.components import components


def sets(text, width):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split() if w]
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, num):
    found = [sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(found[i] & found[j])
            if found[i] and 100 * common >= num * len(found[i] | found[j]) and common:
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in low.items()}
    return [(doc, len(found[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)], root


def corpus():
    rnd = random.Random(7)
    word = lambda: rnd.choice("abcdefghijkl") * rnd.randrange(1, 4) + str(rnd.randrange(30))
    rows = [(None, None), (1, ""), (2, " \n "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "one two three"), (None, "one two")]
    passage = [word() for _ in range(30)]
    for base in range(12):
        size = rnd.choice([8, 12, 18, 24, 40, 90, 300])
        words = [word() for _ in range(size)] + (passage if base % 3 == 0 else [])
        for _ in range(rnd.randrange(2, 9)):
            own = list(words)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = word()
            if rnd.random() < 0.3:
                own.append(word())
            rows.append((len(rows) + 100, " ".join(own)))
    return rows + [(500, rows[30][1]), (500, rows[30][1]), (501, "x " * 30_000)]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (2, 60)])
def test_link_finds_every_component(spark, width, num, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 4)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, component string, n int").repartition(4)
    want, root = brute(rows, width, num)
    got = [tuple(r) for r in J.link(docs, width, (num, 100)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = J.one_of_each(docs, width, (num, 100))
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.collect()]
    alone = sum(1 for d, t in rows if not sets(t, width))
    assert len(kept) == alone + len({root(i) for i, (_, t) in enumerate(rows) if sets(t, width)})


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.link(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_boundary_is_where_subsets_get_dearer_than_lists():
    light = J.boundary((90, 100))
    cost = lambda n: n + 1 - J.least_common(n, (90, 100)) + J.LIST_COST
    assert J.subsets(light, (90, 100)) <= cost(light) and J.subsets(light + 1, (90, 100)) > cost(light + 1)


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 209)}}
