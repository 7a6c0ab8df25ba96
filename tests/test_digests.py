"""Hash trees: order is seen, and differing ranges are found."""

import random

import pytest
from pyspark.sql import functions as F

from snapspark.operators import audit as D
from snapspark.operators import digests as H


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, place long, text string").repartition(4)


def base(n=700):
    return [(i * 3, i, f"row {i}") for i in range(n)]


def found(spark, rows, at, **kw):
    trees = [H.tree(table(spark, r), at, ["id", "text"], width=16, fan=4) for r in (base(), rows)]
    return sorted((r.block, r.primary_rows, r.secondary_rows) for r in H.differing(*trees, fan=4).collect())


def test_swapped_changed_and_moved_rows_are_located(spark):
    rows = base()
    assert found(spark, rows, "place") == []
    swapped = [(i, {5: 600, 600: 5}.get(p, p), t) for i, p, t in rows]
    assert found(spark, swapped, "place") == [(0, 16, 16), (37, 16, 16)]
    neighbours = [(i, {5: 6, 6: 5}.get(p, p), t) for i, p, t in rows]
    assert found(spark, neighbours, "place") == [(0, 16, 16)]
    changed = [(i, p, "other" if p == 333 else t) for i, p, t in rows]
    assert found(spark, changed, "place") == [(333 // 16, 16, 16)]
    # One row less changes its own range of ids alone.
    assert found(spark, [r for r in rows if r[1] != 333], "id") == [(999 // 16, 5, 4)]
    # Trees of unequal height.
    assert found(spark, rows[:16], "place") == [(b, 16 if b < 43 else 12, 0) for b in range(1, 44)]
    assert found(spark, [], "place") == [(b, 16 if b < 43 else 12, 0) for b in range(44)]


def test_negative_ids_and_null_text(spark):
    rows = [(i, 0, None if i % 7 == 0 else str(i)) for i in range(-100, 100)]
    one, two = (H.tree(table(spark, r), "id", ["text"], width=16, fan=4) for r in (rows, [(i, p, t or "") for i, p, t in rows]))
    assert H.differing(one, one, fan=4).count() == 0
    assert {r.block for r in H.differing(one, two, fan=4).collect()} == {int(i / 16) for i in range(-100, 100) if i % 7 == 0}


def test_ordered_digests_of_groups(spark):
    rnd = random.Random(3)
    rows = [(g, i, f"{g} {i}") for g, n in (("a", 5), ("b", 500), ("c", 1), ("d", 64)) for i in range(n)]
    rnd.shuffle(rows)
    df = lambda r: spark.createDataFrame(r, "g string, i int, text string").repartition(5)
    digests = lambda r: {x.g: (x.rows, x.digest) for x in H.ordered(df(r), ["i"], ["text"], "g", width=16, fan=4).collect()}
    one, two = digests(rows), digests([*rows[::-1]])
    assert one == two and {g: n for g, (n, _) in one.items()} == {"a": 5, "b": 500, "c": 1, "d": 64}
    # The digest of a group does not depend on the size of others.
    assert digests([r for r in rows if r[0] != "b"]) == {g: v for g, v in one.items() if g != "b"}
    other = digests([(g, {("b", 7): 8, ("b", 8): 7}.get((g, i), i), t) for g, i, t in rows])
    assert {g for g in one if one[g] != other[g]} == {"b"}


def test_bytes_and_rows(spark):
    rows = table(spark, base(100))
    root = H.roots(H.tree(rows, "place", ["id", "text"], width=8, fan=4)).first()
    flat = D.multiset_digest(rows, ["id", "text"]).first()
    assert (root.rows, root.bytes) == (flat.rows, flat.bytes)


@pytest.mark.parametrize("seed", range(2))
def test_located_comparison_equals_the_whole_one(spark, seed):
    rnd = random.Random(seed)
    rows = base(300)
    other = [(i, p, rnd.choice(["x", t])) if rnd.random() < 0.05 else (i, p, t) for i, p, t in rows if rnd.random() > 0.02] + [(5000, 1, "new"), (-9, 2, None)]
    sides = [table(spark, r) for r in (rows, other)]
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(H.compare_located(*sides, "id", width=8)) == as_set(D.compare_rows(*sides, ["id"])) != set()


def test_unaltered_tables_need_no_rows(spark):
    rows = table(spark, base(100))
    assert H.compare_located(rows, rows, "id").count() == 0
    assert H.compare_located(rows, rows.where(F.lit(False)), "id").count() == 100
