import hashlib
import random
import zlib

import pytest

from snapspark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, block int, key1 string, words long"


def brute(sequences):
    """Nodes of {conv_id: [(role, text), ...]} as `summary` gives them."""
    members, children = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    subtree = {}
    for path in members:
        for d in range(len(path) + 1):
            subtree.setdefault(path[:d], []).append(path)
    out = []
    for path, ids in members.items():
        below = subtree[path]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].split()) for u in below if u)
        ends = ",".join(str(c) for c in sorted(ids) if len(sequences[c]) == len(path))
        out.append(
            (min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, [])), sum(u not in children for u in below),
             saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def sequences(rows):
    out = {}
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def mended(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(trie):
    return sorted((tuple(r) for r in P.summary(trie).collect()), key=str)


def some_rows(seed, n=60, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rnd.random()
        for t in range(rnd.randrange(1, longest)):
            text = rnd.choice(["a b", "a", "", None, "x\ty z"]) if kind < 0.7 else f"only {c} {t}"
            rows.append((c * rnd.choice([1, 3]) if kind < 0.2 else c, t, rnd.choice(["user", "user", None, "u"]), text, 7, "k", 9))
    # one turn for each (conversation, turn)
    unique = {(r[0], r[1]): r for r in rows}
    return list(unique.values())


@pytest.mark.parametrize("block, band", [(1024, 256), (4, 3), (1, 1)])
def test_against_brute_force(spark, block, band):
    rows = some_rows(block)
    turns = P.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert nodes(P.build(turns, block=block, band=band)) == brute(sequences(rows))


def test_rebuilt(spark):
    rows = [r for r in some_rows(5, 90) if r[0] not in (20, 40)] + [(-7, 0, "user", "a b", 1, "", 1), (-20, 0, "user", "c d", 1, "", 1)]
    rows += [(c, 0, "user", "one", 1, "", 1) for c in (41, 42, 43, 44, 45)]  # a first turn only, its family's first absent
    rows = list({(r[0], r[1]): r for r in rows}.values())
    own = P.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    want = mended(sequences(rows))
    assert any(not turns for turns in want.values())
    assert nodes(P.build(*P.rebuilt(own), block=8, band=2)) == brute(want)


def test_hot_paths_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "HEAVY", 2)
    rows = [(c, t, "user", f"turn {t}", 0, "", 0) for c in range(100) for t in range(6)]  # one conversation a hundred times
    rows += [(1000, t, "user", f"turn {t}", 0, "", 0) for t in range(300)]  # a long one that begins like the others
    rows += [(2000 + c, 0, "user", f"other {c}", 0, "", 0) for c in range(150)]
    rows += [(3000, None, "system", "first", 0, "", 0), (3000, 0, "user", "word " * 100_000, 0, "", 0), (None, 0, "user", "lost", 0, "", 0)]
    rows += [(3001, 0, "ab", "c", 0, "", 0), (3002, 0, "a", "bc", 0, "", 0)]  # role and text do not run together
    turns = P.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert nodes(P.build(turns, block=16, band=4)) == brute(sequences(rows))


def test_ties_and_repeats(spark):
    rows = [(1, 0, "b", "x", 0, "", 0), (1, 0, "a", "y", 0, "", 0), (2, 0, "a", "y", 0, "", 0), (2, 0, "b", "x", 0, "", 0), (3, 0, "a", "y", 0, "", 0), (3, 0, "a", "y", 0, "", 0)]
    found = nodes(P.build(P.ordered_turns(spark.createDataFrame(rows, SCHEMA))))
    assert found == brute({1: [("a", "y"), ("b", "x")], 2: [("a", "y"), ("b", "x")], 3: [("a", "y"), ("a", "y")]})


def test_empty_and_turnless(spark):
    empty = P.ordered_turns(spark.createDataFrame([], SCHEMA))
    assert nodes(P.build(empty)) == []
    assert nodes(P.build(*P.rebuilt(empty))) == []
    turnless = spark.createDataFrame([(4, 0), (11, 0)], "conv_id long, length long")
    assert nodes(P.build(empty, turnless)) == brute({4: [], 11: []})
