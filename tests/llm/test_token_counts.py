import random

from snapspark.llm import token_counts as C


def test_counts_match_the_library(spark):
    rnd = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "ñandú", "don't", "'s", "123", "!?", "<|endoftext|>", "\u00a0", "\u3000", "日本", "🙂", "\x1c", "x.\ny"]
    texts = [None, "", " ", "word " * 300_000, "x" * 50_000] + ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(400)]
    plain = C.tokenizer(C.default_path())
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "no id", "n"), (7, "again", "n"), (7, "again", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    want = [(i, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    got = C.count(docs).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert C.count(docs.limit(0)).count() == 0


def test_batches_are_bounded_by_bytes():
    parts = ["abc"] * 10 + ["x" * 50] + ["de"] * 5
    batches = list(C.by_bytes(parts, 12))
    assert [p for b in batches for p in b] == parts
    assert all(sum(map(len, b)) <= 12 or len(b) == 1 for b in batches)


def test_remembered_lengths_are_bounded(monkeypatch):
    monkeypatch.setattr(C, "REMEMBER", 10)
    lengths = C.Lengths(C.default_path())
    for i in range(5):
        lengths.of([f"w{i}a w{i}b w{i}c w{i}d"])
        assert len(lengths.known) <= 10 + 4
