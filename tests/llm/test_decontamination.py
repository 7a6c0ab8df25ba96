import random
import re

import pytest

from snapspark.llm import decontamination as D

WORD = re.compile(D.WORD)


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if found := windows.get(tuple(own[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc, len(own), len(hit), sorted(names)))
    return out


def data(n):
    rnd = random.Random(n)
    text = lambda size, k: " ".join(rnd.choice("abcdef")[:k] * rnd.randrange(1, 3) for _ in range(size))
    items = [(i, text(rnd.choice([2, 3, 5, 9, 14]), 1)) for i in range(25)] + [(None, "zz yy xx ww"), (7, None), (8, "..."), (9, "A,b;c d"), (9, "A,b;c d")]
    docs = [(i, text(rnd.randrange(0, 60), 1)) for i in range(60)] + [(None, None), (1, ""), (2, "é zz YY-xx.ww é"), (2, "é zz YY-xx.ww é"), (3, "q " * 50_000 + "zz yy xx ww")]
    return docs, items


@pytest.mark.parametrize("n", [3, 4, 10])
@pytest.mark.parametrize("block", [20, 100_000])
def test_find_matches_brute_force(spark, n, block):
    docs, items = data(n)
    table = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, items string, spans int").repartition(3)
    found = D.find(table, spark.createDataFrame(items, "item_id long, text string"), n, block_words=block, piece_words=max(12, n + 2), columns=["doc_id", "text"])
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, n), key=str)
    for r in found.where("n_hit > 0").collect():
        raw = r["text"].encode()
        for s in r["spans"]:
            assert len(words(raw[s["start"] : s["end"]].decode())) == s["words"]


def test_clean_takes_spans_out_or_drops_the_document(spark):
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    docs = [(1, "keep A, b c d; the rest of it", "z"), (2, "a b c d", "z"), (3, "é nothing here", "z"), (4, None, None), (5, "x a b c d a b c d y z w v u t s", "z")]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    got = {r["doc_id"]: r["text"] for r in D.clean(table, items, n=4, most=0.5).collect()}
    assert got == {1: "keep ; the rest of it", 3: "é nothing here", 4: None, 5: "x  y z w v u t s"}
    assert D.clean(table, items, n=4).columns == table.columns
    assert {r[0] for r in D.clean(table, items, n=4, most=0.0).select("doc_id").collect()} == {3, 4}


def test_a_text_goes_to_the_tasks_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(D, "prefixed", lambda df, schema, old=D.prefixed: sent.append([f.name for f in df.schema if f.dataType.simpleString() == "string"]) or old(df, schema))
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    table = spark.createDataFrame([(1, "x a b c d y", "z"), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, D.clean(table, items, n=4, most=0.9).collect())) == [(1, "x  y", "z"), (2, None, None)]
    assert [len(columns) for columns in sent] == [2]  # text and lang
    binary = table.select("doc_id", table["text"].cast("binary").alias("text"))
    assert [tuple(r)[2:5] for r in D.find(binary, items, 4).orderBy("doc_id").collect()] == [(6, 4, ["1"]), (0, 0, [])]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find(docs, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[2:5] for r in D.find(one, items).collect()] == [(2, 0, [])]
