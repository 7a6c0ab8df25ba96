import itertools
import re

from snapspark.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, mask int, part string, n int"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(text):
    words = re.findall(r"[^ \t-\r]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(rows, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, source, *_ in rows:
        text = text or ""
        failed = {k for k, v in fails(text).items() if v}
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows):
            failed.add("E")
        docs.append((source or "", failed, doc_id in good, doc_id in toxic))
    out, removed_by = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                redundant = sum(letter in d[1] for d in own) - len(gone)
                unique = sum(d[1] == {letter} for d in own)
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_brute_force(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [
        plain, plain + " # ", plain + " x" * 40, "SHOUT " + plain, "few words", "", None, "few $ WORDS", " \t\n", "Ünïcode É " * 30,
        "A B C " * 30, plain + "\x0bplain\x0cmore", "long " * 50_000 + "#", plain.upper() + " |", "a b " + plain,
    ]
    rows = [(i, texts[i % len(texts)], ["web", "", None, "wiki"][i % 4], 0, "p", 1) for i in range(70)]
    rows += [(None, plain, "web", 0, "p", 1), (None, "alone here", "none", 0, "p", 1), (500, plain, "late", 0, "p", 1)]
    rows += [(600, "again " + plain, "web", 0, "p", 1)] * 3 + [(600, plain, "wiki", 0, "p", 1), (-5, plain, "web", 0, "p", 1)]
    labels = [(i, i % 2, i % 3, "") for i in range(0, 70, 2)] + [(600, 0, 0, ""), (600, 1, None, ""), (None, 1, 1, ""), (9999, 1, 1, ""), (4, None, 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    limit = spark.conf.get(A.ROWS_LIMIT)
    found = A.audit(docs, spark.createDataFrame(labels, LABELS))
    assert sorted(found.columns) == sorted(COLUMNS)
    assert sorted(tuple(r) for r in found.select(*COLUMNS).collect()) == brute(rows, labels)
    assert spark.conf.get(A.ROWS_LIMIT) == limit


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "one", "web", 0, "", 0)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    found = sorted(tuple(r) for r in A.audit(docs, none).select(*COLUMNS).collect())
    assert found == brute([(1, "one", "web")], [])
    assert A.audit(docs.limit(0), none).count() == 0


def test_many_parts_pass_the_limit_of_the_recursion(spark):
    from pyspark.sql import functions as F

    cells = spark.range(40).select(
        F.col("id").cast("string").alias("part"), F.array(F.struct(F.lit(3).alias("mask"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))).alias("cells")
    )
    before = spark.conf.get(A.ROWS_LIMIT)
    spark.conf.set(A.ROWS_LIMIT, 1000)
    try:
        assert A.orders(cells).count() == 40 * 120
        assert spark.conf.get(A.ROWS_LIMIT) == "1000"
    finally:
        spark.conf.set(A.ROWS_LIMIT, before)
