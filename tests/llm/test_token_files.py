import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapspark.llm import token_files as T

SCHEMA = "doc_id long, text string, ids string, part string"


def some_texts():
    rnd = random.Random(4)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "é", "é", "́", "ñandú", "don't", "'s", "'", "123", "!?", "<|endoftext|>", "<|", " ", "　",
             "日本", "🙂", "'T", "'ll", "ll", "«", "¿", "…", "’", "ÀÉ", "ß", "ÿ", "µ", "ª", "×", "²", "<", "|>", "12", "ABC", "(", ")", "ΣΑΣ", "İ", "각", "가", "x.\ny", "ſ", "Å"]
    texts = [None, "", " ", "word " * 400_000, "x" * 20_000, "日本語の文" * 3000, "tail\n" * 10 + " "]
    return texts + ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(600)]


def want(rows):
    plain, out, start = T.tokenizer(T.default_path()), [], 0
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, T.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")).collect()), key=lambda r: r[1])


def test_round_trip(spark):
    texts = some_texts()
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    folder = T.write(docs)
    assert digest(T.read(spark, folder)) == want(rows)
    assert T.segments(spark, folder).select("part").distinct().count() > 1


def test_null_and_repeated_ids(spark):
    rows = [(None, "no id"), (None, None), (7, "again"), (7, "again"), (7, "other"), (8, "after")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = digest(T.read(spark, T.write(docs)))
    assert [r[0] for r in found] == [None, None, 7, 7, 7, 8]
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == sorted((str(r[0]), r[2], r[3]) for r in want(rows))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()


def test_empty(spark):
    assert T.read(spark, T.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_lookup_reads_few_segments(spark, monkeypatch):
    rows = [(i, f"document {i} " * (i % 40)) for i in range(3000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    folder = T.write(docs)
    asked = [5, 1234, 2999, 4000]
    assert digest(T.read(spark, folder, asked)) == [r for r in want(rows) if r[0] in asked]
    plan = T.read(spark, folder, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "first_id" in plan
    assert T.read(spark, folder, []).count() == 0


def test_a_wrong_dictionary_is_refused(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "x", "y") for i in range(20)], SCHEMA)
    folder, other = T.write(docs), T.write(docs.limit(0))
    spark.read.parquet(f"{other}/dictionary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="segment of dictionary"):
        T.read(spark, folder).count()


def test_pieces_of_a_long_text():
    text = "ab cd  ef\tgh " * 50
    pieces = list(T.split_long(text, 16))
    assert "".join(pieces) == text and len(pieces) > 20
    encode = T.Encoder(T.default_path())
    whole = encode.of(pa.array([text]))[0].tolist()
    assert [i for p in pieces for i in encode.of(pa.array([p]))[0].tolist()] == whole


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "HELD_PIECES", 20)
    encode = T.Encoder(T.default_path())
    for i in range(30):
        encode.of(pa.array([f"w{i}a w{i}b"]))
        assert len(encode.numbers) <= 20 + 20


def test_trained_dictionary_helps_short_documents():
    rnd = random.Random(2)
    vocabulary = rnd.choices(range(40_000), k=400)
    samples = [np.array(rnd.choices(vocabulary, k=60), "<u4").tobytes() for _ in range(2000)]
    import zstandard

    (batch,) = T._train(16 << 10)(iter([pa.RecordBatch.from_pydict({"key": range(2000), "ids": samples})]))
    found = T.Dictionary(batch.column("hash")[0].as_py(), batch.column("data")[0].as_py())
    assert len(found.data) <= 16 << 10
    packed = sum(len(zstandard.ZstdCompressor(level=3, dict_data=found.zstd()).compress(s)) for s in samples)
    assert packed < sum(len(zstandard.ZstdCompressor(level=3).compress(s)) for s in samples)
