"""Token ids of documents in compressed files that give back single short documents.

A file set is a folder with three Parquet tables:

* `dictionary`: one row (hash, bytes), a zstandard dictionary trained on serialised ids; hash is the SHA-256 of the bytes.
* `segments`: rows of about `SEGMENT_BYTES`, in ascending doc_id order over the parts 0, 1, ... A row has the frames of its
  documents, one after the other, each compressed on its own with the dictionary, and the offset index: doc_ids, n_tokens and
  the end of each frame. first_id and last_id let a reader skip segments and row groups, dict_hash names the dictionary, and
  `before` counts the ids of earlier segments of the part.
* `parts`: (part, start), the ids of all parts before; one row for each range partition.

Ids are little-endian unsigned 32-bit integers. The tables are read and written by Spark alone, so they may lie in any
store that Spark reaches. A document's ids must fit into one row, some 500 million ids.

The dictionary is fitted on at most `SAMPLES` documents, chosen by a hash of the row, and one slice of `SLICE_IDS` ids of
each. It only serves the size of the files: without samples there is no dictionary, and frames do without.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored, text_or_empty

TOKENIZER = "word_bpe_49k.json"
END = 2
TEXT_BYTES = 4 << 20  # bytes of text that are encoded together
ENCODE_PIECES = 4096
HELD_PIECES = 1 << 19  # pieces whose ids are remembered
SAMPLES = 2000
SLICE_IDS = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SEGMENT_BYTES = 256 << 10
SEGMENT_DOCS = 4096

ENCODED = "doc_id long, n_tokens long, frame binary"
SEGMENTS = (
    "part int, first_id long, last_id long, before long, total long, dict_hash string,"
    " doc_ids array<bigint>, n_tokens array<bigint>, ends array<bigint>, frames binary"
)


#: Words of signs whose lower case and normal form are known to be one to one, and the pieces into which the tokenizer cuts
#: them once they are lower case. The endings behind an apostrophe are the tokenizer's.
PLAIN = "^[!-~À-ÖØ-öø-ÿ¡¿«»\u2010-\u2027]*$"
PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\x09-\\x0D a-zß-öø-ÿ0-9]+)"
SPECIAL = "<|"


class Dictionary(NamedTuple):
    hash: str
    data: bytes

    def zstd(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.data) if self.data else None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def split_long(text: str, limit: int = TEXT_BYTES) -> Iterator[str]:
    """The text in pieces of about `limit` characters that end at an ASCII blank; a word is never cut."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """Ids of texts, piece by piece.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids of a text are those of its
    words between ASCII white space, one after the other. Words of common signs are cut further, into the tokenizer's own
    pieces, of which there are far fewer. Pieces are numbered, the ids of piece k are `ids[starts[k]:starts[k] + sizes[k]]`,
    and words and texts are put together by numpy.
    """

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.numbers]
        if not new:
            return
        ids, sizes = [self.ids], []
        for i in range(0, len(new), ENCODE_PIECES):
            batch = new[i : i + ENCODE_PIECES]
            found = self.encode(batch, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(batch)))
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        added = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(added) - added])
        self.sizes = np.concatenate([self.sizes, added])
        self.ids = np.concatenate(ids)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.numbers) > HELD_PIECES:
            self.forget()
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(distinct, PLAIN), pc.invert(pc.match_substring(distinct, SPECIAL)))
        cut = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(distinct), PIECES, "\\1 "), distinct)
        pieces = pc.ascii_split_whitespace(cut)
        met = pieces.flatten().dictionary_encode()
        known = met.dictionary.to_pylist()
        self.learn(known)
        number = np.array([self.numbers[p] for p in known], np.int64)
        ids, ends = _gathered(self.ids, self.starts, self.sizes, number[met.indices.to_numpy()])
        # Ids of the distinct words, then of all words.
        bounds = ends[_offsets(pieces)]
        ids, ends = _gathered(ids, bounds[:-1], np.diff(bounds), coded.indices.to_numpy())
        bounds = ends[_offsets(words)]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def _offsets(lists: pa.ListArray) -> np.ndarray:
    found = lists.offsets.to_numpy()
    return found - found[0]


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of numbered runs, one after the other, and where each of them ends, from 0."""
    own = sizes[number]
    ends = np.concatenate([[0], np.cumsum(own)])
    return ids[np.repeat(starts[number] - ends[:-1], own) + np.arange(ends[-1])], ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_texts(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id; texts are taken together up to `TEXT_BYTES`, longer ones in pieces."""
    encode, end = encoder(path), np.array([END], np.uint32)
    sizes = pc.binary_length(texts).to_numpy()
    ends, start = np.cumsum(sizes), 0
    while start < len(texts):
        reach = (ends[start - 1] if start else 0) + TEXT_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
        if sizes[start] > TEXT_BYTES:
            pieces = [encode.of(pa.array([piece], pa.string()))[0] for piece in split_long(texts[start].as_py())]
            yield np.concatenate([*pieces, end])
        else:
            for ids in encode.of(texts.slice(start, stop - start)):
                yield np.concatenate([ids, end])
        start = stop


def serialised(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _slices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = []
            for key, ids in zip(batch.column("key").to_pylist(), encoded_texts(batch.column("text"), path)):
                at = (key % max(1, len(ids) - SLICE_IDS)) if len(ids) > SLICE_IDS else 0
                slices.append(serialised(ids[at : at + SLICE_IDS]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(slices, pa.binary())], names=["key", "ids"])

    return run


def _train(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [ids for batch in batches for ids in batch.column("ids").to_pylist()]
        try:
            data = zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
        except zstandard.ZstdError:  # too few samples for a trained one: their own bytes serve as the dictionary
            data = b"".join(samples)[:size]
        row = [pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, names=["hash", "data"])

    return run


def train(rows: DataFrame, path: str, samples: int = SAMPLES, size: int = DICTIONARY_BYTES) -> Dictionary:
    """A dictionary fitted in one task on at most `samples` slices, some 16 MB; `rows` has doc_id and text."""
    n = rows.count()
    key = F.xxhash64("doc_id", "text")
    # About twice as many rows as asked pass by their hash; the smallest of them are taken.
    share = F.abs(key % 1_000_003) <= int(1_000_003 * min(1.0, 2.0 * samples / max(n, 1)))
    slices = rows.where(share).select(key.alias("key"), "text").mapInArrow(_slices(path), "key long, ids binary")
    found = slices.orderBy("key", "ids").limit(samples).mapInArrow(_train(size), "hash string, data binary").collect()
    return Dictionary(found[0]["hash"], bytes(found[0]["data"])) if found else Dictionary(hashlib.sha256(b"").hexdigest(), b"")


def _encode(path: str, dictionary: Dictionary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.zstd()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known) if known else zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            counts, frames = [], []
            for ids in encoded_texts(batch.column("text"), path):
                counts.append(len(ids))
                frames.append(packer.compress(serialised(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"]
            )

    return run


def _segments(dict_hash: str):
    """Documents of one part, in order, to segments; one segment is held at a time."""
    schema = pa.schema(
        [
            ("part", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("total", pa.int64()), ("dict_hash", pa.string()),
            ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("frames", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, size = 0, 0, 0
        ids, counts, frames = [], [], []

        def row() -> pa.RecordBatch:
            named = [i for i in ids if i is not None]
            values = (
                part, min(named, default=None), max(named, default=None), before, sum(counts), dict_hash,
                ids, counts, np.cumsum([len(f) for f in frames]).tolist(), b"".join(frames),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            for at, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame"))):
                if ids and (size + len(frame) > SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS):
                    yield row()
                    before += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
                part = at
                ids.append(doc_id)
                counts.append(n)
                frames.append(frame)
                size += len(frame)
        if ids:
            yield row()

    return run


def write(docs: DataFrame, folder: str | None = None, path: str | None = None) -> str:
    """Encodes `docs` (doc_id, text) and writes a file set; returns its folder.

    Whole texts are encoded, null text as empty, special strings inside texts as the library takes them; every document ends
    with the id 2. Documents lie in ascending doc_id order, null first; rows with one doc_id go by a hash of their frames, so
    that a doc_id with very many rows is spread over parts. No row is left out. Other columns are not read.
    """
    spark = docs.sparkSession
    path, folder = path or default_path(), folder or scratch_path(spark, "llm-token-files")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    dictionary = train(rows, path)
    spark.createDataFrame([dictionary], "hash string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    frames = stored(rows.mapInArrow(_encode(path, dictionary), ENCODED).withColumn("tie", F.xxhash64("frame")), "token-frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = frames.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "frame")
    ranged.mapInArrow(_segments(dictionary.hash), SEGMENTS).write.option("compression", "uncompressed").parquet(f"{folder}/segments")
    totals = segments(spark, folder).groupBy("part").agg(F.sum("total").alias("total"))
    # One row for each range partition, whatever the input.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    starts.write.parquet(f"{folder}/parts")
    return folder


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")


def _unpack(dictionary: Dictionary, wanted: frozenset[int] | None):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.zstd()
        unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["dict_hash"].as_py() != dictionary.hash:
                    raise ValueError(f"segment of dictionary {row['dict_hash']}, the file set has {dictionary.hash}")
                doc_ids, counts, ends = (row[name].as_py() for name in ("doc_ids", "n_tokens", "ends"))
                frames = memoryview(row["frames"].as_buffer())
                starts = np.cumsum([row["start"].as_py(), *counts]).tolist()
                taken = [k for k, doc_id in enumerate(doc_ids) if wanted is None or doc_id in wanted]
                ids = [unpacker.decompress(frames[ends[k - 1] if k else 0 : ends[k]]) for k in taken]
                for k, found in zip(taken, ids):
                    if len(found) != 4 * counts[k]:
                        raise ValueError(f"document {doc_ids[k]}: {len(found)} bytes read, {counts[k]} ids in the index")
                columns = [[doc_ids[k] for k in taken], [starts[k] for k in taken], [counts[k] for k in taken], ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents read back from a file set, all or those asked for.

    `start` counts the ids of all documents before. Asked documents are looked up by the offset index: segments whose range of
    doc_ids holds none of them are skipped by the scan, and of the others only the asked frames are unpacked. `doc_ids` is
    meant for some hundreds of documents.
    """
    found = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = Dictionary(found["hash"], bytes(found["data"]))
    if hashlib.sha256(dictionary.data).hexdigest() != dictionary.hash:
        raise ValueError("the dictionary's bytes don't fit its hash")
    rows = segments(spark, folder)
    if doc_ids is not None:
        ranges = [F.col("first_id").__le__(i) & F.col("last_id").__ge__(i) for i in doc_ids]
        rows = rows.where(_any(ranges))
    parts = spark.read.schema("part int, start long").parquet(f"{folder}/parts")
    rows = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before"))  # a row for each range partition
    columns = ["dict_hash", "start", "doc_ids", "n_tokens", "ends", "frames"]
    wanted = None if doc_ids is None else frozenset(doc_ids)
    return rows.select(*columns).mapInArrow(_unpack(dictionary, wanted), "doc_id long, start long, n_tokens long, ids binary")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out
