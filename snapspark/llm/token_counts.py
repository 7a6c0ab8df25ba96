"""Token counts of whole texts by a public tokenizer file, as lengths only.

Texts are split at safe boundaries: a single blank between two visible characters. The pre-tokenizer starts a new token
at such a blank whatever stands before or behind, so a text's count is the sum of its parts' counts, however long the
text is. Parts are encoded in batches of bounded bytes, each distinct part once per batch of texts, and only lengths
are kept. Recent lengths are remembered by the worker up to `REMEMBER` parts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 18
TEXT_BYTES = 4 << 20  # texts whose parts are looked up together
REMEMBER = 200_000
LONG_PART = 64  # longer parts are not remembered

#: A blank with a visible ASCII or Latin character on both sides.
BOUNDARY = re.compile(r" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def by_bytes(parts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The parts in batches of about equal bytes; a part above the limit is a batch of its own."""
    batch, held = [], 0
    for part in parts:
        if batch and held + len(part) > limit:
            yield batch
            batch, held = [], 0
        batch.append(part)
        held += len(part)
    if batch:
        yield batch


class Lengths:
    """Token counts of parts, remembered for parts met lately. The first part of a text has no blank before it."""

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.known: dict[str, int] = {}

    def learn(self, parts: set[str]) -> None:
        missing = sorted(parts - self.known.keys())
        for batch in by_bytes(missing):
            encoded = self.encode(batch, add_special_tokens=False)
            self.known.update(zip(batch, map(len, encoded)))

    def of(self, texts: list[str]) -> list[int]:
        split = [BOUNDARY.split(text) for text in texts]
        behind = {" " + part for parts in split for part in set(parts[1:])}
        first = {parts[0] for parts in split}
        self.learn(behind | first)
        known = self.known
        found = {part[1:]: known[part] for part in behind}
        counts = [known[parts[0]] + sum(map(found.__getitem__, parts[1:])) for parts in split]
        if len(known) > REMEMBER:
            self.known = {}
        else:
            for part in [p for p in behind | first if len(p) > LONG_PART]:
                del known[part]
        return counts


_lengths: dict[str, Lengths] = {}


def lengths(path: str) -> Lengths:
    if path not in _lengths:
        _lengths[path] = Lengths(path)
    return _lengths[path]


def count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = lengths(path)
        for batch in batches:
            texts, sizes = batch.column("text"), batch.column("n_bytes").to_numpy()
            counts, start = [], 0
            ends = np.cumsum(sizes)
            while start < len(texts):
                reach = (ends[start - 1] if start else 0) + TEXT_BYTES
                stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
                counts += counter.of(texts.slice(start, stop - start).to_pylist())
                start = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty and has 0 tokens. Special strings inside a text are single tokens, as the library takes
    them by default; none are added. Only doc_id and text are read. An empty table gives no rows.
    """
    text = text_or_empty(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count_batches(path or default_path()), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
