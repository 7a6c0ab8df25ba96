import random
import re

import numpy as np
import pyarrow as pa
import pytest

from snapspark.llm import words as W

PATTERNS = {"spaces": (W.SPACES, rb"[^\x20\x09-\x0D]+"), "signs": (W.SIGNS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def texts():
    rnd = random.Random(4)
    parts = ["a", "Ab", "aB", "é", "0", "7x", ".", ",", " ", "\t", "\n", "\x0b", "ß-", "word", "WORD", "\x00", "日本"]
    return ["", None, " ", "x"] + ["".join(rnd.choices(parts, k=rnd.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize("kind", PATTERNS)
@pytest.mark.parametrize("limit", [7, 64, 1 << 20])
def test_words_match_the_pattern(kind, limit):
    separator, pattern = PATTERNS[kind]
    source = texts()
    seen, rows = {}, []
    for first, end, bounds, hashes, starts, ends in W.scan(pa.array(source), separator, lambda p: (p.hashes(), *p.places()), limit):
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            rows.append((hashes[a:b], starts[a:b], ends[a:b]))
        assert len(rows) == end
    assert len(rows) == len(source)
    for text, (hashes, starts, ends) in zip(source, rows):
        found = list(re.finditer(pattern, (text or "").encode().lower()))
        assert [(m.start(), m.end()) for m in found] == list(zip(starts, ends))
        for m, h in zip(found, hashes.tolist()):
            assert seen.setdefault(m[0], h) == h
    assert len(set(seen.values())) == len(seen)


def test_mix_spreads():
    assert len(np.unique(W.mix(np.arange(10_000)))) == 10_000
