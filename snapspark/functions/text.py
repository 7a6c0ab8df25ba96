"""Token folding without Python in the tasks: one translate table built from the Unicode data."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a letter or digit followed by letters, digits and combining marks.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


@cache
def _fold_table() -> tuple[str, str]:
    """Characters that decompose to one base letter plus marks, then the combining marks, which are dropped."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            pairs.append((char, parts[0]))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(p[0] for p in pairs) + marks, "".join(p[1] for p in pairs)


def fold(col: Column) -> Column:
    source, target = _fold_table()
    return F.translate(F.lower(col), source, target)


def fold_text(text: str) -> str:
    """As `fold`, of one search term."""
    source, target = _fold_table()
    kept = len(target)
    return text.lower().translate(str.maketrans(source[:kept], target, source[kept:]))


def tokens(col: Column) -> Column:
    """Distinct folded tokens of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0)), fold))


def parse_query(raw: str) -> list[str]:
    """Search terms of one query string: 1 to 5 words of 2 to 32 letters or digits."""
    text = " ".join(unicodedata.normalize("NFKC", raw).split()).lower()
    if not 1 <= len(text) <= 64:
        raise ValueError("a search has 1 to 64 characters")
    terms, word = [], ""
    for char in text + " ":
        if unicodedata.category(char)[0] in "LN":
            word += char
        elif word:
            terms.append(word)
            word = ""
    if not 1 <= len(terms) <= 5 or any(not 2 <= len(t) <= 32 for t in terms):
        raise ValueError("a search has up to five words of 2 to 32 characters")
    return terms
