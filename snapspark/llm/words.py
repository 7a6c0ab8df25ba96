"""Words of Arrow text columns as numpy arrays: places, rows and 64-bit hashes, without a Python loop over words.

A text is taken as UTF-8 bytes, ASCII letters in lower case. A word's hash is a polynomial over a random value of each
byte, taken from one running sum over the bytes, so any part of a word (a prefix, an ending) costs one subtraction.
Texts are worked on in pieces of bounded size that end at a separator; a word is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes worked on at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def separators(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Bytes between words `[^\x20\x09-\x0D]+`.
SPACES = separators(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Bytes between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: all but digits, letters and non-ASCII.
SIGNS = separators(lambda b: not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))
#: As SIGNS, and digits separate too.
LETTERS = separators(lambda b: not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole output."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    return mix(lower_table().astype(np.uint64) + np.uint64(0x51ED2701))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


@dataclass
class Piece:
    """Words of a run of whole rows, or of a part of one long row. `starts` and `ends` are places in `data`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray  # where rows start in `data`
    offset: int  # place of data[0] in its row, for a part of a long row
    sums: np.ndarray = field(repr=False)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte places of the words in their texts."""
        shift = self.offset - self.bounds[self.rows]
        return self.starts + shift, self.ends + shift

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, down = _power_tables(len(self.data))
        return mix((self.sums[b] - self.sums[a]) * down[a] + (b - a).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def _piece(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray, offset: int) -> Piece:
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    up, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return Piece(data, starts, ends, rows, bounds, offset, sums)


def _cuts(data: np.ndarray, separator: np.ndarray, limit: int) -> list[int]:
    """Places at which a long text is cut: behind the last separator of each stretch, or the next one after it."""
    cuts, at = [0], 0
    while len(data) - at > limit:
        found = np.flatnonzero(separator[data[at : at + limit]])
        if len(found):
            at += int(found[-1]) + 1
        else:
            step = at + limit
            while step < len(data) and not separator[data[step]]:
                ahead = np.flatnonzero(separator[data[step : step + limit]])
                step = step + int(ahead[0]) if len(ahead) else min(len(data), step + limit)
            at = step
        cuts.append(at)
    return cuts if cuts[-1] == len(data) else [*cuts, len(data)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def scan(
    column: pa.Array, separator: np.ndarray, measure: Callable[[Piece], tuple[np.ndarray, ...]], limit: int = PIECE
) -> Iterator[tuple]:
    """(first row, end row, bounds, value arrays): the words of whole rows; words of row `first + i` are `bounds[i]:bounds[i + 1]`."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        part = data[offsets[row] : offsets[end]]
        places = offsets[row : end + 1] - offsets[row]
        if len(part) <= limit:
            piece = _piece(part, places, separator, 0)
            values = measure(piece)
            bounds = np.searchsorted(piece.rows, np.arange(end - row + 1))
        else:
            cuts = _cuts(part, separator, limit)
            found = [measure(_piece(part[a:b], np.array([0, b - a]), separator, a)) for a, b in zip(cuts, cuts[1:])]
            values = tuple(np.concatenate(x) for x in zip(*found))
            bounds = np.array([0, len(values[0])])
        yield row, end, bounds, *values
        row = end


def word_hashes(column: pa.Array, separator: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return scan(column, separator, lambda piece: (piece.hashes(),))
