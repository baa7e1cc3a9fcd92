"""Words of UTF-8 texts as numpy arrays: bounds, 64-bit hashes, n-gram hashes.

Both word contracts used here are decided by single bytes, since every byte of a non-ASCII character is above 0x7F.
A column of texts therefore never has to be decoded: the Arrow buffer is classified by table, and a word's hash is
the difference of two prefix sums. Texts are handled in chunks of about a quarter of a megabyte, so memory follows the longest
text and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_STEP, _GRAM = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`: all but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, self.base, U64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, self.inverse, U64)]))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(_STEP), _Powers(_GRAM)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Words:
    """Words of consecutive texts. `first[i]:first[i + 1]` are the words of text i; bounds are bytes in `data`."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int, fold: np.ndarray = SAME) -> bytes:
        """Words i to j - 1 joined by one space."""
        data = self.data
        return b" ".join(fold[data[a:b]].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def scan(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, fold: np.ndarray = SAME, part: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of the texts data[bounds[i]:bounds[i + 1]]; `kind` tells word bytes, `fold` maps bytes before hashing.

    `part` names two kinds of bytes between which, in either order, a word is cut in two.
    """
    n = len(data)
    inside = kind[fold][data]
    edge = np.empty(n + 1, np.int8)
    edge[0], edge[n] = (inside[0] if n else 0), 0
    if n:
        edge[1:n] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
        edge[n] = -np.int8(inside[-1])
    cut = bounds[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[inside[cut] & inside[cut - 1]]
    if part is not None and n:
        one, two = part[0][data], part[1][data]
        cut = np.union1d(cut, np.flatnonzero(one[:-1] & two[1:] | two[:-1] & one[1:]) + 1)
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    up, down = _BYTES.get(n + 1)
    total = _sums(_BYTE[fold][data] * up[:n])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return Words(data, start, end, hashed, np.searchsorted(start, bounds))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; len(hashes) - n + 1 values, none if there are fewer words."""
    if len(hashes) < n:
        return np.empty(0, U64)
    up, down = _GRAMS.get(len(hashes) + 1)
    total = _sums(hashes * up[:-1])
    return mix((total[n:] - total[:-n]) * down[:len(hashes) - n + 1] + U64(n))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of the smallest; the last of equal ones."""
    if len(values) < width:
        return np.empty(0, np.int64)
    n = len(values) - width + 1
    best, at = values[:n].copy(), np.arange(n)
    for k in range(1, width):
        other = values[k:k + n]
        better = other <= best
        np.copyto(best, other, where=better)
        at[better] = np.flatnonzero(better) + k
    return at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows of about `limit` bytes. Nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, to, data[offsets[row]:offsets[to]], offsets[row:to + 1] - offsets[row]
        row = to
