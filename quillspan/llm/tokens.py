"""Words and hashes of whole batches of texts at once, over Arrow buffers.

A word is a run of ASCII letters and digits and of bytes of other scripts; Unicode spaces, dashes
and quotation marks separate words. Hashes are of content only, so they agree between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ROOT = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNROOT = U(pow(int(_ROOT), -1, 1 << 64))

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SOLID = np.ones(256, dtype=bool)
_SOLID[[32, *range(9, 14)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's root and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, root in (("up", _ROOT), ("down", _UNROOT)):
            p = np.full(size, root, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, bytes, offsets) for runs of rows of about ``most`` bytes; one row at least."""
    if len(column) == 0:
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Hashes:
    """Hashes of any ranges of one run of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that don't cross rows, and how many are before each row."""
    n = len(inside)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each row and after the last."""
    inside = _WORD[data]
    if len(data) > 2:
        for lead, width, low, high in ((0xC2, 2, 0x80, 0xBF), (0xE2, 3, 0x80, 0x81)):
            at = np.flatnonzero(data[: len(data) - width + 1] == lead)
            at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
            for k in range(width):
                inside[at + k] = False
    return _spans(inside, offsets)


def solid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, of what stands between ASCII white space, with case and marks."""
    return _spans(_SOLID[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words before each row and after the last."""
    starts, ends, first = words(data, offsets)
    return Hashes(data).of(starts, ends), first


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of n words in a row, one for the whole of a row of 1 to n-1 words; counts as above."""
    rows = len(first) - 1
    per = np.diff(first)
    weights = mix(np.arange(11, 11 + n, dtype=np.uint64)) | U(1)
    count = np.where(per >= n, per - n + 1, (per > 0).astype(np.int64))
    before = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(count, out=before[1:])
    out = np.zeros(before[-1], dtype=np.uint64)
    row = np.repeat(np.arange(rows), count)
    at = first[row] + np.arange(before[-1]) - before[row]
    last = first[row + 1] - 1
    for k in range(n):
        there = at + k <= last
        out[there] += hashes[(at + k)[there]] * weights[k]
    return mix(out), before
