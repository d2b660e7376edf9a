"""Minimizers: the least hash of every window of neighbouring hashes."""

from __future__ import annotations

import numpy as np

from quillspan.llm.tokens import U

_PLACE = 28  # bits for a position in one run of rows


def least_in_windows(key: np.ndarray, w: int) -> np.ndarray:
    """min(key[i : i + w]) for each i, by running minima over blocks of w from both sides."""
    n = len(key)
    if n < w:
        return key[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(key.dtype).max, dtype=key.dtype)
    blocks[:n] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def minimizers(hashes: np.ndarray, before: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash (the first of equal ones) of some window of w in one row.

    A row of fewer than w hashes is one window. What is chosen in a window depends on nothing outside it.
    """
    place = U((1 << _PLACE) - 1)
    key = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    least = least_in_windows(key, w)
    inside = np.ones(len(least), dtype=bool)
    per = np.diff(before)
    for edge in before[1:-1]:
        inside[max(0, edge - w + 1) : edge] = False
    chosen = [least[inside] & place]
    short = np.flatnonzero((per > 0) & (per < w))
    if len(short):
        chosen.append(np.array([key[before[r] : before[r + 1]].min() & place for r in short], dtype=np.uint64))
    return np.unique(np.concatenate(chosen)).astype(np.int64)
