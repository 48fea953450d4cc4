"""Words of whole texts as numpy arrays: maximal runs of bytes other than space and \\x09-\\x0D, each with a 64-bit hash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from serigraph.llm._common import CHUNK_BYTES, mixed

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWERED = _BYTE_VALUE.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the joined texts
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of text i the words are first[i]:first[i + 1]


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _segment(data: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    letters = value[data[inside]] * powers(int(length.max()))[place]
    return start, end, mixed(np.add.reduceat(letters, first) + length.astype(np.uint64))


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Words of the texts, taken together with a space between; long input is cut at white space into bounded steps."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    value = _LOWERED if lower else _BYTE_VALUE
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + 4 * CHUNK_BYTES)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        start, end, h = _segment(data[at:stop], value)
        found.append((start + at, end + at, h))
        at = stop
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    return Words(start, end, h, np.searchsorted(start, bounds))
