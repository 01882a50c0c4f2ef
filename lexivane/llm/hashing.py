"""Words and word n-grams of Arrow text columns as 64-bit hashes, in numpy.

A word is a run of bytes other than the six ASCII blanks, or than those marked in
``blank``; A-Z count as a-z. Texts
are worked in pieces of about ``PIECE`` bytes that end at a blank, so memory follows
the piece, not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# for ``blank=``: punctuation separates words too
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a uint64 over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        step = np.full(max(n, PIECE + 4096), _BASE, np.uint64)
        step[0] = 1
        back = np.full(len(step), pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _POWERS[:] = [np.multiply.accumulate(step), np.multiply.accumulate(back)]
    return _POWERS[0], _POWERS[1]


def _piece_words(b: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = ~blank[b]
    edge = np.flatnonzero(np.diff(full, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    power, back = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * power[: len(b)], out=sums[1:])
    h = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
    return mix(h), start, end


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the texts; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_words(data: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word of one text."""
    if len(data) <= PIECE:
        return _piece_words(data, blank)
    parts, low = [], 0
    while low < len(data):
        high = min(low + PIECE, len(data))
        while high < len(data) and not blank[data[high]]:
            gap = np.flatnonzero(blank[data[high : high + 4096]])
            high += int(gap[0]) if len(gap) else 4096
        high = min(high, len(data))
        h, s, e = _piece_words(data[low:high], blank)
        parts.append((h, s + low, e + low))
        low = high
    return tuple(np.concatenate(x) for x in zip(*parts))


def batch_words(column, blank: np.ndarray = _BLANK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text in turn: (bytes, word hashes, word starts, word ends).

    Short texts are hashed together, joined by a blank.
    """
    data, at = text_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if j == i + 1:
            own = data[at[i] : at[j]]
            yield (own, *text_words(own, blank))
        else:
            lengths = np.diff(at[i : j + 1])
            first = at[i:j] - at[i] + np.arange(j - i)
            joined = np.full(int(at[j] - at[i]) + j - i, 32, np.uint8)
            shift = np.repeat(np.arange(j - i), lengths)
            joined[np.arange(at[j] - at[i]) + shift] = data[at[i] : at[j]]
            h, s, e = _piece_words(joined, blank)
            cut = np.searchsorted(s, np.append(first, len(joined)))
            for k in range(j - i):
                own = slice(cut[k], cut[k + 1])
                yield data[at[i + k] : at[i + k + 1]], h[own], s[own] - first[k], e[own] - first[k]
        i = j


_ROLES = np.array([0xD6E8FEB86659FD93, 0xCA01F9DD51B3A2E5, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a text, as non-negative int64; a text with
    fewer words is one window, a text without words none."""
    if not len(h):
        return np.zeros(0, np.int64)
    m = min(n, len(h))
    total = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        total += mix(h[k : len(h) - m + 1 + k] * _ROLES[k % 5] + np.uint64(k // 5))
    return (mix(total) >> np.uint64(1)).astype(np.int64)
