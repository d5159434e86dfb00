"""Distinct word shingles of whole texts as 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """``_BASE`` to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in one array, and where each begins (one more at the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(offsets) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered; words are runs of bytes other than space and 0x09-0x0D), and each text's first word."""
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), first
    within = np.arange(len(raw))
    within -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    # A separator adds nothing, whatever its power.
    value = _LOWER[raw] * powers(int(within.max()) + 1)[within]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), first


def text_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, flat, and where each text's begin (one more at the end).

    A text of fewer than ``width`` words, but one at least, has one shingle: all its words.
    """
    words, first = word_hashes(*flat_bytes(texts))
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, np.uint64(width))
    for i in range(width):
        rolled = mix(rolled + words[i : i + n])
    sets: list[np.ndarray] = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = mix(short + words[i])
            sets.append(short)
        else:
            sets.append(words[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([*sets, words[:0]]), bounds
