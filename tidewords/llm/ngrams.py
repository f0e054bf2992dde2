"""Hashed n-gram histograms of many texts at once."""

from __future__ import annotations

import numpy as np

from tidewords.llm.common import slices

_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_CELLS = 1 << 20


def histograms(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, bins: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Share of each hashed n-gram of mapped bytes among the n-grams of its text, a row a text (float32).

    ``table`` maps bytes. A text is followed by two blanks, so that its last bytes end n-grams too; no n-gram
    spans two texts. An empty text has a row of zeros. bins is a power of two.
    """
    out = np.zeros((len(offsets) - 1, bins), np.float32)
    shift = np.uint32(32 - int(bins).bit_length() + 1)
    for a, b in slices(offsets, _CELLS, max(1, _CELLS // bins)):
        lens = np.diff(offsets[a : b + 1])
        n = b - a
        doc = np.repeat(np.tile(np.array([0, n]), n) + np.where(np.arange(2 * n) % 2, 0, np.arange(2 * n) // 2), np.column_stack((lens, np.full(n, 2))).ravel()).astype(np.int64)
        code = np.full(len(doc) + 4, table[32], np.uint32)
        code[: len(doc)][doc < n] = table[raw[offsets[a] : offsets[b]]]
        counts = np.zeros((n + 1) * bins, np.int64)
        for size in sizes:
            h = np.full(len(doc), size * 0x01000193, np.uint32)
            for k in range(size):
                h = (h ^ code[k : k + len(doc)]) * _PRIMES[k]
            counts += np.bincount(doc * bins + (h >> shift), minlength=(n + 1) * bins)
        rows = counts[: n * bins].reshape(n, bins)
        out[a:b] = rows / np.maximum(1, lens * len(sizes))[:, None]
    return out
