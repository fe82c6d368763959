"""Distinct word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .bytehash import mix, span_hashes

_WEIGHTS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37)]


def row_shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ordered by row and hash.

    A-Z count as a-z; words are runs of bytes other than blank and 0x09 to 0x0D.  A row with fewer words
    than a shingle has one shingle of all its words, a row without words none.
    """
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | first[1:-1]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = span_hashes(low, starts, stops)
    row = np.searchsorted(at, starts, "right") - 1
    per_row = np.bincount(row, minlength=len(at) - 1)
    base = np.concatenate([[0], np.cumsum(per_row)])
    total = np.full(max(0, len(word) - words + 1), words, np.uint64)
    for k in range(words):
        total += word[k : k + len(total)] * _WEIGHTS[k]
    whole = row[: len(total)] == row[words - 1 :] if len(total) else np.zeros(0, bool)
    rows, hashes = row[: len(total)][whole], mix(total[whole])
    short = np.flatnonzero((per_row > 0) & (per_row < words))
    if len(short):
        few = per_row[short].astype(np.uint64)
        for k in range(words - 1):
            some = per_row[short] > k
            few[some] += word[base[short[some]] + k] * _WEIGHTS[k]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, mix(few)])
    order = np.argsort(hashes)
    kind = np.uint16 if len(at) < 1 << 16 else np.int64
    order = order[np.argsort(rows[order].astype(kind), kind="stable")]
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]
