"""Hashed n-grams of whole texts, of bytes or of characters, with numpy."""

from __future__ import annotations

import numpy as np

#: Buckets of the hashed features.
BITS = 18
ORDERS = (3, 4, 5)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)
#: Bytes that are hashed at a time; windows that cross a seam belong to the piece they begin in.
_PIECE = 1 << 20


def buckets(text: str | None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """The distinct buckets, in order, of a text's byte n-grams (ASCII letters lower-cased, a space at each end)."""
    data = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    seen = np.zeros(1 << bits, bool)
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE + max(orders) - 1].astype(np.uint64)
        rolled = np.zeros(len(part), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(part) < n:
                break
            rolled = rolled[: len(part) - n + 1] * _STEP + part[n - 1 :] + np.uint64(1)
            if n in orders:
                seen[((rolled + np.uint64(n << 40)) * _MULTIPLIER) >> np.uint64(64 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


#: Orders and buckets of character n-grams inside words.
WORD_ORDERS, WORD_BITS = (4, 6, 8), 20
#: Which of the first characters end a word: controls, blanks and marks of ASCII, but not the marks that stand for letters.
_ENDS = np.array([chr(c) in " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>/\\|-_+=~`" or c < 32 for c in range(128)])


def word_grams(text: str | None, orders: tuple[int, ...] = WORD_ORDERS, bits: int = WORD_BITS) -> np.ndarray:
    """The distinct buckets, in order, of a text's lower-cased character n-grams that lie in a word, its two ends included."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    found = []
    for at in range(0, len(data), _PIECE):
        part = data[at : at + _PIECE + max(orders) - 1]
        ends = _ENDS[np.minimum(part, 127)] & (part < 128)
        part = np.where(ends, np.uint32(32), part).astype(np.uint64)
        before = np.concatenate([[0], np.cumsum(ends)])  # ends in front of each place
        rolled = np.zeros(len(part), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(part) < n:
                break
            rolled = rolled[: len(part) - n + 1] * _STEP + part[n - 1 :] + np.uint64(1)
            if n in orders:
                inner = before[n - 1 : len(part)] == before[1 : len(part) - n + 2]
                found.append((rolled[inner] + np.uint64(n << 40)) * _MULTIPLIER >> np.uint64(64 - bits))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32)
