"""Hashed n-grams of whole texts: of bytes, of characters, and of how lately a word occurred."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(symbols: np.ndarray, orders: tuple[int, ...], bits: int, stream: int = 0) -> np.ndarray:
    """The bucket of each n-gram of the symbols (below 2 ** 32), of all the orders, repeats included. Streams don't share
    their n-grams."""
    out = []
    x = symbols.astype(np.uint64) + np.uint64(1)
    code = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, max(orders) + 1):
        if n > len(x):
            break
        code = (code[: len(x) - n + 1] ^ x[n - 1 :]) * MIX
        code ^= code >> np.uint64(29)
        if n in orders:
            out.append(((code + np.uint64(64 * stream + n)) * MIX >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def recency(text: str) -> np.ndarray:
    """Of each word, how lately it occurred: 1 in the word before, 2 in that before it, 3 within eight words, 4 earlier,
    0 never."""
    last: dict[str, int] = {}
    out = []
    for i, word in enumerate(text.split()):
        gap = i - last.get(word, i)
        last[word] = i
        out.append(gap if gap < 3 else 3 if gap <= 8 else 4)
    return np.array(out, np.uint8)


def present(buckets: np.ndarray, bits: int) -> np.ndarray:
    """The buckets that occur, in order."""
    seen = np.zeros(1 << bits, bool)
    seen[buckets] = True
    return np.flatnonzero(seen)


def counted(buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and how often."""
    n = np.bincount(buckets, minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]
