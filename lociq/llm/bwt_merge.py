"""Repeated intervals from merged shard Burrows-Wheeler transforms, in arrays.

Each shard is sorted once and keeps its transform (the symbol before each suffix) and its LF mapping (the row of the
suffix that is one longer). The shards' suffixes are interleaved by refinement: in round h they stand in the order of
their first h symbols; each row steps along its own shard's LF mapping and all are dealt stably by the symbol passed,
which gives the order of the first h + 1. A border between two neighbours that first appears in round h tells that
their common prefix is h symbols long, so the runs without a border after ``length`` rounds are the intervals of
suffixes with a common prefix of at least ``length``. No suffix is compared again after its shard was sorted.

Runs of a single suffix are settled: no longer prefix can join them to another, nor can any longer suffix that passes
through them; they leave the interleave. Up to MOST symbols are passed in a round, as long as those that occur together
can be numbered in 16 bits, which sort by counting.
"""

from __future__ import annotations

import numpy as np

SHARD = 1 << 15
MOST, NARROW = 8, (1 << 16) - 1


def shard_bwt(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols (0 ends a text) -> suffix array, transform, LF mapping. Sorted by prefix doubling, to ``depth``; suffixes
    that are alone in their rank aren't sorted again."""
    n = len(symbols)
    key = symbols.astype(np.int64)
    padded = np.concatenate((key, np.zeros(7, np.int64)))
    for j in range(1, 7):
        key = key << 9 | padded[j : j + n]
    known, open_ = 7, np.arange(n)  # places in the order whose rank isn't theirs alone
    order, rank = np.arange(n), np.zeros(n, np.int64)
    while len(open_):
        by = np.argsort(key, kind="stable")
        at = order[open_][by]
        order[open_] = at
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        if known >= depth:
            break
        tied = ~(new & np.append(new[1:], True))
        open_, at = open_[tied], at[tied]
        behind = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + behind
        known *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    bwt = np.where(order > 0, symbols[order - 1], 0).astype(np.uint16)
    return order, bwt, np.where(order > 0, place[order - 1], 0)


def repeated_starts(texts: list[bytes], length: int, shard: int = SHARD) -> np.ndarray:
    """Positions, in the texts laid end to end with one mark after each, where a string of ``length`` bytes starts
    that starts elsewhere too; sorted. Texts are dealt to shards in turn, so that neighbours, which are alike, meet in
    the merge and not in a shard's sort."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    count = int(-(-begins[-1] // shard)) if texts else 0
    shards, placed = [], 0
    for k in range(count):
        own = range(k, len(texts), count)
        marked = np.zeros(sum(len(texts[i]) + 1 for i in own), np.uint16)
        where = np.empty(len(marked), np.int64)
        at = 0
        for i in own:
            n = len(texts[i])
            marked[at : at + n] = np.frombuffer(texts[i], np.uint8)
            marked[at : at + n] += 1
            where[at : at + n + 1] = np.arange(begins[i], begins[i] + n + 1)
            at += n + 1
        if at:
            order, bwt, lf = shard_bwt(marked, length)
            shards.append((where[order], bwt, placed + lf))
            placed += at
    if not shards:
        return np.zeros(0, np.int64)
    suffix = np.concatenate([s for s, _, _ in shards])
    symbol = np.concatenate([b for _, b, _ in shards])
    step = np.concatenate([lf for _, _, lf in shards]).astype(np.int32)
    strides = [(1, symbol, step)]
    while 2 * strides[-1][0] <= min(MOST, length):
        k, symbol, step = strides[-1]
        joined, distinct = _joined(symbol, step)
        if distinct > NARROW:
            break
        strides.append((2 * k, joined, step[step]))
    row, run = np.arange(len(suffix), dtype=np.int32), np.zeros(len(suffix), np.int32)
    passed = 0
    while passed < length and len(row):
        k, symbols, step = next(x for x in reversed(strides) if x[0] <= length - passed)
        symbol = symbols[row]
        going = symbol != 0
        if not going.all():
            row, run, symbol = row[going], run[going], symbol[going]
        order = np.argsort(symbol, kind="stable")
        symbol, run, row = symbol[order], run[order], step[row[order]]
        passed += k
        border = np.ones(len(row) + 1, bool)
        if len(row):
            border[1:-1] = (symbol[1:] != symbol[:-1]) | (run[1:] != run[:-1])
        joined = ~(border[1:] & border[:-1])
        run = np.cumsum(border[:-1], dtype=np.int32)
        if 8 * np.count_nonzero(joined) < 7 * len(row) or passed >= length:
            row, run = row[joined], run[joined]
    return np.sort(suffix[row])


def _joined(symbol: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for the two symbols that are passed one after the other, 0 where a text's start is met, and how many
    numbers there are."""
    second = symbol[step]
    code = symbol.astype(np.int64) << 32 | second
    code[(symbol == 0) | (second == 0)] = 0
    found, number = np.unique(code, return_inverse=True)
    number += found[0] != 0
    return number.astype(np.uint16 if len(found) <= NARROW else np.uint32), len(found)


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Sorted starts of strings of ``length`` -> (n, 2) maximal covered [begin, end); strings that touch are joined."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate(([True], np.diff(starts) > length))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return np.stack((starts[first], starts[last] + length), axis=1)
