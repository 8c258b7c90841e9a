"""Burrows-Wheeler transforms of collections of strings, and their merge by refinement of an interleave.

A string is a run of integer symbols that ends with END. Two transforms are merged without looking at the strings again: an interleave that is right for the first k
symbols of all suffixes gives, by one stable pass over the interleaved transforms, the one that is right for k + 1. Blocks of suffixes that share their first k
symbols are split along the way, so the common prefixes come with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = np.int64(np.iinfo(np.int64).min)


@dataclass
class Transform:
    """bwt: the symbol before each suffix, in the suffixes' order; END before a string's first. place: what the caller calls each suffix. strings: how many."""

    bwt: np.ndarray
    place: np.ndarray
    strings: int


def transform(symbols: np.ndarray, place: np.ndarray, depth: int) -> Transform:
    """The transform of strings that are laid end to end, each with its END; suffixes are ordered by their first depth symbols, then by place in the input."""
    n = len(symbols)
    if not n:
        return Transform(symbols, place, 0)
    _, rank = np.unique(symbols, return_inverse=True)
    ends = symbols == END
    order = np.argsort(rank, kind="stable")
    known = 1
    while known < depth:
        # a suffix shorter than known ends with END, so what follows it must not count
        follow = np.full(n, -1, np.int64)
        next_end = np.flatnonzero(ends)[np.cumsum(ends) - ends]
        inside = np.flatnonzero(np.arange(n) + known <= next_end)
        follow[inside] = rank[inside + known]
        order = np.lexsort((follow, rank))
        new = np.append(True, (rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        known *= 2
    before = np.full(n, END)
    before[1:] = np.where(ends[:-1], END, symbols[:-1])
    return Transform(before[order], place[order], int(ends.sum()))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The transform of both collections, suffixes ordered by their first depth symbols, and the number of each suffix's block of equal ones."""
    n = len(a.bwt) + len(b.bwt)
    side = np.zeros(n, bool)
    side[len(a.bwt) :] = True
    block = np.zeros(n, np.int64)
    symbols = np.empty(n, np.int64)
    strings = a.strings + b.strings
    for _ in range(depth):
        symbols[~side], symbols[side] = a.bwt, b.bwt
        order = np.argsort(symbols, kind="stable")
        fresh, source = symbols[order], block[order]
        side = side[order]
        side[:strings] = np.arange(strings) >= a.strings  # END sorts first: the suffixes that are only END, by collection
        split = np.ones(n, bool)
        split[1:] = (fresh[1:] != fresh[:-1]) | (source[1:] != source[:-1])
        split[1:strings] = False
        block = np.cumsum(split) - 1
    place = np.empty(n, a.place.dtype)
    place[~side], place[side] = a.place, b.place
    symbols[~side], symbols[side] = a.bwt, b.bwt
    return Transform(symbols, place, strings), block


def merge_all(parts: list[Transform], depth: int) -> tuple[Transform, np.ndarray]:
    """All transforms merged in pairs of like size."""
    if len(parts) == 1:
        parts = [parts[0], Transform(parts[0].bwt[:0], parts[0].place[:0], 0)]
    while True:
        merged = [merge(parts[i], parts[i + 1], depth) for i in range(0, len(parts) - 1, 2)]
        if len(parts) == 2:
            return merged[0]
        parts = [m for m, _ in merged] + parts[len(parts) // 2 * 2 :]
