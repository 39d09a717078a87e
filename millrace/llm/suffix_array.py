"""Suffix arrays of byte strings by induced sorting, in array operations.

Suffixes are classified as smaller or larger than their successors.  The leftmost smaller ones
cut the text into substrings; their names, refined until they order whole spans, order those
suffixes.  All others are induced from them in one pass up and one pass down the byte values:
a bucket's entries, taken together, put their predecessors into later buckets.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 7  # of nine bits, in a 64-bit key


def smaller_than_next(x: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next; the last is not."""
    step = np.sign(np.diff(x.astype(np.int16)))
    at = np.append(np.flatnonzero(step), len(x) - 1)
    rises = np.append(step[at[:-1]] > 0, False)
    return np.repeat(rises, np.diff(at, prepend=-1))


def _ranks(key: np.ndarray) -> np.ndarray:
    """For each value how many are smaller."""
    order = np.argsort(key)
    return _places(key[order])[_inverse(order)]


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _places(ordered: np.ndarray) -> np.ndarray:
    """For each of the sorted values the place of the first that is equal."""
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.empty(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _refined(rank: np.ndarray, which: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``rank`` with its ties among ``which`` ordered by ``key``, below 2**32, further.

    ``which`` holds all of a tie or none of it; a rank counts the smaller ones, so those that
    are told apart need no other's rank to change.
    """
    both = (rank[which].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
    order = np.argsort(both)
    ordered = both[order]
    out = rank.copy()
    out[which[order]] = rank[which[order]] + _places(ordered) - _places(ordered >> np.uint64(32))
    return out


def _ties(rank: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those of ``which`` whose rank another one has as well."""
    return which[np.bincount(rank[which], minlength=len(rank))[rank[which]] > 1]


def _names(x: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost smaller suffixes, both ends included.

    Among equal bytes a larger suffix comes before a smaller one, so the kind is part of a symbol.
    """
    padded = np.zeros(len(x) + SYMBOLS + 1, np.uint64)
    padded[: len(x)] = (x.astype(np.uint64) << np.uint64(1)) | smaller
    padded[: len(x)] += np.uint64(1)
    ends = np.append(lms[1:], len(x) - 1) + 1
    rank, offset, open_ = np.zeros(len(lms), np.int64), 0, np.arange(len(lms))
    while len(open_):
        at, end = lms[open_] + offset, ends[open_]
        key = np.zeros(len(open_), np.uint64)
        for j in range(SYMBOLS):
            key = (key << np.uint64(9)) | np.where(at + j < end, padded[np.minimum(at + j, len(x))], 0).astype(np.uint64)
        if offset == 0:
            rank = _ranks(key)
        else:
            full = np.zeros(len(lms), np.int64)
            full[open_] = _ranks(key) + 1
            rank = _refined(rank, np.arange(len(lms)), full)
        offset += SYMBOLS
        open_ = open_[at + SYMBOLS < end]
    return rank


def sorted_lms(x: np.ndarray, smaller: np.ndarray, span: int) -> np.ndarray:
    """The leftmost smaller suffixes in the order of at least their first ``span`` bytes."""
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return lms
    rank, width = _names(x, smaller, lms), 1
    # A name stands for two bytes at least, so so many names in a row cover the span.
    tied = _ties(rank, np.arange(len(rank)))
    while width * 2 <= span + 2 and len(tied):
        after = np.concatenate((rank, np.full(width, -1)))[tied + width] + 1
        rank, width = _refined(rank, tied, after), width * 2
        tied = _ties(rank, tied)
    return lms[np.argsort(rank, kind="stable")]


def _groups(values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by byte, and for each byte that occurs its range in that order."""
    order = np.argsort(values, kind="stable")
    counts = np.bincount(values, minlength=256)
    ends = np.cumsum(counts)
    return order, [(c, int(ends[c] - counts[c]), int(ends[c])) for c in np.flatnonzero(counts).tolist()]


def _induce(x: np.ndarray, wanted: np.ndarray, first: list[list[np.ndarray]], seeds: list[np.ndarray], up: bool) -> list[np.ndarray]:
    """For each byte its suffixes of the wanted kind, in the order in which they are met.

    ``first``: what each bucket begins with; ``seeds``: entries of the other kind, which are
    passed after those of the wanted kind.
    """
    out = []
    for c in range(256) if up else range(255, -1, -1):
        found = list(first[c])
        new = np.concatenate(found) if found else np.empty(0, np.int64)
        found = [new]
        while len(new):  # runs of one byte
            before = new[new > 0] - 1
            new = before[wanted[before] & (x[before] == c)]
            found.append(new)
        own = np.concatenate(found)
        out.append(own)
        both = np.concatenate((own, seeds[c]))
        before = both[both > 0] - 1
        before = before[wanted[before]]
        values = x[before]
        onward = values > c if up else values < c
        before, values = before[onward], values[onward]
        if len(before):
            order, groups = _groups(values)
            before = before[order]
            for byte, a, b in groups:
                first[byte].append(before[a:b])
    return out if up else out[::-1]


def suffix_array(x: np.ndarray, span: int) -> np.ndarray:
    """The suffixes of ``x`` (bytes) in the order of at least their first ``span`` bytes."""
    if not len(x):
        return np.empty(0, np.int64)
    smaller = smaller_than_next(x)
    lms = sorted_lms(x, smaller, span)
    order, groups = _groups(x[lms])
    seeds = [np.empty(0, np.int64) for _ in range(256)]
    for byte, a, b in groups:
        seeds[byte] = lms[order[a:b]]
    first: list[list[np.ndarray]] = [[] for _ in range(256)]
    first[int(x[-1])].append(np.array([len(x) - 1]))  # induced by the empty suffix
    larger = _induce(x, ~smaller, first, seeds, up=True)
    down = _induce(x, smaller, [[] for _ in range(256)], [a[::-1] for a in larger], up=False)
    return np.concatenate([part for c in range(256) for part in (larger[c], down[c][::-1])])


def long_common_prefixes(x: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
    """For each place of the text whether its suffix shares ``span`` bytes with the one before it
    in ``order``.

    The common prefixes are permuted to text order, so one side is read in sequence; eight bytes
    are compared at a time, and only suffixes still equal go on.
    """
    before = np.full(len(x), -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((x, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(x), 8), (1, 1))
    words = np.ndarray(len(x), "<u8", padded, strides=(1,))
    alive = np.flatnonzero((before >= 0) & (np.arange(len(x)) + span <= len(x)) & (before + span <= len(x)))
    for offset in [*range(0, span - 8, 8), max(span - 8, 0)]:
        alive = alive[words[alive + offset] == words[before[alive] + offset]]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out
