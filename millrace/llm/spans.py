"""Hashes of many byte spans at once, and the words of texts as spans."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

WINDOW = 1 << 20
LONG_SPAN = 1 << 16

# Odd multipliers modulo 2**64 and the finalizer of a public 64-bit mixer.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
STEP = 0xC2B2AE3D27D4EB4F


def mixed(h: np.ndarray) -> np.ndarray:
    """The values with all bits spread; equal for equal values, one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    h ^= h >> np.uint64(33)
    return h


@lru_cache(maxsize=4)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one window."""
    up = np.full(WINDOW + LONG_SPAN, base, np.uint64)
    down = np.full(len(up), pow(base, -1, 1 << 64), np.uint64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.

    Work proceeds in windows, so that memory does not follow the buffer; longer spans than a
    window's reserve are hashed one by one.
    """
    up, down = _powers(BASES[which])
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        if ends[at] - starts[at] > LONG_SPAN:
            long = blake2b(buf[starts[at] : ends[at]].tobytes(), digest_size=8, key=bytes([which + 1]))
            out[at] = int.from_bytes(long.digest(), "little")
            at += 1
            continue
        low = starts[at]
        to = int(np.searchsorted(starts, low + WINDOW))
        too_long = np.flatnonzero(ends[at:to] - starts[at:to] > LONG_SPAN)
        to = at + int(too_long[0]) if len(too_long) else to
        s, e = starts[at:to] - low, ends[at:to] - low
        part = buf[low : low + e[-1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        h = (sums[e] - sums[s]) * down[s]
        out[at:to] = mixed(h + (e - s).astype(np.uint64) * np.uint64(STEP))
        at = to
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` values, mixed; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= np.uint64(STEP)
        total += h[j : j + n]
    return mixed(total)


class Words:
    """The words of several texts: a hash each, their spans, and which text they are of.

    ``table`` gives for each byte its folded value and whether it belongs to words; a zero byte may.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray) -> None:
        folded, in_word = table
        gap = np.flatnonzero(in_word == 0)[0]
        raw = np.frombuffer(bytes([gap]).join([*texts, b""]), np.uint8)
        self.bytes = folded[raw]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = np.diff(np.concatenate(([0], in_word[raw], [0])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))
        self.first, self.counts = first[:-1], np.diff(first)
        self.hashes = span_hashes(self.bytes, self.starts, self.ends)

    @property
    def ends_of_texts(self) -> np.ndarray:
        """For each word, the number of the first word after its text."""
        return np.repeat(self.first + self.counts, self.counts)

    def joined(self, at: int, n: int) -> bytes:
        """``n`` folded words from word ``at`` on, with one space between."""
        span = slice(at, at + n)
        pairs = zip(self.starts[span].tolist(), self.ends[span].tolist())
        return b" ".join([self.bytes[s:e].tobytes() for s, e in pairs])


def fold_table(is_word) -> np.ndarray:
    """A table for ``Words``: bytes with A-Z in lower case, and 1 for those that ``is_word`` takes."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([lower, [bool(is_word(b)) for b in lower]], np.uint8)
