"""Token ids of whole texts from a public vocabulary file.

Every id comes from the ``tokenizers`` library.  A text is first split at the added tokens of
the file, whose ids stand for them, as the library does.  What lies between is cut before spaces
that follow a character other than white space; the vocabulary's splitting pattern never joins
such a character to a space, so the ids of the parts are the ids of the text.  A worker keeps the
ids of parts it has met, since words repeat; parts are told apart by 128 bits of hash.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from millrace.llm.spans import span_hashes

VOCABULARY = "byte_bpe_50k.json"
KEPT_PARTS = 1_000_000
LONG_PART = 256

WHITE, HIGH, OTHER, MARK, WORD = range(5)
KINDS = np.array(
    [
        WHITE if b <= 32 else HIGH if b >= 128 else WORD if chr(b).isalnum() else OTHER if b in (39, 127) else MARK
        for b in range(256)
    ],
    np.uint8,
)


def part_starts(buf: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their ids, in order.

    Before white space that follows another character; before ASCII punctuation, apostrophes
    aside, that follows an ASCII letter or digit; and after a line break that stands alone.
    Beyond ASCII, whole families around the white characters are left uncut.
    """
    kind = KINDS[buf]
    last = kind[:-1]
    fine = last > WHITE
    high = np.flatnonzero(last == HIGH)
    b, b2, b3 = buf[high], buf[np.maximum(high - 1, 0)], buf[np.maximum(high - 2, 0)]
    white = (b2 == 0xC2) & ((b == 0x85) | (b == 0xA0))
    white |= ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE1) & (b2 == 0x9A))
    white |= (b3 == 0xE3) & (b2 == 0x80)
    fine[high[white]] = False
    cut = np.zeros(len(buf), bool)
    cut[1:] = fine & (kind[1:] == WHITE) | (last == WORD) & (kind[1:] == MARK)
    at = np.flatnonzero(buf == 10)
    at = at[(at > 0) & (at + 1 < len(buf))]
    at = at[cut[at] & ((kind[at + 1] > HIGH) | (buf[at + 1] == 0xC3))]
    cut[at + 1] = True
    return np.flatnonzero(cut)


class PartEncoder:
    """Encodes texts with ``tokenizer``, remembering about ``kept_parts`` parts."""

    def __init__(self, tokenizer, kept_parts: int = KEPT_PARTS) -> None:
        self.tokenizer, self.kept_parts = tokenizer, kept_parts
        self._added_ids = _added_ids(tokenizer)
        longest_first = sorted(self._added_ids, key=len, reverse=True)
        self._added = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")")
        self._keys = np.empty((0, 2), np.uint64)  # sorted by the first hash
        self._at, self._n = np.empty(0, np.int64), np.empty(0, np.int64)
        self._used = np.empty(0, bool)
        self._ids = np.empty(0, np.uint32)

    def _library(self, parts: list[bytes]) -> list[list[int]]:
        texts = [part.decode("utf-8", "replace") for part in parts]
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _shrink(self) -> None:
        """Keep the parts used more than once, or nothing if those are too many as well."""
        keep = np.flatnonzero(self._used)
        keep = keep if len(keep) <= self.kept_parts // 2 else keep[:0]
        n = self._n[keep]
        self._ids = self._ids[_ragged(self._at[keep], n)]
        self._keys, self._n = self._keys[keep], n
        self._at = np.cumsum(n) - n
        self._used = np.zeros(len(keep), bool)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys[:, 0], keys[:, 0])
        at[at == len(self._keys)] = 0
        known = (self._keys[at] == keys).all(1) if len(self._keys) else np.zeros(len(keys), bool)
        return np.where(known, at, -1)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8), unsigned 32-bit; an empty text has none."""
        if not self._added_ids:
            return self._between(texts)
        split = [self._added.split(text) for text in texts]  # an added token in every other place
        between = iter(self._between([part for parts in split for part in parts[::2]]))
        out = []
        for parts in split:
            ids = [self._added_ids[part] if i % 2 else next(between) for i, part in enumerate(parts)]
            out.append(np.concatenate(ids) if len(ids) > 1 else ids[0])
        return out

    def _between(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts that hold no added token."""
        if len(self._keys) > self.kept_parts:
            self._shrink()
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        starts = _distinct(np.concatenate((part_starts(buf), begin[sizes > 0])))
        if not len(starts):
            return [np.empty(0, np.uint32) for _ in texts]
        ends = np.append(starts[1:], len(buf))
        keys = np.stack([span_hashes(buf, starts, ends, i) for i in (0, 1)], 1)
        _, one, number = np.unique(keys[:, 0], return_index=True, return_inverse=True)
        twins = (keys[one, 1][number] != keys[:, 1]) | (ends - starts > LONG_PART)
        code = self._look_up(keys[one])
        new = np.flatnonzero((code < 0) & ~twins[one])
        if len(new):
            self._remember(keys[one[new]], self._library(_cut(buf, starts, ends, one[new])))
            code = self._look_up(keys[one])
        again = np.bincount(number, minlength=len(one)) > 1
        again |= ~np.isin(np.arange(len(one)), new)
        self._used[code[again & (code >= 0)]] = True
        code = code[number]
        alone = np.flatnonzero(twins | (code < 0))
        n = np.where(code >= 0, self._n[code], 0)
        own = {}
        if len(alone):  # long parts are not kept
            own = dict(zip(alone.tolist(), self._library(_cut(buf, starts, ends, alone))))
            n[alone] = [len(own[i]) for i in alone.tolist()]
        total = np.concatenate(([0], np.cumsum(n)))
        where = np.where(code >= 0, self._at[code], 0)
        where[alone] = 0
        take = _ragged(where, n)
        ids = self._ids[np.minimum(take, max(0, len(self._ids) - 1))] if len(self._ids) else np.zeros(len(take), np.uint32)
        for i, got in own.items():
            ids[total[i] : total[i + 1]] = got
        first = np.searchsorted(starts, begin)
        return [ids[a:b] for a, b in zip(total[first], total[np.append(first[1:], len(starts))])]

    def _remember(self, keys: np.ndarray, got: list[list[int]]) -> None:
        n = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self._ids) + np.cumsum(n) - n
        self._ids = np.concatenate((self._ids, *[np.array(x, np.uint32) for x in got]))
        place = np.searchsorted(self._keys[:, 0], keys[:, 0])
        self._keys = np.insert(self._keys, place, keys, axis=0)
        self._at, self._n = np.insert(self._at, place, at), np.insert(self._n, place, n)
        self._used = np.insert(self._used, place, False)


def _added_ids(tokenizer) -> dict[bytes, np.ndarray]:
    """The id of each added token, by its bytes; they are found as they are written."""
    found = {}
    for number, token in tokenizer.get_added_tokens_decoder().items():
        folded = token.normalized and tokenizer.normalizer is not None
        if token.single_word or token.lstrip or token.rstrip or folded:
            raise ValueError(f"the added token {token.content!r} does not stand for its own bytes alone")
        found[token.content.encode()] = np.array([number], np.uint32)
    return found


def _ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``at[i] .. at[i] + n[i] - 1``, one after the other."""
    total = np.cumsum(n)
    return np.repeat(at - (total - n), n) + np.arange(total[-1] if len(total) else 0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> list[bytes]:
    return [buf[a:b].tobytes() for a, b in zip(starts[which].tolist(), ends[which].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """One encoder per worker and file; one thread, since Spark runs the tasks side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return PartEncoder(Tokenizer.from_file(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed package keeps the vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
