"""Vectorised word splitting and hashing over batches of texts.

Words are runs of letters and digits after full case folding.  A batch of texts
becomes one code point array, word limits come from a class table, and word
hashes are polynomial sums over random code point values: no regular expression
and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Characters handled at a time; bounds the kernel's memory.
CHUNK_CHARS = 1 << 20

_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads all bits."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """The first n values of a splitmix64 stream."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
        return mix64(steps + _U64(seed))


class _Tables:
    """Per process: code point classes and random values, powers grown on demand."""

    def __init__(self) -> None:
        self._alnum: np.ndarray | None = None
        self._chars: dict[int, np.ndarray] = {}
        self._powers: dict[int, np.ndarray] = {}

    def alnum(self) -> np.ndarray:
        if self._alnum is None:
            self._alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        return self._alnum

    def chars(self, lane: int) -> np.ndarray:
        if lane not in self._chars:
            self._chars[lane] = seeded(0x51ED270B + lane, 0x110000)
        return self._chars[lane]

    def powers(self, lane: int, n: int) -> np.ndarray:
        """Powers 0..n-1 of an odd multiplier."""
        have = self._powers.get(lane)
        if have is None or len(have) < n:
            base = seeded(0xA5A5F00D + lane, 1)[0] | _U64(1)
            grown = np.full(max(n, 1024), base, _U64)
            grown[0] = 1
            with np.errstate(over="ignore"):
                have = self._powers[lane] = np.multiply.accumulate(grown)
        return have


TABLES = _Tables()


@dataclass
class Words:
    """Words of a run of texts; all arrays are in text order."""

    first: int  #: index of the run's first text in the whole batch
    n_texts: int
    codes: np.ndarray  #: folded code points of all texts, each text followed by a line feed
    text_start: np.ndarray  #: n_texts + 1 offsets into codes
    start: np.ndarray  #: word limits in codes
    end: np.ndarray
    word_from: np.ndarray  #: n_texts + 1 offsets into the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_from)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash per word; other lanes give independent hashes."""
        if not len(self.start):
            return np.empty(0, _U64)
        length = self.end - self.start
        offset = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(offset[-1]) - np.repeat(offset[:-1], length)
        at = place + np.repeat(self.start, length)
        with np.errstate(over="ignore"):
            each = TABLES.chars(lane)[self.codes[at]] * TABLES.powers(lane, int(length.max()))[place]
            return mix64(np.add.reduceat(each, offset[:-1]) + length.astype(_U64))

    def sequence_hashes(self, hashed: np.ndarray, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each text's word sequence; 0 for a text without words."""
        return sequence_hash(hashed, self.word_from, lane)


def sequence_hash(hashed: np.ndarray, limits: np.ndarray, lane: int = 0) -> np.ndarray:
    """Order-sensitive hash of each slice limits[i]:limits[i+1]; 0 for an empty one."""
    counts = np.diff(limits)
    out = np.zeros(len(counts), _U64)
    some = counts > 0
    if not some.any():
        return out
    place = np.arange(limits[0], limits[-1]) - np.repeat(limits[:-1], counts)
    with np.errstate(over="ignore"):
        each = mix64(hashed[limits[0] : limits[-1]] ^ _U64(lane + 1)) * TABLES.powers(100 + lane, int(counts.max()))[place]
        out[some] = mix64(np.add.reduceat(each, (limits[:-1] - limits[0])[some]) + counts[some].astype(_U64))
    return out


def split_words(texts: list[str | None]) -> Iterator[Words]:
    """Words of the texts, run by run; null and empty texts have none."""
    folded = [t.casefold() if t else "" for t in texts]
    lens = np.fromiter(map(len, folded), np.int64, len(folded))
    total = np.concatenate(([0], np.cumsum(lens + 1)))
    at = 0
    while at < len(folded):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_CHARS, "right")) - 1)
        codes = np.frombuffer(("\n".join(folded[at:to]) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = TABLES.alnum()[codes]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text_start = total[at : to + 1] - total[at]
        yield Words(at, to - at, codes, text_start, start, end, np.searchsorted(start, text_start))
        at = to


def occurrence_numbers(doc: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """For each word its running number among equal words of the same text, from 0.

    Equal words of a text are numbered in text order, so that a bag of words
    becomes a set of (word, number).
    """
    if not len(hashed):
        return np.empty(0, np.int64)
    order = np.lexsort((hashed, doc))
    d, h = doc[order], hashed[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(fresh)
    number = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out
