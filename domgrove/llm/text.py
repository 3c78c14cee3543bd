"""Words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from domgrove.llm.common import mix

U = np.uint64


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, value in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, value, U)
                row[0] = 1
                setattr(self, name, np.cumprod(row))
        return self.up, self.down


POWERS = [Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95), Powers(0xC6BC279692B5CC83)]


def prefix(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values times powers, for range_hash."""
    up, down = POWERS[which].get(len(values) + 1)
    sums = np.empty(len(values) + 1, U)
    sums[0] = 0
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return sums, down


def range_hash(summed: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the elements of each range that depends on nothing else."""
    sums, down = summed
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


class Block:
    """Some texts one after the other: where words begin and end, their hashes, whose they are.

    `first[d]` is the number of words before text d (so it has one element more than texts), and
    `doc[i]` is the text of word i. Words are runs of bytes other than space and 9 to 13.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join(texts)
        if lower:
            raw = raw.translate(_LOWER)
        self.raw = raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.r_[0, np.cumsum(sizes[:-1] + 1)] if len(texts) else np.zeros(0, np.int64)
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        steps = np.diff(inside)
        self.starts = np.flatnonzero(steps == 1)
        self.ends = np.flatnonzero(steps == -1)
        self.first = np.r_[np.searchsorted(self.starts, self.begins), len(self.starts)]
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.data = data

    def hashes(self) -> np.ndarray:
        return range_hash(prefix(self.data.astype(U) + U(1), 0), self.starts, self.ends)

    def windows(self, n: int) -> np.ndarray:
        """Starts (word numbers) of all windows of n words that lie in one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:len(self.doc) - n + 1] == self.doc[n - 1:])


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def in_blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some `size` bytes together; a longer text is a range of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """For each n consecutive values the place of the least one, the last of several."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least = values[:m].copy()
    place = np.zeros(m, np.int32)
    for j in range(1, n):
        other = values[j:j + m]
        take = other <= least
        np.copyto(least, other, where=take)
        place[take] = j
    return place + np.arange(m)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a range of the given length that begins at one of the starts."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0
