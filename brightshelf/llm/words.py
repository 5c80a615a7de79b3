"""Words of a block of texts as arrays: offsets and 64-bit hashes, without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_ASCII = bytes(range(0x80))
ALPHANUMERIC = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def member_table(members: bytes, others: bool) -> np.ndarray:
    """256 flags: `members` get `not others`, every other byte gets `others`."""
    out = np.full(256, others)
    out[list(members)] = not others
    return out


NOT_SPACE = member_table(SPACES, True)
LETTER_OR_DIGIT = member_table(bytes(b for b in _ASCII if b not in ALPHANUMERIC), True)


@dataclass
class Words:
    start: np.ndarray  # byte offset in the block
    end: np.ndarray
    first: np.ndarray  # per text: number of its first word; one more entry than texts

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def split(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Runs of bytes of `in_word`; a run also ends where its text ends."""
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = in_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = inside[filled]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def code_points(data: np.ndarray) -> np.ndarray:
    """Per byte offset of UTF-8 text (its end included), how many code points begin before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Hasher:
    """64-bit hashes of words by a polynomial over random byte values, from running sums.

    `fold` gives A-Z the values of a-z.
    """

    def __init__(self, fold: bool = True, seed: int = 20240229):
        values = np.random.default_rng(seed).integers(1, 2**63, 256, np.int64).astype(np.uint64)
        if fold:
            values[0x41:0x5B] = values[0x61:0x7B]
        self.values = values
        self.base = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse)])

    def __call__(self, data: np.ndarray, words: Words) -> np.ndarray:
        if not len(words.start):
            return np.zeros(0, np.uint64)
        self._powers(len(data))
        running = np.empty(len(data) + 1, np.uint64)
        running[0] = 0
        np.cumsum(self.values[data] * self.up[: len(data)], out=running[1:])
        h = (running[words.end] - running[words.start]) * self.down[words.start]
        return mix(h + (words.end - words.start).astype(np.uint64))


def windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words inside one text, and the text each belongs to."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[:n].copy()
    for k in range(1, size):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n])
    text = words.text_of()
    whole = text[:n] == text[size - 1 :]
    return h[whole], text[:n][whole]
