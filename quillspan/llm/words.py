"""Words, word hashes and word shingles of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import text_buffer

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64

#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _table(member) -> np.ndarray:
    return np.array([member(b) for b in range(256)], dtype=bool)


#: Word bytes between white space: anything but \x20 and \x09-\x0D.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes of letters and digits: 0-9, letters, and every byte of a non-ASCII character.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where possible."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)[LOWER]
_WINDOW = constants(64, 12)
_LENGTH = constants(64, 13)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        base = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _pow, _inv = np.multiply.accumulate(base), np.multiply.accumulate(back)
    return _pow, _inv


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, as they were
    text_at: np.ndarray  #: where each text begins in data, one more at the end
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte behind each word
    first: np.ndarray  #: index of each text's first word, one more at the end
    hash: np.ndarray  #: 64-bit hash of each word's lower-cased bytes

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def lowered(self, a: int, b: int) -> bytes:
        """Words a..b (b excluded) in lower case, joined by one space."""
        low = LOWER[self.data[self.start[a] : self.end[b - 1]]].tobytes()
        s0 = self.start[a]
        return b" ".join(low[self.start[i] - s0 : self.end[i] - s0] for i in range(a, b))


def words(arr: pa.Array, member: np.ndarray = SPACED) -> Words:
    """member: for each byte whether it belongs to a word."""
    data, at = text_buffer(arr)
    n = len(data)
    inside = member[data]
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    edge = at[:-1][np.diff(at) > 0]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers(n + 1)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=run[1:])
    h = mix((run[end] - run[start]) * inverse[start])
    return Words(data, at, start, end, np.searchsorted(start, at), h)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries of h (runs that cross texts included)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = h[:m] * _WINDOW[0]
    for j in range(1, k):
        total += h[j : j + m] * _WINDOW[j]
    return mix(total + _LENGTH[k])


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingles of each text, one after another, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle; a text without words has none."""
    count = w.count
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n)))
    position = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(w.first[:-1], n)
    out = np.empty(at[-1], np.uint64)
    whole = windows(w.hash, k)
    long = np.repeat(count >= k, n)
    out[long] = whole[position[long]]
    for size in range(1, k):
        texts = np.flatnonzero(count == size)
        if len(texts):
            out[at[texts]] = windows(w.hash, size)[w.first[texts]]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][n > 0]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], total[at]
