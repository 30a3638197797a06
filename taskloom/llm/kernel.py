"""Words, word hashes and n-gram hashes of many texts at once, in numpy over UTF-8 bytes.

The word patterns of this package cut at ASCII bytes only, so bytes of longer code points are always
inside words and the cut can be made on bytes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240611))
#: A random 64-bit value for each byte; the key of the rolling hash.
BYTE_KEY = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The field of the hash of whole words and lines, and for each of its two bases a random value of each byte.
FIELD = (1 << 31) - 1
_FIELD_BASES = (1_103_515_245, 1_812_433_253)
_FIELD_KEYS = _SEED.integers(1, FIELD, (2, 256), dtype=np.uint64)
#: Bytes of the white space between words: space and \t to \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_field: list[np.ndarray] = []
#: Powers up to so many are kept by a worker (8 bytes each); those of a longer text are made for it alone.
KEPT_POWERS = 1 << 21


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash and of its inverse, modulo 2**64.

    For short strings of one length only: long ones of a certain form collide in it, whatever the base.
    """
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > KEPT_POWERS:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def field_powers(n: int) -> list[np.ndarray]:
    """The first n powers of the two bases of the field and of their inverses."""
    global _field
    if not _field or len(_field[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (*_FIELD_BASES, *(pow(b, -1, FIELD) for b in _FIELD_BASES)):
            x = np.ones(size, np.uint64)
            have = 1
            while have < size:
                more = min(have, size - have)
                x[have : have + more] = x[:more] * _U(pow(base, have, FIELD)) % _U(FIELD)
                have += more
            made.append(x)
        if size > KEPT_POWERS:
            return made
        _field = made
    return _field


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """x modulo the field, up to a multiple that ``times`` folds leave: two make any value less than 2**32 + 2."""
    for _ in range(times):
        high = x >> _U(31)
        x = x & _U(FIELD)
        x += high
    return x


class Hashes:
    """Hashes of byte ranges of ``data``, from sums of byte values times powers of a base, in a prime field.

    Two bases give 62 bits. Two different strings of n bytes collide with a chance of (n / 2**31) ** 2.
    """

    STEP = 1 << 15

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.powers = field_powers(n + 1)
        self.sums = []
        for keys, power in zip(_FIELD_KEYS, self.powers[:2], strict=True):
            sums = np.zeros(n + 1, np.uint64)
            for lo in range(0, n, self.STEP):
                hi = min(n, lo + self.STEP)
                x = keys[data[lo:hi]]
                x *= power[lo:hi]
                x = _folded(x, 1)
                x[0] += sums[lo]
                np.cumsum(x, out=sums[lo + 1 : hi + 1])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (_folded(_folded(s[end] - s[start], 2) * back[start], 2) for s, back in zip(self.sums, self.powers[2:], strict=True))
        a, b = (np.where(x >= _U(FIELD), x - _U(FIELD), x) for x in (a, b))
        return mix(((a << _U(32)) | b) + mix((end - start).astype(np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: Words up to so many times eight bytes are hashed eight bytes at a time.
LANES = 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words:
    """Maximal runs of word bytes of texts laid end to end.

    ``start``/``end``: byte ranges; ``first``: len(texts) + 1 indices of each text's first word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        mask = inside[data]
        self.mask = mask
        before = np.empty_like(mask)
        after = np.empty_like(mask)
        if len(mask):
            before[0] = False
            before[1:] = mask[:-1]
            after[-1] = False
            after[:-1] = mask[1:]
            edges = offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(mask))]
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Of each word: eight bytes at a time are mixed into the hash. Words over LANES * 8 bytes are hashed in the field."""
        size = self.end - self.start
        out = mix(size.astype(np.uint64) + _U(1))
        if not len(out):
            return out
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        rows = np.arange(len(size)) if size.max() <= 8 * LANES else np.flatnonzero(size <= 8 * LANES)
        start, left = self.start[rows], size[rows]
        for lane in range(LANES):
            value = eight[start + 8 * lane] & _MASK[np.minimum(left, 8)]
            out[rows] = mix(out[rows] * _U(0x9FB21C651E98DF25) + value)
            more = left > 8
            if not more.any():
                break
            rows, start, left = rows[more], start[more], left[more] - 8
        long = np.flatnonzero(size > 8 * LANES)
        if len(long):
            out[long] = Hashes(data).of(self.start[long], self.end[long])
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k values in a row; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for i in range(1, k):
        g = g * _U(0xC2B2AE3D27D4EB4F) + h[i : i + n]
    return mix(g + _U(k))


def shingles(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and len(texts) + 1 offsets into them.

    A text of fewer words, but not none, has its whole word sequence as one shingle.
    """
    count = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    offsets = np.concatenate(([0], np.cumsum(count)))
    whole = grams(h, k)
    out = np.empty(int(offsets[-1]), np.uint64)
    long = words.count >= k
    at = np.repeat(words.first[:-1] - offsets[:-1], count) + np.arange(len(out))
    keep = np.repeat(long, count)
    out[keep] = whole[at[keep]]
    for d in np.flatnonzero(~long & (words.count > 0)):
        a, b = words.first[d], words.first[d + 1]
        out[offsets[d]] = grams(h[a:b], b - a)[0]
    return out, offsets
