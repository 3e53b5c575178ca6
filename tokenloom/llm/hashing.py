"""Vectorized word splitting and rolling hashes over UTF-8 bytes (numpy, inside Arrow tasks).

All hashes are polynomial sums modulo 2**64 over randomized byte or word values, finished by
a 64-bit mixer.  The multipliers are odd, so a prefix-sum difference is brought to offset 0
by multiplying with a power of the inverse.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_M_BYTE = 0x9E3779B97F4A7C15 | 1
_M_WORD = 0xD1342543DE82EF95 | 1
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U64(base), dtype=U64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out, dtype=U64)
        if size > 1 << 21:  # one very long text: don't keep its table
            del _POWERS[base]
    return have[:n]


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span."""
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _powers(base, len(values)), dtype=U64, out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return (sums[ends] - sums[starts]) * inverse[starts]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span; the length is part of it."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    return mix64(_spans(_BYTE_VALUES[raw], _M_BYTE, starts, ends) + (ends - starts).astype(U64))


def word_spans(raw: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-space bytes."""
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = ~space[raw]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def chunks(batch, most: int = 1_000_000, columns: int = 2):
    """Successive rows of the first columns of an Arrow batch (ids, texts, ...), the texts as UTF-8 bytes
    and about ``most`` bytes of them; a longer text comes alone.  Bounds a task's memory."""
    held, size = [], 0
    for lo in range(0, batch.num_rows, 128):
        part = batch.slice(lo, 128)
        for row in zip(*(part.column(k).to_pylist() for k in range(columns))):
            text = b"" if row[1] is None else row[1].encode("utf-8", "surrogatepass")
            if held and size + len(text) > most:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
            held.append((row[0], text, *row[2:]))
            size += len(text) + 1
    if held:
        yield tuple(map(list, zip(*held)))


def hashed_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the words' number in each text.

    Words are separated by spaces, tabs and line ends only."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    starts, ends = word_spans(raw)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return span_hashes(raw, starts, ends), counts


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive words, by start position (texts not separated)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    starts = np.arange(n)
    return mix64(_spans(words, _M_WORD, starts, starts + width))


def whole(words: np.ndarray) -> np.ndarray:
    """Hash of the whole sequence as one value (for texts shorter than a shingle)."""
    n = np.array([len(words)])
    return mix64(_spans(words, _M_WORD, np.array([0]), n) + n.astype(U64))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words none."""
    if len(words) >= width:
        return np.unique(rolling(words, width))
    return whole(words) if len(words) else np.zeros(0, dtype=U64)
