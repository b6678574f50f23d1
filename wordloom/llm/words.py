"""Words of many UTF-8 texts at once, as numpy arrays: boundaries and 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER_BYTE = _BYTE[_LOWER]
_CHUNK = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, _CHUNK + 65536)
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n+1 offsets of an array of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def bounds(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes that are no `gap` (by default `[^\\x20\\x09-\\x0D]+`),
    and n+1 offsets of the texts in them."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~gap[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of buf; A-Z count as a-z when lower. Spans must not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _LOWER_BYTE if lower else _BYTE
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _CHUNK, side="right")))
        b = ends[j - 1]
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(values[buf[a:b]] * up[: b - a], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a] + (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return mixed(out)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words of one text, with repeats; of the whole text where it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : n - k + 1 + i]
    return mixed(out)


def pieces(offs: np.ndarray, most: int):
    """Ranges of texts of about `most` bytes in all; a longer text makes a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j
