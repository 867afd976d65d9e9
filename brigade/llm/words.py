"""Hashing the words of whole texts with numpy, straight from Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; such bytes never
occur inside a longer UTF-8 character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 65, dtype=np.uint64) * _STEP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _A
    h = h ^ (h >> np.uint64(27))
    h = h * _B
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a row's bound also bounds words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[data]
    bound = np.zeros(n + 1, bool)
    bound[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | bound[1:n]
    last = word
    last[:-1] &= ~word[1:] | bound[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span, about ``chunk`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    total = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    value = _BYTE[table]
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + chunk, "right")) - 1)
        n = lens[i:j]
        heads = total[i:j] - total[i]
        at = np.arange(total[j] - total[i])
        place = at - np.repeat(heads, n)
        h = value[data[at + np.repeat(starts[i:j] - heads, n)]]
        h *= _PLACE[place & 1023]
        if (n > 1024).any():
            h *= _STEP ** (place >> 10).astype(np.uint64)
        out[i:j] = np.add.reduceat(h, heads) + n.astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, for each row the number of its first word and one bound more)."""
    data, offs = buffers(col)
    starts, ends = spans(data, offs)
    return hashes(data, starts, ends), np.searchsorted(starts, offs)


def shingles(h: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``k`` words, its row). A row with fewer words has its whole sequence as
    the only one; a row without words has none."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.diff(firsts)
    s = np.zeros(len(h), np.uint64)
    for d in range(min(k, len(h))):
        s[: len(h) - d] += mix(h[d:] + _STEPS[d]) * _PLACE[d]
    row = np.repeat(np.arange(len(n)), n)
    keep = np.arange(len(h)) + k <= firsts[1:][row]
    short = np.flatnonzero((n > 0) & (n < k))
    tails = _PLACE[100 + n[short]].copy()
    for d in range(k - 1):
        has = n[short] > d
        tails[has] += mix(h[firsts[short[has]] + d] + _STEPS[d]) * _PLACE[d]
    return mix(np.concatenate([s[keep], tails])), np.concatenate([row[keep], short])
