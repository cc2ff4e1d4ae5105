"""Vectorised words of whole texts: separators are bytes 0x20 and 0x09-0x0D.

Works on the buffers of an Arrow string column, so that no Python object is made per
word. Hashes depend on a word's bytes alone, not on where or in which batch it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from turnout.llm.common import buffers_of

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes hashed at once (about 30 bytes of scratch for each).
SEGMENT = 1 << 18
_BASE, _C1, _C2 = 0x9E3779B97F4A7C15 | 1, U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def mix_light(x: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    """A seeded permutation of values that are scrambled already."""
    x = x * factor
    x += shift
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            t = np.full(size, U(base & (2**64 - 1)))
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93) + U(seed))


def spans(col: pa.Array, separator: np.ndarray = SEPARATOR):
    """(bytes, starts, ends, document of each word, words per document)."""
    data, offsets = buffers_of(col)
    n = len(data)
    gap = separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], gap[:-1]])[:n] | edge[:n]
    after = np.concatenate([gap[1:], [True]])[:n] | edge[1:]
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    doc = np.searchsorted(offsets[1:], starts, side="right").astype(np.int64)
    return data, starts, ends, doc, np.bincount(doc, minlength=len(col)).astype(np.int64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    letters = _letters(seed)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, side="right")))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        up, down = _powers(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(letters[data[lo : lo + e[-1]]] * up[: e[-1]], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _C2)
        i = j
    return out


def grams(h: np.ndarray, n: int, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hash of the n values from each place on, by doubling; `levels` keeps the powers of two."""
    levels = {} if levels is None else levels
    levels.setdefault(1, h)
    out, done = None, 0
    for size in (1 << k for k in range(n.bit_length())):
        if size not in levels:
            half = levels[size // 2]
            m = max(0, len(h) - size + 1)
            levels[size] = mix(half[:m] * U(0x2545F4914F6CDD1D) + half[size // 2 : size // 2 + m] + U(size))
    for size in sorted((1 << k for k in range(n.bit_length()) if n >> k & 1), reverse=True):
        part = levels[size]
        if out is None:
            out = part
        else:
            m = max(0, len(h) - done - size + 1)
            out = mix(out[:m] * U(0x2545F4914F6CDD1D) + part[done : done + m] + U(n))
        done += size
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on."""
    m, size = x, 1
    while size * 2 <= n:
        k = max(0, len(m) - size)
        m = np.minimum(m[:k], m[size : size + k])
        size *= 2
    k = max(0, len(x) - n + 1)
    return np.minimum(m[:k], m[n - size : n - size + k])
