"""Vectorised word hashing over Arrow text columns: no Python object is made for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and odd**-i modulo 2**64, for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << int(n).bit_length()
        for name, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and where each row's begin (one entry more than rows); nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in raw, and for each row the index of its first word (one entry more than rows)."""
    inside = ~is_space(raw)
    before = np.empty(len(raw), bool)
    after = np.empty(len(raw), bool)
    if len(raw):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = at[(at > 0) & (at < len(raw))]
        before[cuts] = False
        after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever it stands; memory is bounded by CHUNK and the longest word."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        first = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        last = ends[stop - 1]
        up, down = powers(int(last - first) + 1)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[raw[first:last]] * up[: last - first], out=total[1:])
        s, e = starts[done:stop] - first, ends[done:stop] - first
        out[done:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        done = stop
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row, and for each row the index of its first word."""
    raw, at = text_bytes(column)
    raw = lowered(raw)
    starts, ends, firsts = word_spans(raw, at)
    return span_hashes(raw, starts, ends), firsts


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k successive words; fewer words count as one sequence."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total * _ODD + hashes[i : n - k + 1 + i])
    return np.unique(total)
