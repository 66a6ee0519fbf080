"""Word kernels shared by the corpus operators: vectorised over the bytes of whole Arrow columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  In UTF-8 those bytes never
occur inside a longer character, so working on bytes and on characters gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; arrays of eight bytes for each are held while a chunk is worked on.
CHUNK_BYTES = 1 << 19

_BASE = U(0x9E3779B97F4A7C15 | 1)
_UNBASE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of rows: word i is ``data[starts[i]:ends[i]]``; row r has words ``rows[r]:rows[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a row, and for each row where its runs start."""
        n = np.maximum(np.diff(self.rows) - k + 1, 0)
        at = np.concatenate([[0], np.cumsum(n)])
        if not at[-1]:
            return np.empty(0, np.uint64), at
        first = np.repeat(self.rows[:-1] - at[:-1], n) + np.arange(at[-1])
        whole = np.full(len(self.hashes) - k + 1, U(k))
        for j in range(k):
            whole = whole * _BASE + self.hashes[j : len(self.hashes) - k + 1 + j]
        return mix(whole[first]), at


def columns(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts in them; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each of the parts ``data[starts[i]:ends[i]]``, each byte counting as ``values`` says."""
    n = len(data)
    up, down = _powers_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> Words:
    """Splits rows ``data[bounds[r]:bounds[r + 1]]`` into words; ``fold`` lower-cases A-Z in the hashes."""
    n = len(data)
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[:-1][np.diff(bounds) > 0]
        first[edges] = inside[edges]
        edges = bounds[1:][np.diff(bounds) > 0] - 1
        last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds), byte_hashes(data, starts, ends, _FOLDED if fold else _BYTE))


def chunked(array: pa.Array, fold: bool = False) -> Iterator[tuple[int, Words]]:
    """The words of a column, some rows at a time: the first row and its words."""
    if not len(array):
        return
    data, bounds = columns(array)
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, "right")) - 1)
        yield low, words(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], fold)
        low = high


def shingle_sets(array: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number and sorted distinct hashes of k-word shingles, A-Z lower-cased.

    A row with 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    for low, w in chunked(array, fold=True):
        hashes, at = w.runs(k)
        for r in range(len(at) - 1):
            own = hashes[at[r] : at[r + 1]]
            if not len(own) and w.rows[r + 1] > w.rows[r]:
                few = w.hashes[w.rows[r] : w.rows[r + 1]]
                own = mix(np.sum(few * _powers_to(k + 1)[0][: len(few)], keepdims=True) + U(len(few)))
            yield low + r, np.unique(own)


def keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 16-byte key of each set of hashes, as an (n, 2) array; equal sets have equal keys."""
    out = np.zeros((len(sets), 2), np.uint64)
    lengths = np.array([len(s) for s in sets])
    if lengths.sum():
        every, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(lengths)])
        for k in range(2):
            part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every + U(0x5851F42D4C957F2D * (k + 1) % 2**64)))])
            out[:, k] = mix(part[at[1:]] - part[at[:-1]] + lengths.astype(np.uint64))
    return out


def binary16(pairs: np.ndarray) -> pa.Array:
    """An (n, 2) array of 64-bit numbers as 16-byte binaries, most significant byte first."""
    raw = np.ascontiguousarray(pairs, ">u8")
    return pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())

