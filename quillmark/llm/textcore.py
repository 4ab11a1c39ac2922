"""Vectorised byte-level text kernels shared by the Arrow operators.

A whole Arrow batch of strings is treated as one byte array.  Words are the
maximal runs of bytes outside ASCII white space (0x20, 0x09-0x0D), which for
UTF-8 equals the runs of such code points, and every word gets a 64-bit hash
computed with prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 4 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 output function)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]
#: The hash of the end of a document, as a token of its own.
END = int(mix(np.array([0x5EED], U64))[0])
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the odd base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", _INVERSE)):
                p = np.full(size, base, U64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def forget() -> None:
    """Drops the tables of powers; they are made again when needed."""
    _POWERS.clear()


def combine(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hash of the sequence hashed by ``a`` followed by ``b``."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xC2B2AE3D27D4EB4F) + (b if isinstance(b, np.ndarray) else U64(b)))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row when it is longer."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    sizes = byte_offsets(text)
    lo, n = 0, len(text)
    while lo < n:
        hi = int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_offsets(text: pa.Array) -> np.ndarray:
    """The offsets of a (large) string or binary array, its slice taken into account."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(text.buffers()[1], kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; a null row counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = byte_offsets(text)
    data = text.buffers()[2]
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return body, off - off[0]


def spans(body: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes; runs end with their row."""
    n = len(body)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hash_spans(body: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte runs; ``lower`` ignores the case of A-Z."""
    if not len(start):
        return np.zeros(0, U64)
    up, down = _powers(len(body) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(body) + 1, U64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[body] * up[: len(body)], dtype=U64, out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash, row, start, end (bytes); and the number of words by row."""
    body, off = raw(text)
    start, end, row = spans(body, off, ~WHITE[body])
    return hash_spans(body, start, end, lower), row, start, end, np.bincount(row, minlength=len(off) - 1)


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` tokens inside one row, and the index of their first token."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = mix(h[:n] + U64(width))
    for k in range(1, width):
        out = combine(out, h[k : n + k])
    first = np.flatnonzero(row[:n] == row[width - 1 :])
    return out[first], first


def distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, ordered by row and key; ``row`` must be ascending."""
    if not len(key):
        return key, row
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]
