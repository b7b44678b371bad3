"""Vectorised pieces of text work on Arrow columns: bytes, words, lines, window hashes.

A column becomes one byte buffer in which a newline follows each document, so
that words and lines never cross documents. Hashes are 64-bit; wherever equal
hashes decide about a result, the word lengths and document go into them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text worked on at once; a longer document is its own piece.
PIECE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


_POWERS: dict[int, np.ndarray] = {}


def power_table(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; kept in the worker up to four pieces long."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = powers(int(base), max(n, PIECE_BYTES + (PIECE_BYTES >> 2)))
        if n <= 4 * PIECE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums such that ``(p[e] - p[s]) * BASE**s`` is the hash of bytes s to e wherever they stand."""
    n = len(codes)
    out = np.zeros(n + 1, U)
    np.cumsum(codes * power_table(BASE_INVERSE, n), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * power_table(BASE, len(prefix))[start] + (end - start).astype(U))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one document."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += int(size)
    if first < len(sizes):
        yield first, len(sizes)


class Texts:
    """Documents of one piece as bytes; ``start[i]:end[i]`` is document i in ``data``."""

    def __init__(self, column: pa.Array):
        whole = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
        self.n = len(whole)
        sizes = np.fromiter(map(len, whole), np.int64, self.n)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.data = np.frombuffer(b"\n".join([*whole, b""]), np.uint8)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the words, in order."""
        apart = SEPARATORS[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], apart, [True])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.end, start, side="right")

    def word_hashes(self, start: np.ndarray, end: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        return span_hashes(prefix_hashes(codes[self.data]), start, end)


def window_hashes(word: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; the array is shorter by ``width - 1``."""
    n = max(0, len(word) - width + 1)
    out = np.zeros(n, U)
    for k in range(width):
        out += mix(word[k : k + n] + U(k)) * U(2 * k + 3)
    return mix(out)


def shingle_sets(texts: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased words as (sorted hashes of all documents one after the other, number in each).

    A document with fewer words has one shingle, its whole sequence; one without words has none.
    """
    start, end, doc = texts.words()
    word = texts.word_hashes(start, end, LOWER_CODES)
    n = np.bincount(doc, minlength=texts.n)
    hashed = window_hashes(word, width)
    inside = doc[: len(hashed)] == doc[width - 1 :] if len(hashed) else np.zeros(0, bool)
    docs, values = [doc[: len(hashed)][inside]], [hashed[inside]]
    first = np.cumsum(n) - n
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        value = np.full(len(short), k, U)
        for j in range(k):
            value = mix(value * U(31) + word[first[short] + j])
        docs.append(short)
        values.append(value)
    docs, values = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(docs[new], minlength=texts.n)
