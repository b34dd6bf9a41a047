"""Vectorised work on the bytes of an Arrow batch of texts: words, word hashes, shingles.

A batch is one byte buffer with an offset for each text; every function works on the whole buffer with
numpy, so no Python code runs for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Any odd number serves as the base of the polynomial hash.
BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte; A-Z share those of a-z.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=U64)
BYTE_CODE_FOLDED = BYTE_CODE.copy()
BYTE_CODE_FOLDED[65:91] = BYTE_CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    off = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i up to n."""
    found = _powers.get(0)
    if found is None or len(found[0]) <= n:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        up = np.full(size, BASE, U64)
        down = np.full(size, pow(BASE, -1, 2**64), U64)
        up[0] = down[0] = 1
        found = _powers[0] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return found


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the polynomial of codes[i:j], times BASE**i."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes not in ``gap``), and for each text the number of words before it."""
    inside = ~gap[raw]
    n = len(raw)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[off[:-1]] = False
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[off[1:]] = False
    start = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE, codes: np.ndarray = BYTE_CODE_FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word (A-Z as a-z), and for each text the number of words before it."""
    start, end, first = word_spans(raw, off, gap)
    return span_hash(prefix_hash(codes[raw]), start, end), first


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and for each text the number of them before it.

    A text with fewer words (but at least one) has a single shingle: all its words.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(at[-1]) - at[doc] + first[doc]
    width = np.minimum(n_words, size)[doc]
    padded = np.concatenate([words, np.zeros(size, U64)])
    out = width.astype(U64)
    for i in range(size):
        piece = padded[place + i]
        piece[width <= i] = 0
        out = mix(out * U64(0x9FB21C651E98DF25) + piece)
    return out, at


def distinct_in_each(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    out = np.zeros(len(at), np.int64)
    np.cumsum([len(x) for x in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out
