"""Codes of all windows of the sequences in an Arrow batch, rolled along its bytes a tile at a time.

Tiles overlap by a window less one base, and a tile owns the windows that start in it; so a chromosome and ten thousand reads are the same
work, and no array is longer than a tile, whatever the length of a sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.codec import check_k

#: Window starts in a tile.
TILE = 1 << 20
#: Bytes in an Arrow batch, but for a single longer sequence.
BATCH_BYTES = 64 << 20

DIGIT = np.full(256, 4, np.uint8)
DIGIT[[65, 67, 71, 84]] = [0, 1, 2, 3]


def window_codes(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k bytes, and which of them hold A, C, G and T only. Codes of 2, 4, 8, ... bases are put together from two
    of half the length."""
    n = len(raw) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    base = DIGIT[raw]
    part, size = (base & 3).astype(np.int64), 1  # codes of windows of that size
    code, done, rest = None, 0, k
    while rest:
        if rest & 1:
            # The size's windows come behind what is done already: lower sizes first.
            own = part[done : done + n]
            code = own.copy() if code is None else (code << (2 * size)) | own
            done += size
        rest >>= 1
        if rest:
            part = (part[: len(part) - size] << (2 * size)) | part[size:]
            size *= 2
    bad = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(base > 3, out=bad[1:])
    return code, bad[k:] == bad[:-k]


def layout(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each sequence starts in the array's bytes (and where the last one ends), and the bytes."""
    kind = np.int64 if pa.types.is_large_string(seqs.type) else np.int32
    _, offsets, data = seqs.buffers()
    starts = np.frombuffer(offsets, kind)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64) if len(seqs) else np.zeros(1, np.int64)
    return starts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class Windows(NamedTuple):
    """The clean windows that start in a tile."""

    row: np.ndarray
    pos: np.ndarray
    code: np.ndarray
    #: Where they start in the array's bytes.
    at: np.ndarray
    #: The sequence that goes on in the next tile, or -1.
    open_row: int


def rolled(seqs: pa.Array, k: int) -> Iterator[Windows]:
    """Tile by tile the windows of k bases without other letters; none spans two sequences."""
    check_k(k)
    starts, data = layout(pc.fill_null(seqs, ""))
    for a in range(int(starts[0]), int(starts[-1]), TILE):
        code, good = window_codes(data[a : min(a + TILE + k - 1, int(starts[-1]))], k)
        ends = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, a + len(good) + k, "right")] - a
        for back in range(1, k):
            at = ends - back
            good[at[(at >= 0) & (at < len(good))]] = False
        at = np.flatnonzero(good)
        row = np.searchsorted(starts, a + at, "right") - 1
        beyond = int(np.searchsorted(starts, a + TILE, "right")) - 1  # whose bytes come next
        open_row = beyond if beyond < len(starts) - 1 and starts[beyond] < a + TILE < starts[-1] else -1
        yield Windows(row, a + at - starts[row], code[at], a + at, open_row)


def letters(seqs: pa.Array, k: int, at: np.ndarray) -> pa.Array:
    """The windows at places of the array's bytes, as strings."""
    data = layout(seqs)[1]
    if not len(at):
        return pa.array([], pa.string())
    found = np.lib.stride_tricks.sliding_window_view(data, k)[at].tobytes()
    return pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(found))


def near(code: np.ndarray, to: int, d: int) -> np.ndarray:
    """Whether codes differ from one in at most d bases."""
    x = code ^ to
    return np.bitwise_count((x | (x >> 1)) & 0x5555555555555555) <= d


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless a lower bound is set. A setting of the session that changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, None)
    if found is None or not found.isdigit() or not 0 < int(found) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def per_tile(reads: DataFrame, k: int, keep: tuple[str, ...], columns: str, pick: Callable[[pa.Array, Windows, pa.RecordBatch], Iterator[tuple[np.ndarray, list]]], own: str | None = None) -> DataFrame:
    """keep and ``columns`` for the windows that ``pick`` chooses: for a tile's windows it yields (which of them, a value of each column
    for each). own: a column that says before which place a window must start."""
    more = T.StructType.fromDDL(columns)
    shape = T.StructType([*(reads.schema[c] for c in keep), *more])
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = pc.fill_null(batch.column(len(keep)), "")
            limit = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False) if own else None
            for windows in rolled(seqs, k):
                if limit is not None:
                    mine = windows.pos < limit[windows.row]
                    windows = Windows(*(x[mine] for x in windows[:4]), windows.open_row)
                for chosen, values in pick(seqs, windows, batch):
                    if len(chosen):
                        row = pa.array(windows.row[chosen])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in range(len(keep))), *(x if isinstance(x, pa.Array) else pa.array(x) for x in values)], shape.names)

    return reads.select(*keep, "seq", *([own] if own else [])).mapInArrow(run, shape)
