"""Counts of k-mers for a range of k from one pass over the reads.

Small k are counted in arrays with a place for each k-mer, and sent once for each partition of the input. For larger k what is shuffled are
runs: neighbouring k-mers with the same minimizer (of their m-mers the one with the smallest hash) as one row of at most 62 bases, 2 bits each, with
equal runs of a tile added up. A k-mer has its minimizer wherever it occurs, so all its occurrences meet in one partition, where the runs are taken
apart again and counted; that aggregation needs no further shuffle. A run of r k-mers costs r + k - 1 bases rather than r codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import check_k, decode
from .rolling import DIGIT, TILE, bound_batches, layout, rolled, window_codes

#: Up to this k all k-mers have a place in an array: 4 ** 11 counts are 32 MB.
DENSE_K = 11
#: Bases of a minimizer.
MINIMIZER = 9
#: Bases in half a run, and in a run.
HALF, RUN = 31, 62
#: Bits that tell k, and the bases of a run.
K_BITS, LENGTH_BITS = 5, 6


def _hash(code: np.ndarray) -> np.ndarray:
    """40 bits that order m-mers in a way that has nothing to do with their letters, so that runs of one letter don't win."""
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(24)).astype(np.int64)


def _runs(raw: np.ndarray, ends: np.ndarray, n: int, ks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each k the runs of k-mers that start at the first n places: (bucket, first half, second half, bases). ends: where sequences end."""
    place = np.arange(n)
    stops = np.flatnonzero(DIGIT[raw] > 3)
    room = np.append(stops, len(raw))[np.searchsorted(stops, place)]
    room = np.minimum(room, np.append(ends, len(raw))[np.searchsorted(ends, place, "right")]) - place  # clean bases from here on
    halves, _ = window_codes(np.concatenate([raw, np.full(RUN + HALF, 65, np.uint8)]), HALF)
    h = _hash(window_codes(np.concatenate([raw, np.full(RUN, 65, np.uint8)]), MINIMIZER)[0])
    least, wide = h[:n].copy(), 1
    for k in ks:
        while wide < k - MINIMIZER + 1:
            np.minimum(least, h[wide : wide + n], out=least)
            wide += 1
        good = room >= k
        begins = good.copy()
        begins[1:] &= ~good[:-1] | (least[1:] != least[:-1])
        at = np.flatnonzero(begins)
        # A run ends before the next one begins, or before a window that isn't clean.
        stop = np.flatnonzero(begins | ~good)
        after = np.append(stop, n)[np.searchsorted(stop, at, "right")]
        size, most = after - at, RUN - k + 1
        pieces = -(-size // most)
        turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(at, pieces) + turn * most
        bases = np.minimum(np.repeat(size, pieces) - turn * most, most) + k - 1
        spare = 2 * (HALF - np.minimum(bases, HALF))
        first = halves[start] >> spare << spare
        more = np.maximum(bases - HALF, 0)
        spare = 2 * (HALF - more)
        second = np.where(more > 0, halves[start + HALF] >> np.minimum(spare, 61) << np.minimum(spare, 61), 0)
        yield (least[start] << K_BITS) | k, first, second, bases


def _added_up(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(keys[::-1])
    keys = tuple(x[order] for x in keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    return (*(x[start] for x in keys), np.diff(np.append(start, len(order))))


def runs_of(reads: DataFrame, ks: list[int]) -> DataFrame:
    """bucket (minimizer's hash, k), first, second (left-aligned bases), meta (how often, bases): the rows that are shuffled. Both kinds of k
    come from one pass; a k-mer of a small k is a run of one, with itself for a minimizer."""
    for k in ks:
        check_k(k)
    small, large = [k for k in sorted(set(ks)) if k <= DENSE_K], [k for k in sorted(set(ks)) if k > DENSE_K]
    bound_batches(reads.sparkSession)
    names = ["bucket", "first", "second", "meta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {k: np.zeros(4**k, np.int64) for k in small}
        for batch in batches:
            seqs = pc.fill_null(batch.column(0), "")
            for k in small:
                for windows in rolled(seqs, k):
                    # Sorted, as a tile has fewer windows than a large array has places.
                    code, n = np.unique(windows.code, return_counts=True)
                    dense[k][code] += n
            starts, data = layout(seqs)
            for a in range(int(starts[0]), int(starts[-1]), TILE) if large else []:
                raw = data[a : min(a + TILE + HALF, int(starts[-1]))]
                ends = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, a + len(raw), "right")] - a
                for bucket, first, second, bases in _runs(raw, ends, min(TILE, len(raw)), large):
                    bucket, first, second, bases, n = _added_up(bucket, first, second, bases)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, first, second, n << LENGTH_BITS | bases)], names)
        for k, every in dense.items():
            code = np.flatnonzero(every)
            for i in range(0, len(code), TILE):
                own = code[i : i + TILE]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_hash(own) << K_BITS | k, own << (2 * (HALF - k)), np.zeros(len(own), np.int64), every[own] << LENGTH_BITS | k)], names)

    return reads.select("seq").mapInArrow(run, "bucket long, first long, second long, meta long")


def code_at(first: str, second: str, turn: str, k: str) -> Column:
    """The code of the k-mer at a place of a run: of the 31 bases from there on, some of one half and some of the other, the first k. Shifts by
    columns stay in generated code."""
    mask = (1 << (2 * HALF)) - 1
    here = f"if({turn} < {HALF}, (shiftleft({first}, 2 * {turn}) & {mask}) | shiftright({second}, {2 * HALF} - 2 * least({turn}, {HALF})), shiftleft({second}, 2 * ({turn} - {HALF})) & {mask})"
    return F.expr(f"shiftright({here}, 2 * ({HALF} - {k}))")


def count_ks(reads: DataFrame, ks: list[int]) -> DataFrame:
    """k, code, kmer, n (occurrences) for several k from one pass over the reads and one shuffle."""
    met = runs_of(reads, ks).repartition("bucket").select("bucket", "first", "second", F.shiftright("meta", LENGTH_BITS).alias("n"), F.expr(f"cast(meta & {(1 << LENGTH_BITS) - 1} as int)").alias("bases"), F.expr(f"cast(bucket & {(1 << K_BITS) - 1} as int)").alias("k"))
    rows = met.select("bucket", "first", "second", "n", "k", F.explode(F.sequence(F.lit(0), F.col("bases") - F.col("k"))).alias("turn"))
    counted = rows.select("bucket", "n", code_at("first", "second", "turn", "k").alias("code")).groupBy("bucket", "code").agg(F.sum("n").alias("n"))
    k = F.expr(f"cast(bucket & {(1 << K_BITS) - 1} as int)")
    return counted.select(k.alias("k"), "code", decode(F.col("code"), k).alias("kmer"), "n")
