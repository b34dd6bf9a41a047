"""The most frequent pairs of k-mers, exactly, without a table of all counts.

k-mers fall into a fixed number of buckets by a hash of the lower code of both strands. A bucket's total, which partitions of the input add up side by
side, is no less than the count of any pair in it. The pairs of the heaviest buckets, counted exactly, give a count that m pairs reach; only
pairs of buckets whose total reaches it can be among the first m, and only these are shuffled and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import check_k, decode
from ..sources.scratch import stored
from .counts import strand_pairs
from .kmers import _distinct
from .rolling import bound_batches, rolled

BUCKETS = 1 << 20
#: So many buckets for each of the m pairs are counted to find out what the first m reach.
AHEAD = 4


def revcom_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements: groups of two bits, then of four, ... change places."""
    x = ~code.astype(np.uint64)
    for size, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x >> np.uint64(size)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(size))
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def bucket_of(code: np.ndarray, k: int, buckets: int) -> np.ndarray:
    low = np.minimum(code, revcom_codes(code, k)).astype(np.uint64)
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % buckets


def bucket_totals(reads: DataFrame, k: int, unique: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """bucket, total: an upper bound for the pairs of k-mers in it. Each partition of the input sends at most ``buckets`` rows."""
    check_k(k)
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(buckets, np.int64)
        for batch in batches:
            tiles = rolled(batch.column(0), k)
            for _, code in _distinct(tiles, k) if unique else ((x.row, x.code) for x in tiles):
                every += np.bincount(bucket_of(code, k, buckets), minlength=buckets)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(every[at])], ["bucket", "total"])

    return reads.select("seq").mapInArrow(run, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def counts_in(reads: DataFrame, k: int, wanted: list[int], unique: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """k, code, kmer, n of the k-mers in some buckets; others don't leave the worker. wanted: at most ``buckets`` numbers, sent as a bit each."""
    chosen = np.zeros(buckets, bool)
    chosen[wanted] = True
    held = reads.sparkSession.sparkContext.broadcast(np.packbits(chosen).tobytes())
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            tiles = rolled(batch.column(0), k)
            for _, code in _distinct(tiles, k) if unique else ((x.row, x.code) for x in tiles):
                own, n = np.unique(code[inside[bucket_of(code, k, buckets)]], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["code", "n"])

    rows = reads.select("seq").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return rows.select(F.lit(k).alias("k"), "code", decode(F.col("code"), k).alias("kmer"), "n")


def candidates(reads: DataFrame, k: int, m: int, unique: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Exact counts of all k-mers that can belong to the m most frequent pairs."""
    totals = stored(bucket_totals(reads, k, unique, buckets), "totals")
    ahead = [r.bucket for r in totals.orderBy(F.desc("total"), "bucket").limit(AHEAD * m).collect()]
    first = stored(counts_in(reads, k, ahead, unique, buckets), "first")
    reached = [r.pair_n for r in strand_pairs(first, k).orderBy(F.desc("pair_n")).limit(m).collect()]
    least = reached[-1] if len(reached) == m else 0
    possible = [r.bucket for r in totals.where(F.col("total") >= least).select("bucket").collect()]  # at most ``buckets`` numbers
    return first if set(possible) <= set(ahead) else counts_in(reads, k, possible, unique, buckets)


def top_pairs(reads: DataFrame, k: int, m: int = 6, unique: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``operators.counts.top_kmers`` for pairs of strands, from the reads. Three passes over the reads at most."""
    found = strand_pairs(candidates(reads, k, m, unique, buckets), k).orderBy(F.desc("pair_n"), "canon").limit(m)
    return found.select("k", "code", "kmer", "rc_kmer", "n", "rc_n", "pair_n", "is_palindrome")
