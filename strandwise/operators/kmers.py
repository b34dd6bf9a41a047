"""Generators: from sequences and codes to k-mers.

Codes are rolled along the bytes of a whole Arrow batch, a tile at a time; the letters of a window are taken from the bytes too, so a
chromosome never becomes one array of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import check_k, checked, code_of, encode_clean, mask_of
from .rolling import Windows, bound_batches, letters, per_tile, rolled


def kmer_array(seq: Column, k: int) -> Column:
    """All k-mers without N, in order, without their places, as an array as long as the sequence: for reads, not for chromosomes."""
    check_k(k)
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


#: Up to so many different k-mers are counted in an array that has a place for each.
DENSE = 1 << 20


def _distinct(tiles: Iterator[Windows], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code), each pair once. The codes of a sequence that goes on in the next tile are held, sorted, and merged with that tile's: what
    is held is the distinct k-mers of one sequence."""
    held_row, held = -1, np.zeros(0, np.int64)
    for row, _, code, _, open_row in tiles:
        if held_row >= 0:
            held = np.union1d(held, code[row == held_row])
            if held_row != open_row:
                yield np.full(len(held), held_row), held
        if open_row >= 0 and open_row != held_row:
            held = np.unique(code[row == open_row])
        inside = (row != held_row) & (row != open_row)
        held_row = open_row
        row, code = row[inside], code[inside]
        if len(row):
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            first = np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])
            yield row[first], code[first]
    if held_row >= 0:
        yield np.full(len(held), held_row), held


def batch_counts(reads: DataFrame, k: int, unique: bool, *by: str) -> DataFrame:
    """(by..., code, n), partly added up: in how many sequences a k-mer occurs, or how often. Few different k-mers are added up over a whole
    partition of the input, others tile by tile, so no array grows with the input or with a sequence; but for unique, which holds the
    distinct k-mers of the one sequence that is being read."""
    check_k(k)
    shape = T.StructType([*(reads.schema[c] for c in by), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    bound_batches(reads.sparkSession)
    dense = 4**k <= DENSE and not by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(4**k if dense else 0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = rolled(batch.column(len(by)), k)
            pairs = _distinct(tiles, k) if unique else ((x.row, x.code) for x in tiles)
            if dense:
                for _, code in pairs:
                    every += np.bincount(code, minlength=len(every))
                continue
            if by:
                group = batch.to_pandas().groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
            for row, code in pairs:
                of = group[row] if by else np.zeros(len(row), np.int64)
                code, of, n = _tally(code, of)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first[of])) for c in range(len(by))), pa.array(code), pa.array(n)], shape.names)
        if dense:
            code = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(every[code])], shape.names)

    return reads.select(*by, "seq").mapInArrow(run, shape)


def _tally(code: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each pair of code and ``of`` is there."""
    if not len(code):
        return code, of, code
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
    return code[start], of[start], np.diff(np.append(start, len(code)))


def sequence_counts(reads: DataFrame, k: int) -> DataFrame:
    """seq_no, code, n: counted where the sequence is, without a shuffle. What is held is the distinct k-mers of one sequence."""
    check_k(k)
    shape = T.StructType([reads.schema["seq_no"], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_row, held = -1, (np.zeros(0, np.int64),) * 2

            def rows(row: np.ndarray, code: np.ndarray, n: np.ndarray, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(code), pa.array(n)], shape.names)

            for row, _, code, _, open_row in rolled(batch.column(1), k):
                code, row, n = _tally(code, row)
                if held_row >= 0:
                    own = row == held_row
                    both, at = np.unique(np.concatenate([held[0], code[own]]), return_inverse=True)
                    held = both, np.bincount(at, np.concatenate([held[1], n[own]]), len(both)).astype(np.int64)
                    if held_row != open_row:
                        yield rows(np.full(len(held[0]), held_row), *held)
                if open_row >= 0 and open_row != held_row:
                    own = row == open_row
                    held = code[own], n[own]
                inside = (row != held_row) & (row != open_row)
                held_row = open_row
                yield rows(row[inside], code[inside], n[inside])
            if held_row >= 0:
                yield rows(np.full(len(held[0]), held_row), *held)

    return reads.select("seq_no", "seq").mapInArrow(run, shape)


def sequence_sizes(reads: DataFrame, k: int, *by: str) -> DataFrame:
    """(by..., n_seq, n): a row for each sequence, with 1 and how many windows it has."""
    check_k(k)
    shape = T.StructType([*(reads.schema[c] for c in by), T.StructField("n_seq", T.LongType()), T.StructField("n", T.LongType())])
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for windows in rolled(batch.column(len(by)), k):
                n += np.bincount(windows.row, minlength=len(n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(by))), pa.array(np.ones(len(n), np.int64)), pa.array(n)], shape.names)

    return reads.select(*by, "seq").mapInArrow(run, shape)


def kmers(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """seq_no, ``keep``, pos (from 0), kmer; windows with other letters than A, C, G, T are skipped."""

    def pick(seqs: pa.Array, windows: Windows, _: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list]]:
        yield np.arange(len(windows.row)), [windows.pos.astype(np.int32), letters(seqs, k, windows.at)]

    return per_tile(reads, k, ("seq_no", *keep), "pos int, kmer string", pick)


def kmer_codes(reads: DataFrame, k: int, *keep: str) -> DataFrame:
    """seq_no, ``keep``, pos, code."""

    def pick(_seqs: pa.Array, windows: Windows, _: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list]]:
        yield np.arange(len(windows.row)), [windows.pos.astype(np.int32), windows.code]

    return per_tile(reads, k, ("seq_no", *keep), "pos int, code long", pick)


def kmers_of_tiles(tiles: DataFrame, k: int) -> DataFrame:
    """chrom, pos (in the chromosome, long), kmer of tiles that were cut with a halo of k - 1 bases at least (``sources.genome.tiles``): each
    tile gives the k-mers that start in it, so the tiles of a chromosome can lie on different executors."""

    def pick(seqs: pa.Array, windows: Windows, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list]]:
        start = batch.column(1).to_numpy()
        yield np.arange(len(windows.row)), [start[windows.row] + windows.pos, letters(seqs, k, windows.at)]

    return per_tile(tiles, k, ("chrom", "tile_start"), "pos long, kmer string", pick, "own").select("chrom", "pos", "kmer")


def kmers_multi(reads: DataFrame, kmin: int, kmax: int) -> DataFrame:
    """seq_no, k, pos, kmer for each k of a range, from one pass over the reads."""
    check_k(kmin)
    check_k(kmax)
    shape = T.StructType([reads.schema["seq_no"], T.StructField("k", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())])
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = pc.fill_null(batch.column(1), "")
            for k in range(kmin, kmax + 1):
                for windows in rolled(seqs, k):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(windows.row)), pa.array(np.full(len(windows.row), k, np.int32)), pa.array(windows.pos.astype(np.int32)), letters(seqs, k, windows.at)], shape.names)

    return reads.select("seq_no", "seq").mapInArrow(run, shape)


def sub_kmers(code: Column, big_k: int, k: int) -> Column:
    """The k-mers inside a K-mer, as an array of codes, first place first."""
    return F.array(*(F.shiftrightunsigned(code, 2 * (big_k - k - i)).bitwiseAND(F.lit(mask_of(k))) for i in range(big_k - k + 1)))


def hamming_ball(spark: SparkSession, kmer: str, d: int) -> DataFrame:
    """(code, kmer) within d substitutions of a user's k-mer, in either case; other letters than A, C, G, T raise. d must be less than its
    length. In filters use a distance instead."""
    kmer = checked(kmer, "k-mer")
    if len(kmer) <= d:
        raise ValueError("the number of substitutions must be less than k")
    ball = spark.createDataFrame([(kmer,)], "kmer string")
    for _ in range(d):
        places = ball.select("kmer", F.explode(F.sequence(F.lit(1), F.lit(len(kmer)))).alias("place"))
        other = places.select("kmer", "place", F.explode(F.array(*(F.lit(b) for b in "ACGT"))).alias("base"))
        ball = other.select(F.concat(F.expr("substring(kmer, 1, place - 1)"), "base", F.expr("substring(kmer, place + 1)")).alias("kmer")).distinct()
    return ball.select(encode_clean(F.col("kmer")).alias("code"), "kmer")


def is_motif(code: Column, consensus: str, d: int, revcom: bool = True) -> Column:
    """Whether a code lies within d substitutions of the consensus, or of its reverse complement."""
    from ..functions.codec import hamming, revcom_of

    k, own = len(consensus), code_of(consensus)
    near = hamming(code, F.lit(own)) <= d
    return near | (hamming(code, F.lit(revcom_of(own, k))) <= d) if revcom else near


def contain_motif(code: Column, big_k: int, consensus: str, d: int, revcom: bool = True) -> Column:
    """Whether any k-mer inside a K-mer is one of the motif. Unrolled, so that it stays in generated code."""
    k = len(consensus)
    if big_k < k:
        raise ValueError("K must be at least k")
    out = F.lit(False)
    for i in range(big_k - k + 1):
        out = out | is_motif(F.shiftrightunsigned(code, 2 * i).bitwiseAND(F.lit(mask_of(k))), consensus, d, revcom)
    return out
