"""Motifs: a consensus and what lies within a few substitutions of it, on both strands.

Hits are rows (seq_no, strand, pos); overlapping hits all count. A palindrome, or a motif without its reverse
complement, has forward hits only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import LOW_BITS, checked, code_of, hamming, kmer_of, mask_of, mutation_limit, relative_position, revcom_code, revcom_of
from .kmers import kmer_codes
from .rolling import Windows, bound_batches, near, per_tile, rolled

BINS, SIGMA, POINTS = 100, 5.0, 1000
PSEUDO = 1e-6


@dataclass(frozen=True)
class Motif:
    consensus: str
    d: int
    revcom: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "consensus", checked(self.consensus, "consensus"))

    @classmethod
    def of(cls, consensus: str, n_max_mutation: int = 2, revcom: bool = True) -> Motif:
        """With the limit that suits the length."""
        return cls(consensus, mutation_limit(len(consensus), n_max_mutation), revcom)

    @property
    def k(self) -> int:
        return len(self.consensus)

    @property
    def code(self) -> int:
        return code_of(self.consensus)

    @property
    def rc_code(self) -> int:
        return revcom_of(self.code, self.k)

    @property
    def is_palindrome(self) -> bool:
        return kmer_of(self.rc_code, self.k) == self.consensus

    @property
    def two_strands(self) -> bool:
        return self.revcom and not self.is_palindrome


def _hits(reads: DataFrame, k: int, targets: list[tuple[str | None, int]], d: int, keep: tuple[str, ...], own: str | None = None, place: str = "int") -> DataFrame:
    """A row for each window within d substitutions of a target, looked for where the codes are rolled: only hits leave the worker.
    Targets are (strand, code); without strands a window that is near to several targets is one hit."""
    stranded = targets[0][0] is not None

    def pick(_seqs: pa.Array, windows: Windows, _: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list]]:
        pos = windows.pos.astype(np.int32 if place == "int" else np.int64)
        if stranded:
            for strand, code in targets:
                chosen = np.flatnonzero(near(windows.code, code, d))
                yield chosen, [pa.array([strand] * len(chosen), pa.string()), pos[chosen]]
        else:
            chosen = np.flatnonzero(np.logical_or.reduce([near(windows.code, code, d) for _, code in targets]))
            yield chosen, [pos[chosen]]

    return per_tile(reads, k, keep, f"strand string, pos {place}" if stranded else f"pos {place}", pick, own)


def motif_match(reads: DataFrame, motif: Motif, *keep: str) -> DataFrame:
    """seq_no, strand, pos."""
    return _hits(reads, motif.k, [("+", motif.code), *([("-", motif.rc_code)] if motif.two_strands else [])], motif.d, ("seq_no", *keep))


def match_tiles(tiles: DataFrame, motif: Motif) -> DataFrame:
    """chrom, strand, pos (in the chromosome) from tiles cut with a halo of k - 1 bases at least."""
    rows = _hits(tiles, motif.k, [("+", motif.code), *([("-", motif.rc_code)] if motif.two_strands else [])], motif.d, ("chrom", "tile_start"), "own", "long")
    return rows.select("chrom", "strand", (F.col("tile_start") + F.col("pos")).alias("pos"))


def scan(reads: DataFrame, motif: Motif) -> DataFrame:
    """seq_no, pos; a place where both strands match appears once."""
    return _hits(reads, motif.k, [(None, motif.code), *([(None, motif.rc_code)] if motif.revcom else [])], motif.d, ("seq_no",))


def segments_of(k: int, n: int) -> list[tuple[int, int]]:
    """k bases in n segments as equal as can be: (bases behind the segment, bases in it)."""
    cuts = [k * i // n for i in range(n + 1)]
    return [(k - b, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment(code: Column, behind: int, size: int) -> Column:
    return F.shiftrightunsigned(code, 2 * behind).bitwiseAND(F.lit(mask_of(size)))


def motif_seeds(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """A row for each segment of each motif's codes: motif_id, k, d, part, seed, target. Of a window within d substitutions of the
    target, one of d + 1 segments is that of the target."""
    rows = []
    for i, m in enumerate(motifs, 1):
        for target in {m.code, m.rc_code} if m.revcom else {m.code}:
            for part, (behind, size) in enumerate(segments_of(m.k, m.d + 1)):
                rows.append((i, m.k, m.d, part, (target >> (2 * behind)) & ((1 << (2 * size)) - 1), target))
    return spark.createDataFrame(rows, "motif_id int, k int, d int, part int, seed long, target long")


def scan_motifs(reads: DataFrame, motifs: list[Motif]) -> DataFrame:
    """seq_no, motif_id, pos for any number of motifs, by an index of seeds: windows and motifs meet where they have a segment in common
    (an equi-join with the user's list, d + 1 rows for each motif and strand), and only those that meet are compared. A pair that meets
    in several segments counts in the first one. Motifs that are as short as their substitutions allow meet everywhere, as they must."""
    if not motifs:
        raise ValueError("no motifs")
    spark = reads.sparkSession
    parts = None
    for k, d in sorted({(m.k, m.d) for m in motifs}):
        if d >= k:
            raise ValueError("the number of substitutions must be less than the motif's length")
        seeds = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), segment(F.col("code"), *x).alias("seed")) for i, x in enumerate(segments_of(k, d + 1)))))
        rows = kmer_codes(reads, k).select("seq_no", "pos", "code", seeds.alias("s"))
        wanted = F.broadcast(motif_seeds(spark, motifs).where((F.col("k") == k) & (F.col("d") == d)))  # the user's list of motifs
        met = rows.select("seq_no", "pos", "code", "s.part", "s.seed").join(wanted, ["part", "seed"]).where(hamming(F.col("code"), F.col("target")) <= d)
        x = F.col("code").bitwiseXOR(F.col("target"))
        earlier = F.lit(False)
        for i, (behind, size) in enumerate(segments_of(k, d + 1)[:-1]):
            earlier = earlier | ((F.col("part") > i) & (segment(x, behind, size) == 0))
        rows = met.where(~earlier).select("seq_no", "motif_id", "pos", "target", "code")
        parts = rows if parts is None else parts.unionByName(rows)
    # A window near to both strands of a motif is one hit: the one that belongs to the lower target of those it is near to.
    both = [(i, m.code, m.rc_code, m.d) for i, m in enumerate(motifs, 1) if m.revcom and m.code != m.rc_code and bin(_differing(m.code ^ m.rc_code)).count("1") <= 2 * m.d]
    if both:
        again = F.broadcast(spark.createDataFrame([(i, max(a, b), min(a, b), d) for i, a, b, d in both], "motif_id int, target long, lower long, d int"))
        parts = parts.join(again, ["motif_id", "target"], "left").where(F.col("lower").isNull() | (hamming(F.col("code"), F.col("lower")) > F.col("d")))
    return parts.select("seq_no", "motif_id", "pos")


def _differing(x: int) -> int:
    return (x | (x >> 1)) & LOW_BITS


def scan_lists(hits: DataFrame) -> DataFrame:
    """seq_no, motif_id, positions (ascending)."""
    return hits.groupBy("seq_no", "motif_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def with_hits(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """The reads with at least one hit."""
    return reads.join(hits.select("seq_no").distinct(), "seq_no", "left_semi")


def ball_of(counts: DataFrame, motif: Motif) -> DataFrame:
    """The members (code) of the ball of which the member or its reverse complement was counted, with the count n to
    weigh them by: both strands' count, or the own one for a palindrome or a single strand."""
    own = counts.select("code", "n", F.lit(True).alias("own"))
    if motif.two_strands:
        other = counts.select(revcom_code(F.col("code"), motif.k).alias("code"), "n", F.lit(False).alias("own"))
        palindrome = F.col("code") == revcom_code(F.col("code"), motif.k)
        own = own.unionByName(other.where(~palindrome))
    near = own.where(hamming(F.col("code"), F.lit(motif.code)) <= motif.d)
    return near.groupBy("code").agg(F.sum("n").alias("n"))


def motif_matrix(counts: DataFrame, motif: Motif) -> DataFrame:
    """pos (0: first base), A, C, G, T: how often each base stands there in the motif's members."""
    from ..functions.codec import decode

    members = ball_of(counts, motif).select(decode(F.col("code"), motif.k).alias("kmer"), "n")
    letters = members.select(F.posexplode(F.array(*(F.substring("kmer", i + 1, 1) for i in range(motif.k)))).alias("pos", "base"), "n")
    pivoted = letters.groupBy("pos").pivot("base", list("ACGT")).agg(F.sum("n"))
    return pivoted.select("pos", *(F.coalesce(b, F.lit(0)).cast("long").alias(b) for b in "ACGT"))


def long_matrix(matrix: DataFrame) -> DataFrame:
    """pos, base, cnt."""
    return matrix.select("pos", F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("cnt")) for b in "ACGT"))).alias("x")).select("pos", "x.base", "x.cnt")


def revcom_matrix(matrix: DataFrame, k: int) -> DataFrame:
    """The matrix of the other strand."""
    return matrix.select((F.lit(k - 1) - F.col("pos")).alias("pos"), F.col("T").alias("A"), F.col("G").alias("C"), F.col("C").alias("G"), F.col("A").alias("T"))


def weights(matrix: DataFrame) -> DataFrame:
    """pos, base, cnt, pfm (shares, after a small pseudo-count), pwm (shares times 2 - entropy)."""
    at = Window.partitionBy("pos")
    rows = long_matrix(matrix).withColumn("pfm", (F.col("cnt") + F.lit(PSEUDO)) / F.sum(F.col("cnt") + F.lit(PSEUDO)).over(at))
    entropy = -F.sum(F.col("pfm") * F.log2("pfm")).over(at)
    return rows.withColumn("pwm", (F.lit(2.0) - entropy) * F.col("pfm"))


def bin_of(x: Column) -> Column:
    """The bin of a place on [0, 1] among 100 with edges i * 0.01 in floating point; the last bin holds its upper edge."""
    i = F.floor(x * F.lit(100.0)).cast("int")
    i = i + F.when(x >= (i + 1) * F.lit(0.01), 1).otherwise(0) - F.when(x < i * F.lit(0.01), 1).otherwise(0)
    return F.least(i, F.lit(BINS - 1)).cast("int")


def placed_hits(reads: DataFrame, motif: Motif, *keep: str) -> DataFrame:
    """The rows of ``motif_match`` with the length of the sequence."""
    return motif_match(reads.withColumn("length", F.length("seq")), motif, "length", *keep)


def position_histogram(placed: DataFrame, k: int, *by: str) -> DataFrame:
    """strand, bin, n of hits with the length of their sequence."""
    return placed.groupBy(*by, "strand", bin_of(relative_position(F.col("pos"), F.col("length"), k)).alias("bin")).agg(F.count("*").alias("n"))


def located(reads: DataFrame, motifs: Motif | dict, by: str | None = None) -> DataFrame:
    """seq_no (and ``by``), length, fwd, rev: for every sequence the places of its hits on each strand, from one pass; what is worked out from
    sites can be taken from this table, so that sequences are scanned once. With ``by`` each of its values has a motif of its own; sequences
    with another value have no hits."""
    first = [reads.schema["seq_no"], *([reads.schema[by]] if by else [])]
    places = T.ArrayType(T.IntegerType())
    shape = T.StructType([*first, T.StructField("length", T.IntegerType()), T.StructField("fwd", places), T.StructField("rev", places)])
    every = motifs if by else {None: motifs}
    bound_batches(reads.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(len(first))
            value = np.array(batch.column(1).to_pylist(), object) if by else np.full(batch.num_rows, None, object)
            found: list[list[np.ndarray]] = [[], []]
            for k in {m.k for m in every.values()}:
                for windows in rolled(seqs, k):
                    for own, motif in every.items():
                        if motif.k == k:
                            mine = value[windows.row] == own if by else np.ones(len(windows.row), bool)
                            for strand, code in enumerate([motif.code, *([motif.rc_code] if motif.two_strands else [])]):
                                hit = mine & near(windows.code, code, motif.d)
                                found[strand].append(np.stack([windows.row[hit], windows.pos[hit]]))
            lists = []
            for parts in found:
                row, pos = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
                order = np.argsort(row, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
                lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pos[order].astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(first))), pc.fill_null(pc.binary_length(seqs), 0).cast(pa.int32()), *lists], shape.names)

    return reads.select(*(x.name for x in first), "seq").mapInArrow(run, shape)


def sites_of(where: DataFrame, *by: str) -> DataFrame:
    """seq_no, n_fwd, n_rev from ``located``."""
    return where.select("seq_no", *by, F.size("fwd").alias("n_fwd"), F.size("rev").alias("n_rev"))


def placed_of(where: DataFrame, *by: str) -> DataFrame:
    """seq_no, length, strand, pos from ``located``."""
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("fwd").alias("pos")), F.struct(F.lit("-").alias("strand"), F.col("rev").alias("pos"))))
    return where.select("seq_no", *by, "length", strands.alias("x")).select("seq_no", *by, "length", "x.strand", F.explode("x.pos").alias("pos"))


def site_counts(reads: DataFrame, motif: Motif) -> DataFrame:
    """seq_no, n_fwd, n_rev for every sequence, counted in its batch: no join, no shuffle."""
    return sites_of(located(reads, motif))


def motif_stats(sites: DataFrame, *by: str) -> DataFrame:
    """n_seq; sequences with forward, reverse, either, both kinds of sites, their percentages; ff: the share of
    sequences with several forward sites among those with any; fr: of those with both strands among those with either."""
    fwd, rev = F.col("n_fwd") > 0, F.col("n_rev") > 0
    rows = (sites.groupBy(*by) if by else sites).agg(F.count("*").alias("n_seq"), F.count_if(fwd).alias("n_fwd_seq"), F.count_if(rev).alias("n_rev_seq"), F.count_if(fwd | rev).alias("n_either_seq"), F.count_if(fwd & rev).alias("n_both_seq"), F.count_if(F.col("n_fwd") > 1).alias("n_repeat_seq"), F.coalesce(F.sum("n_fwd"), F.lit(0)).cast("long").alias("n_fwd_hits"), F.coalesce(F.sum("n_rev"), F.lit(0)).cast("long").alias("n_rev_hits"))
    percent = lambda c: F.round(F.try_divide(F.col(c).cast("double") * 100, F.col("n_seq").cast("double")), 2)
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return rows.select(*by, "n_seq", "n_fwd_seq", "n_rev_seq", "n_either_seq", "n_both_seq", "n_fwd_hits", "n_rev_hits", percent("n_fwd_seq").alias("fwd_percent"), percent("n_rev_seq").alias("rev_percent"), percent("n_either_seq").alias("either_percent"), share("n_repeat_seq", "n_fwd_seq").alias("ff"), share("n_both_seq", "n_either_seq").alias("fr"))


def cooccurrence(sites: DataFrame) -> DataFrame:
    """n_fwd, n_rev, n (sequences), without (0, 0); and the percentage of all sequences that have a site."""
    every = sites.groupBy("n_fwd", "n_rev").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over the few distinct pairs
    some = F.sum(F.when((F.col("n_fwd") > 0) | (F.col("n_rev") > 0), F.col("n")).otherwise(0)).over(whole)
    rows = every.withColumn("percent", F.round(some * F.lit(100.0) / F.sum("n").over(whole), 1))
    return rows.where((F.col("n_fwd") > 0) | (F.col("n_rev") > 0))


def position_density(histogram: DataFrame) -> DataFrame:
    """strand, point (0 to 999), x, density: each strand's histogram smoothed by a Gaussian of 5 bins and scaled to the
    strand's share of all hits. Worked out from at most 200 rows."""
    points = F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1)))
    x = F.col("point") * F.lit(float(BINS)) / F.lit(float(POINTS - 1))
    spread = histogram.select("strand", "bin", "n", points.alias("point")).withColumn("x", x)
    kernel = F.exp(-F.pow(F.col("x") - F.col("bin"), 2) / F.lit(2 * SIGMA * SIGMA)) / F.lit(SIGMA * (2 * 3.141592653589793) ** 0.5)
    smooth = spread.groupBy("strand", "point", "x").agg(F.sum(F.col("n") * kernel).alias("y"), F.sum("n").alias("hits"))
    strand, whole = Window.partitionBy("strand"), Window.partitionBy("point")
    total = F.sum("hits").over(whole)
    rows = smooth.withColumn("share", F.col("hits") / total).withColumn("sum_y", F.sum("y").over(strand))
    return rows.select("strand", "point", "x", (F.col("share") * F.col("y") / F.when(F.col("sum_y") == 0, F.lit(1.0)).otherwise(F.col("sum_y"))).alias("density"))
