"""Motif discovery in one collection of reads, and over the rounds of an enrichment experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import motifs as M
from ..sources.scratch import stored


def analyse(reads: DataFrame, k: int, m: int = 6, n_max_mutation: int = 2, revcom: bool = True, unique: bool = True) -> dict[str, DataFrame]:
    """Everything about one k: counts, totals, top, and, around the most frequent k-mer, profile, matrix, weights, histogram,
    density, sites, cooccurrence, stats. Reads are passed over twice, to count and to find the sites of the motif; counts and sites are written to
    the shared folder, from where all tables take them."""
    counts = stored(C.count_kmers(reads, k, unique), "counts")
    out = {"counts": counts, "totals": C.totals(reads, k), "top": C.top_kmers(counts, k, m, revcom)}
    best = C.consensus(counts, k, revcom)
    if best is None:
        return out
    motif = M.Motif.of(best, n_max_mutation, revcom)
    return out | around(stored(M.located(reads, motif), "sites"), counts, motif)


def around(where: DataFrame, counts: DataFrame, motif: M.Motif) -> dict[str, DataFrame]:
    """The tables about a motif from its sites (``operators.motifs.located``) and the counts."""
    sites, matrix = M.sites_of(where), M.motif_matrix(counts, motif)
    histogram = M.position_histogram(M.placed_of(where), motif.k)
    return {"profile": C.hamming_profile(counts, motif.consensus, motif.revcom), "matrix": matrix, "weights": M.weights(matrix), "histogram": histogram, "density": M.position_density(histogram), "sites": sites, "cooccurrence": M.cooccurrence(sites), "stats": M.motif_stats(sites)}


def chipseq(reads: DataFrame, kmin: int, kmax: int, m: int = 6, n_max_mutation: int = 2, revcom: bool = True, unique: bool = True) -> DataFrame:
    """A row for each k: the consensus with its counts, and the statistics of its motif. One job for each k keeps a shuffle
    to the k-mers of one length."""
    out = None
    for k in range(kmin, kmax + 1):
        found = analyse(reads, k, m, n_max_mutation, revcom, unique)
        if "stats" not in found:
            continue
        first = found["top"].limit(1)
        head = first.select(F.lit(k).alias("k"), F.col("kmer").alias("consensus"), *([F.col("n"), F.col("rc_n"), F.col("pair_n")] if revcom else [F.col("n"), F.lit(0).cast("long").alias("rc_n"), F.col("n").alias("pair_n")]))
        rows = head.join(found["stats"].withColumn("k", F.lit(k)), "k")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no k-mer of any of these lengths")
    return out


def _rounds(reads: DataFrame, k: int, n_max_mutation: int, revcom: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, M.Motif]]:
    """Counts by round, the best k-mer of each round, the sites of its motif in the round's reads, and the motifs. Two passes over the reads, whatever the
    number of rounds; the driver sees a row for each round."""
    counts = stored(C.count_kmers(reads, k, True, "round"), "counts")
    if revcom:
        ranked = C.strand_pairs(counts, k, "round").withColumn("turn", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("pair_n"), "canon")))
    else:
        ranked = counts.select("*", F.lit(0).cast("long").alias("rc_n"), F.col("n").alias("pair_n")).withColumn("turn", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("n"), "code")))
    best = stored(ranked.where("turn = 1").select("round", F.col("kmer").alias("consensus"), "n", "rc_n", "pair_n"), "best")
    motifs = {r["round"]: M.Motif.of(r.consensus, n_max_mutation, revcom) for r in best.collect()}
    return counts, best, stored(M.located(reads, motifs, "round"), "sites"), motifs


def selex(reads: DataFrame, k: int, n_max_mutation: int = 2) -> DataFrame:
    """reads with a column round -> a row for each round: consensus and motif statistics. All rounds are counted by one shuffle on
    (round, code), and their sites found in one pass."""
    _, best, where, _ = _rounds(reads, k, n_max_mutation)
    return best.join(M.motif_stats(M.sites_of(where, "round"), "round"), "round")


def selex_tables(reads: DataFrame, kmin: int, kmax: int, m: int = 6, n_max_mutation: int = 2, revcom: bool = True) -> dict[tuple[int, int], dict[str, DataFrame]]:
    """(round, k) -> the tables of ``analyse`` for the reads of that round: counts, totals, top, and, around its most frequent k-mer, profile,
    matrix, weights, histogram, density, sites, cooccurrence, stats. For each k the reads of all rounds are counted together and scanned together."""
    rounds = [r["round"] for r in reads.select("round").distinct().orderBy("round").collect()]  # the user's few rounds
    out = {}
    for k in range(kmin, kmax + 1):
        every, _, where, motifs = _rounds(reads, k, n_max_mutation, revcom)
        totals = stored(C.round_totals(reads, k), "totals")
        for r in rounds:
            of = lambda frame, r=r: frame.where(F.col("round").eqNullSafe(F.lit(r))).drop("round")
            counts = of(every)
            out[r, k] = {"counts": counts, "totals": of(totals), "top": C.top_kmers(counts, k, m, revcom)}
            if r in motifs:
                out[r, k] |= around(of(where), counts, motifs[r])
    return out


def selex_table(tables: dict[tuple[int, int], dict[str, DataFrame]], name: str) -> DataFrame:
    """One of the tables of ``selex_tables`` for all rounds and k together, with columns round and k."""
    out = None
    for (r, k), found in tables.items():
        if name in found:
            rows = found[name].withColumns({"round": F.lit(r), "k": F.lit(k)})
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no round has a table {name}")
    return out


def selex_range(reads: DataFrame, kmin: int, kmax: int, n_max_mutation: int = 2) -> DataFrame:
    """The rows of ``selex`` for each k of a range, with a column k."""
    out = None
    for k in range(kmin, kmax + 1):
        rows = selex(reads, k, n_max_mutation).withColumn("k", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def selex_trend(reads: DataFrame, k: int, m: int = 6, n_sample: int = 800, seed: int = 0) -> DataFrame:
    """How the last round's top k-mers, and a sample of its others, fare over the rounds: kmer, round, pair_n, frequency,
    log_odds."""
    counts = stored(C.count_kmers(reads, k, True, "round"), "counts")
    totals = C.round_totals(reads, k)
    last = reads.agg(F.max("round").alias("r")).first().r
    late = counts.where(F.col("round") == last).drop("round")
    chosen = C.sample_kmers(late, k, C.top_kmers(late, k, m), n_sample, seed)
    return C.round_frequencies(counts, totals, chosen, k)
