"""Counting k-mers over a whole collection, and what is worked out from counts.

A table of counts has the columns k, code, kmer, n. Grouping is on the code, 8 bytes; the k-mer's letters are worked out
from it after the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import canonical, check_k, code_of, decode, encode, hamming, revcom_code, revcom_of
from .kmers import batch_counts, is_motif, kmer_codes, sequence_counts, sequence_sizes, sub_kmers


def counts_per_sequence(reads: DataFrame, k: int) -> DataFrame:
    """seq_no, kmer, n. Counted in the sequence's batch: no shuffle."""
    return sequence_counts(reads, k).select("seq_no", decode(F.col("code"), k).alias("kmer"), "n")


def count_kmers(reads: DataFrame, k: int, unique: bool = True, *by: str) -> DataFrame:
    """k, code, kmer, n (with ``by`` in front). unique: in how many sequences a k-mer occurs; else how often in all.

    Repeats within a sequence are dropped inside its batch, so the only shuffle is that of the partial counts."""
    counted = batch_counts(reads, k, unique, *by).groupBy(*by, "code").agg(F.sum("n").alias("n"))
    return counted.select(*by, F.lit(k).alias("k"), "code", decode(F.col("code"), k).alias("kmer"), "n")


def totals(reads: DataFrame, k: int, *by: str) -> DataFrame:
    """n_seq and n_total_kmer (occurrences). Windows are counted where the codes are rolled; no k-mer leaves the worker."""
    rows = sequence_sizes(reads, k, *by)
    return (rows.groupBy(*by) if by else rows).agg(F.coalesce(F.sum("n_seq"), F.lit(0)).alias("n_seq"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total_kmer"))


def collection_summary(reads: DataFrame, k: int) -> DataFrame:
    """One row: n_seq, n_total_kmer, n_distinct_kmer."""
    none = F.lit(0).cast("long")
    rows = totals(reads, k).withColumn("n_distinct_kmer", none).unionByName(count_kmers(reads, k).agg(none.alias("n_seq"), none.alias("n_total_kmer"), F.count("*").alias("n_distinct_kmer")))
    return rows.agg(*(F.sum(c).alias(c) for c in ("n_seq", "n_total_kmer", "n_distinct_kmer")))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several parts of a collection, added up."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("k", "code", "kmer").agg(F.sum("n").alias("n"))


def merge_revcom(counts: DataFrame, k: int, keep_lower: bool = True, drop_unpaired: bool = False) -> DataFrame:
    """k, code, kmer, n with one row for both strands. drop_unpaired: leave out pairs of which only the strand that
    isn't shown was counted."""
    canon = canonical(F.col("code"), k, keep_lower)
    rows = counts.select(canon.alias("canon"), "n", (F.col("code") == canon).alias("own"))
    out = rows.groupBy("canon").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    if drop_unpaired:
        out = out.where("own")
    return out.select(F.lit(k).alias("k"), F.col("canon").alias("code"), decode(F.col("canon"), k).alias("kmer"), "n")


def strand_pairs(counts: DataFrame, k: int, *by: str) -> DataFrame:
    """A row for each pair of strands: code and kmer of the shown member (larger own count, then lower code), rc_kmer, n, rc_n,
    pair_n (a palindrome counts once), canon. One aggregation on the lower code; no join of a table with itself."""
    canon = canonical(F.col("code"), k)
    rows = counts.select(*by, canon.alias("canon"), (F.col("code") == canon).alias("low"), "n")
    both = rows.groupBy(*by, "canon").agg(F.sum(F.when(F.col("low"), F.col("n")).otherwise(0)).alias("low_n"), F.sum(F.when(~F.col("low"), F.col("n")).otherwise(0)).alias("high_n"))
    other = revcom_code(F.col("canon"), k)
    swap = F.col("high_n") > F.col("low_n")
    shown = F.when(swap, other).otherwise(F.col("canon"))
    palindrome = other == F.col("canon")
    pair_n = F.col("low_n") + F.col("high_n")
    hidden = F.when(swap, F.col("canon")).otherwise(other)
    return both.select(*by, F.lit(k).alias("k"), "canon", shown.alias("code"), decode(shown, k).alias("kmer"), decode(hidden, k).alias("rc_kmer"), F.greatest("low_n", "high_n").alias("n"), F.when(palindrome, F.col("low_n")).otherwise(F.least("low_n", "high_n")).alias("rc_n"), pair_n.alias("pair_n"), palindrome.alias("is_palindrome"))


def pair_counts(counts: DataFrame, k: int) -> DataFrame:
    """Every counted k-mer with the count of both its strands: k, code, kmer, n, pair_n."""
    merged = merge_revcom(counts, k).select(F.col("code").alias("canon"), F.col("n").alias("pair_n"))
    return counts.withColumn("canon", canonical(F.col("code"), k)).join(merged, "canon").select("k", "code", "kmer", "n", "pair_n")


def convert_counts(counts: DataFrame, big_k: int, k: int) -> DataFrame:
    """Counts of k-mers from counts of K-mers: summed over the k-mers inside, then divided by how many there are."""
    rows = counts.select(F.explode(sub_kmers(F.col("code"), big_k, k)).alias("code"), "n")
    share = rows.groupBy("code").agg(F.sum("n").alias("n")).select("code", F.expr(f"n div {big_k - k + 1}").alias("n"))
    return share.where("n > 0").select(F.lit(k).alias("k"), "code", decode(F.col("code"), k).alias("kmer"), "n")


def hamming_distances(counts: DataFrame, consensus: str, revcom: bool = True) -> DataFrame:
    """k-mer, n, dist: differing bases to the consensus, or to its reverse complement if that is nearer."""
    own = code_of(consensus)
    near = hamming(F.col("code"), F.lit(own))
    if revcom:
        near = F.least(near, hamming(F.col("code"), F.lit(revcom_of(own, len(consensus)))))
    return counts.select("kmer", "n", near.alias("dist"))


def hamming_profile(counts: DataFrame, consensus: str, revcom: bool = True) -> DataFrame:
    """dist, n_kmers, n."""
    return hamming_distances(counts, consensus, revcom).groupBy("dist").agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n"))


def observed_ball(counts: DataFrame, consensus: str, d: int) -> DataFrame:
    """The counted k-mers within d substitutions of the consensus."""
    return counts.where(hamming(F.col("code"), F.lit(code_of(consensus))) <= d)


def without_motif(counts: DataFrame, consensus: str, d: int, revcom: bool = True) -> DataFrame:
    """Counts without the k-mers of a motif, to look for the next one."""
    return counts.where(~is_motif(F.col("code"), consensus, d, revcom))


def kept_kmers(counts: DataFrame) -> DataFrame:
    return counts.where("n > 0")


def query_kmers(counts: DataFrame, wanted: DataFrame, k: int, on_bad: str = "error") -> DataFrame:
    """For each k-mer of ``wanted`` (kmer, in either case): its count, its reverse complement and that one's count, both together,
    whether it is a palindrome. Absent k-mers have 0. Entries that are null, have other letters than A, C, G, T or not k of
    them raise, or have nulls for all figures (on_bad="null"). The list is the user's, so it is small; beyond Spark's broadcast
    limit the joins shuffle."""
    upper = F.upper(F.trim("kmer"))
    asked = wanted.select(upper.alias("kmer"), F.when(F.length(upper) == k, encode(upper)).alias("code")).withColumn("rc_code", revcom_code(F.col("code"), k))
    if on_bad != "null" and (bad := asked.where("code is null").limit(5).collect()):
        raise ValueError(f"k-mers of the list must be {k} letters A, C, G, T, which {[r.kmer for r in bad]} are not")
    own = counts.select("code", F.col("n"))
    other = counts.select(F.col("code").alias("rc_code"), F.col("n").alias("rc_n"))
    figure = lambda c: F.when(F.col("code").isNotNull(), F.coalesce(c, F.lit(0))).alias(c)
    rows = asked.join(own, "code", "left").join(other, "rc_code", "left").select("kmer", figure("n"), decode(F.col("rc_code"), k).alias("rc_kmer"), figure("rc_n"))
    palindrome = F.col("kmer") == F.col("rc_kmer")
    return rows.select("kmer", "n", "rc_kmer", "rc_n", F.when(palindrome, F.col("n")).otherwise(F.col("n") + F.col("rc_n")).alias("pair_n"), palindrome.alias("is_palindrome"))


def subtract_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """What a has more than b, where positive."""
    less = b.select("code", F.col("n").alias("less"))
    return a.join(less, "code", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).where("n > 0").select("k", "code", "kmer", "n")


def top_kmers(counts: DataFrame, k: int, m: int = 6, revcom: bool = True, strict: bool = False) -> DataFrame:
    """The m most frequent k-mers, or pairs of strands. Ties go to the lower code. strict: at least 2m k-mers must have
    been counted."""
    if strict and counts.limit(2 * m).count() < 2 * m:
        raise ValueError(f"fewer than {2 * m} k-mers")
    if revcom:
        return strand_pairs(counts, k).orderBy(F.desc("pair_n"), "canon").limit(m).select("k", "code", "kmer", "rc_kmer", "n", "rc_n", "pair_n", "is_palindrome")
    return counts.orderBy(F.desc("n"), "code").limit(m).select("k", "code", "kmer", "n")


def first_seen(reads: DataFrame, k: int) -> DataFrame:
    """code, seq_no, pos of the first occurrence of each k-mer, for ties by order of appearance."""
    rows = kmer_codes(reads, k).select("code", F.struct("seq_no", "pos").alias("at"))
    return rows.groupBy("code").agg(F.min("at").alias("at")).select("code", "at.seq_no", "at.pos")


def top_kmers_first_seen(reads: DataFrame, counts: DataFrame, k: int, m: int = 6) -> DataFrame:
    """As ``top_kmers`` for pairs, but ties go to the pair seen first, and of a pair the member seen first is shown, if its own
    count is at least half the mth pair's."""
    pairs = strand_pairs(counts, k).select("canon", "pair_n", "is_palindrome")
    seen = counts.join(first_seen(reads, k), "code").select("code", "n", F.struct("seq_no", "pos").alias("at"), canonical(F.col("code"), k).alias("canon"))
    early = seen.groupBy("canon").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "code", "n"))).alias("members"))  # at most two
    best = pairs.join(early, "canon").orderBy(F.desc("pair_n"), "at").limit(m)
    least = F.min("pair_n").over(Window.partitionBy()) / 2
    strong = F.filter("members", lambda x: x["n"] >= F.col("least"))
    shown = F.coalesce(F.get(strong, F.lit(0)), F.get("members", F.lit(0)))
    rows = best.withColumn("least", least).select(shown.alias("x"), "pair_n", "is_palindrome")
    return rows.select("x.code", decode(F.col("x.code"), k).alias("kmer"), "x.n", "pair_n", "is_palindrome")


def consensus(counts: DataFrame, k: int, revcom: bool = True) -> str | None:
    """The most frequent k-mer."""
    row = top_kmers(counts, k, 1, revcom).first()
    return None if row is None else row.kmer


def one_strand(ranked: DataFrame, k: int, rank: Column) -> DataFrame:
    """Of a k-mer and its reverse complement only the one that comes first by ``rank``."""
    turn = F.row_number().over(Window.partitionBy(canonical(F.col("code"), k)).orderBy(rank))
    return ranked.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def sample_kmers(counts: DataFrame, k: int, top: DataFrame, n: int = 800, seed: int = 0) -> DataFrame:
    """The top k-mers, then n more by hash of the code: a sample that is the same in every run; one of each pair of strands.
    -> code, kmer, ord (top ones first: a blank sorts before all hashes)."""
    chance = F.md5(F.concat(F.lit(f"{seed}:"), F.col("code").cast("string")))  # a hash that other engines have too
    some = counts.select("code", "kmer", chance.alias("ord")).orderBy("ord", "code").limit(n)
    first = top.select("code", "kmer", F.concat(F.lit(" "), F.lpad(F.row_number().over(Window.orderBy(F.desc("pair_n"), "code")).cast("string"), 9, "0")).alias("ord"))  # a handful of rows
    return one_strand(first.unionByName(some), k, F.col("ord"))


def round_totals(reads: DataFrame, k: int) -> DataFrame:
    """round, n_seq, n_total_kmer."""
    return totals(reads, k, "round")


def round_frequencies(counts: DataFrame, round_totals: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """For each chosen k-mer (code) and round: pair_n, frequency (by the round's occurrences), log_odds. Rounds without the k-mer
    count 0."""
    from ..functions.codec import trend

    pairs = chosen.select(canonical(F.col("code"), k).alias("canon"), F.col("kmer")).dropDuplicates(["canon"])
    seen = counts.select("round", canonical(F.col("code"), k).alias("canon"), "n").join(pairs.select("canon"), "canon", "left_semi").groupBy("round", "canon").agg(F.sum("n").alias("pair_n"))
    # Rounds are the user's few files; every chosen k-mer gets a row for each.
    rounds = F.array(*(F.struct(F.lit(r.round).alias("round"), F.lit(r.n_total_kmer).alias("n_total_kmer")) for r in round_totals.select("round", "n_total_kmer").collect()))
    grid = pairs.select("canon", "kmer", F.explode(rounds).alias("r")).select("canon", "kmer", "r.round", "r.n_total_kmer")
    rows = grid.join(seen, ["canon", "round"], "left").withColumn("pair_n", F.coalesce("pair_n", F.lit(0)))
    frequency = F.coalesce(F.try_divide(F.col("pair_n").cast("double"), F.col("n_total_kmer").cast("double")), F.lit(0.0))
    return rows.select("kmer", "round", "pair_n", frequency.alias("frequency"), trend(frequency).alias("log_odds"))


def kmer_list(spark: SparkSession, wanted: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in wanted], "kmer string")
