"""Count once, discover many motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import canonical, kmer_of, mutation_limit
from ..operators.counts import merge_revcom
from ..operators.kmers import contain_motif, sub_kmers
from ..operators.superkmers import count_ks
from ..sources.scratch import stored
from ..sources.store import load_counts


def count_range(reads: DataFrame, kmin: int, kmax: int, path: str, beyond: int = 4) -> None:
    """Counts (of occurrences) for every k from kmin to kmax + beyond, in a folder for each k: one pass over the reads, one shuffle, one job."""
    count_ks(reads, list(range(kmin, kmax + beyond + 1))).write.mode("overwrite").partitionBy("k").parquet(path)


#: Pairs of k-mers whose sums the driver follows from turn to turn.
LEADERS = 4096
#: Motifs whose K-mers are left out by a condition, before what is left is written anew.
CONDITIONS = 4


class Sums:
    """Sums over the k-mers inside the K-mers left, kept up while K-mers are removed.

    The sums are worked out once, undivided. A removal is a small table of what to subtract. Sums only shrink, so the pairs that lead are
    followed on the driver, LEADERS at most, and are certain as long as one of them is above all that were not among them; then the leaders
    are drawn anew from the sums and the removals."""

    def __init__(self, left: DataFrame, k: int, big_k: int, revcom: bool) -> None:
        self.k, self.places, self.big_k, self.revcom = k, big_k - k + 1, big_k, revcom
        self.parts = [self.within(left)]
        self._draw()

    def within(self, kmers: DataFrame) -> DataFrame:
        return stored(kmers.select(F.explode(sub_kmers(F.col("code"), self.big_k, self.k)).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n")), "sums")

    def _draw(self) -> None:
        """The pairs with the largest counts, and the count that no other pair exceeds."""
        first, *less = self.parts
        for part in less:
            first = first.unionByName(part.withColumn("n", -F.col("n")))
        if less:
            first = stored(first.groupBy("code").agg(F.sum("n").alias("n")), "sums")
            self.parts = [first]
        low = canonical(F.col("code"), self.k) if self.revcom else F.col("code")
        value = F.expr(f"n div {self.places}")
        pairs = first.groupBy(low.alias("low")).agg(F.sum(value).alias("value"), F.collect_list(F.struct("code", "n")).alias("members"))  # at most two
        rows = pairs.orderBy(F.desc("value"), "low").limit(LEADERS + 1).collect()
        self.floor = rows[LEADERS].value if len(rows) > LEADERS else 0
        self.pairs = {r.low: [m.code for m in r.members] for r in rows[:LEADERS]}
        self.sums = {m.code: m.n for r in rows[:LEADERS] for m in r.members}

    def remove(self, kmers: DataFrame) -> None:
        part = self.within(kmers)
        self.parts.append(part)
        known = self._table()
        for r in part.join(F.broadcast(known), "code").collect():  # at most two for each leader
            self.sums[r.code] -= r.n

    def _table(self) -> DataFrame:
        spark = self.parts[0].sparkSession
        return spark.createDataFrame([(c,) for c in self.sums], "code long")

    def best(self) -> tuple[int, int] | None:
        """(code, count) of the most frequent pair, ties by the lower code."""
        found = self._lead()
        if len(self.parts) > 1 and (found is None or found[1] <= self.floor):
            self._draw()
            found = self._lead()
        return found if found and found[1] > 0 else None

    def _lead(self) -> tuple[int, int] | None:
        counts = ((sum(self.sums[c] // self.places for c in members), low) for low, members in self.pairs.items())
        n, low = max(counts, key=lambda x: (x[0], -x[1]), default=(0, None))
        return None if low is None else (low, n)


def find_motifs(counts: DataFrame, big_counts: DataFrame, k: int, big_k: int, top_k: int, d: int | None = None, revcom: bool = True) -> list[tuple[str, int, int]]:
    """(k-mer, its count, K-mers left) for up to ``top_k`` motifs: take the most frequent k-mer, drop the K-mers that contain
    it (strands merged), work the counts of k-mers out from the K-mers left. After the first turn the counts are kept up (``Sums``): a turn takes
    apart the K-mers that it removes, and no others."""
    d = mutation_limit(k) if d is None else d
    left = stored((merge_revcom(big_counts, big_k) if revcom else big_counts).select("code", "n"), "left")
    n_left, without, sums = left.count(), F.lit(True), None
    found: list[tuple[str, int, int]] = []
    for turn in range(top_k):
        if turn == 0:
            row = (merge_revcom(counts, k) if revcom else counts).orderBy(F.desc("n"), "code").first()
            best = None if row is None else (row.code, row.n)
        else:
            best = sums.best()
        if best is None:
            break
        inside = contain_motif(F.col("code"), big_k, kmer_of(best[0], k), d, revcom)
        removed = stored(left.where(without & inside), "removed")
        n_left -= removed.count()
        found.append((kmer_of(best[0], k), best[1], n_left))
        without = without & ~inside
        if turn % CONDITIONS == CONDITIONS - 1:
            left, without = stored(left.where(without), "left"), F.lit(True)
        if turn + 1 < top_k:
            if sums is None:
                sums = Sums(left.where(without), k, big_k, revcom)
            else:
                sums.remove(removed)
    return found


def discover(spark: SparkSession, path: str, k: int, big_k: int, top_k: int, d: int | None = None, revcom: bool = True) -> list[tuple[str, int, int]]:
    """As ``find_motifs``, from saved counts; only the two folders are read."""
    return find_motifs(load_counts(spark, path, k), load_counts(spark, path, big_k), k, big_k, top_k, d, revcom)
