"""Counts and results kept as Parquet, so that later queries need no recount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import MAX_K, checked, code_of, revcom_of

#: Bytes of a row group in memory: small, so that few k-mers need few bytes.
ROW_GROUP = 1 << 20
#: Conditions that a look-up pushes down to the files.
CONDITIONS = 64


def save_counts(counts: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """counts with a column k; a folder for each k. Within it the files and their row groups hold ranges of codes, in order, so a look-up reads the
    row groups of the codes it is for."""
    rows = counts.repartitionByRange("k", "code").sortWithinPartitions("k", "code")
    rows.write.mode("overwrite").option("parquet.block.size", row_group).partitionBy("k").parquet(path)


def load_counts(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Only the folder of k is read."""
    rows = spark.read.parquet(path)
    return rows if k is None else rows.where(F.col("k") == k)


def among(codes: list[int], conditions: int = CONDITIONS) -> Column:
    """A condition on the column code that files can check from the bounds of their row groups: one of the codes, or, for more codes than there may be
    conditions, in one of so many ranges around them."""
    codes = sorted(set(codes))
    size = max(-(-len(codes) // conditions), 1)
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    code = F.col("code")
    each = [code == p[0] if p[0] == p[-1] else (code >= p[0]) & (code <= p[-1]) for p in parts]
    return reduce(lambda a, b: a | b, each) if each else F.lit(False)


def query_saved(spark: SparkSession, path: str, kmers: list[str | None], k: int, on_bad: str = "error") -> DataFrame:
    """``operators.counts.query_kmers`` on saved counts: of the files of k only the row groups are read in which a k-mer of the list, or its reverse
    complement, may lie."""
    from ..operators.counts import kmer_list, query_kmers

    codes = []
    for kmer in kmers:
        try:
            found = checked(kmer, "k-mer") if kmer else ""
        except ValueError:
            continue  # query_kmers says what becomes of it
        if len(found) == k <= MAX_K:
            codes += [code_of(found), revcom_of(code_of(found), k)]
    return query_kmers(load_counts(spark, path, k).where(among(codes)), kmer_list(spark, kmers), k, on_bad)


def save_result(result: dict[str, DataFrame], path: str) -> None:
    for name, table in result.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_result(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
