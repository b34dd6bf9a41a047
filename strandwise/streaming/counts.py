"""Counts kept up to date as new sequence files arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.codec import decode
from ..operators.kmers import batch_counts
from ..sources.fasta import parse_records


def stream_fasta(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """seq_id, description, seq of the FASTA files of a folder, as they arrive."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_records(raw)


def stream_counts(reads: DataFrame, k: int, unique: bool = True) -> DataFrame:
    """Running counts: k, code, kmer, n. The state holds a row for each k-mer seen, at most 4 ** k; it never expires, so
    for large k keep it in RocksDB (``state_in_rocksdb``)."""
    counted = batch_counts(reads, k, unique).groupBy("code").agg(F.sum("n").alias("n"))
    return counted.select(F.lit(k).alias("k"), "code", decode(F.col("code"), k).alias("kmer"), "n")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB on the executors' disks, with a log of its changes in the checkpoint. A stream takes its settings when
    it starts, so the session's are put back."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def follow(reads: DataFrame, k: int, path: str, checkpoint: str, unique: bool = True) -> DataStreamWriter:
    """Running counts as state: with each batch the k-mers whose counts have changed are written, with their counts as they are now, under the
    batch's number, so a batch that is run again after a failure replaces its own. A stream that is stopped goes on from its checkpoint."""

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream_counts(reads, k, unique).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", checkpoint)


def followed(spark: SparkSession, path: str) -> DataFrame:
    """k, code, kmer, n as of the last batch."""
    rows = spark.read.parquet(path)
    return rows.groupBy("k", "code", "kmer").agg(F.max_by("n", "batch").alias("n"))


def write_counts(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataStreamWriter:
    """A writer to an in-memory table, for small k and tests."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)


def accumulate(reads: DataFrame, k: int, path: str, checkpoint: str, unique: bool = True) -> DataStreamWriter:
    """Each batch's counts are appended as Parquet under its batch id, so a batch that is run again replaces its own; readers add
    the batches up (``operators.counts.merge_counts``). No state is kept between batches."""
    from ..operators.counts import count_kmers

    def append(batch: DataFrame, batch_id: int) -> None:
        count_kmers(batch, k, unique).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return reads.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
