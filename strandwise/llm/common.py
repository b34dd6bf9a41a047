"""What the text operators share: reading tables, shared working tables, settings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored

__all__ = ["documents", "few_files", "small_batches", "stored", "table", "text_key", "text_or_empty"]

#: Rows in an Arrow batch sent to Python; texts average a few KB, so a batch stays at a few MB.
ARROW_ROWS = 512
#: Bytes in such a batch, but for a single longer text.
ARROW_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, ...): null texts count as empty. A row whose doc_id is null is no document: it is left out,
    as no result could name it. All operators on documents read their rows through this."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def text_key() -> Column:
    """64 bits of the text. With the doc_id it tells rows apart that share the id; only such rows could be confused."""
    return F.xxhash64(text_or_empty())


def few_files(df: DataFrame, rows: int, in_file: int) -> DataFrame:
    """df, which has at most ``rows`` rows, in as many partitions as give each ``in_file`` of them, but for one on each core: a small working
    table becomes few files where adaptive coalescing is off or finds nothing to do. Each file that is written costs an executor a commit and, on
    file systems that set modes by a command, a process."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / in_file)))


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bound the memory of Python workers: few rows (unless fewer are set already) and bytes in each Arrow batch. These are settings
    of the session, and stay: a lazy result is worked out after this returns. They change no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
