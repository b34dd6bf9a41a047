"""A folder for intermediate files that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, with a local master, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="strandwise-"))


def new_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/strandwise/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def clear() -> int:
    """Delete the working tables that this driver has written so far, and say how many. Results that still read from them must have been
    saved before; nothing else calls this, as only the caller knows when a lazy result is done with."""
    n = 0
    while _made:
        files, path = fs.FileSystem.from_uri(_made.pop() if "://" in _made[-1] else f"file://{_made.pop()}")
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)
            n += 1
    return n


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so the loss of an
    executor costs no recomputation of what is already written."""
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
