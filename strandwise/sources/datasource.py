"""FASTA and FASTQ as data sources: ``spark.read.format("fasta").load(path)``, ``spark.readStream.format("fastq").load(folder)``.

Register them once with ``register(spark)``. Plain files are split by bytes (option splitSize), and a split takes the records that begin in it, so
records stay whole and in order; .gz files are read as one. Either kind of line break and any white space behind a record's name will do.
Options: path (as Spark's, without commas), splitSize (bytes, 64 MB).

A stream takes each batch the files that have changed since the last one, in order of time and name, at most maxFilesPerTrigger of them
(1000); a file must be put in place at the time it has, so not by renaming a file that is older than others already taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .ranges import Found, batched, fasta_records, fastq_records, files_of, header_parts, ranges_of

SPLIT = 64 << 20


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int) -> None:
        self.uri, self.start, self.end = uri, start, end


class Reading:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str], quality: bool) -> None:
        # Options come in lower case or as they were written.
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("load() needs a path")
        self.path, self.split, self.quality = given["path"], int(given.get("splitsize", SPLIT)), quality
        self.most = int(given.get("maxfilespertrigger", 1000))

    def splits(self, files: list[Found]) -> list[Range]:
        return [Range(x.uri, a, b) for x in files for a, b in ranges_of(x, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fields = [("file", pa.string()), ("offset", pa.int64()), ("seq_id", pa.string()), ("description", pa.string()), ("seq", pa.string())]
        schema = pa.schema([*fields, *([("qual", pa.string())] if self.quality else [])])

        def fasta() -> Iterator[tuple]:
            for place, record in fasta_records(partition.uri, partition.start, partition.end):
                header, _, body = record.partition(b"\n")
                yield (partition.uri, place, *header_parts(header), body.translate(None, b" \t\r\n\v\f>").upper().decode(errors="replace"))

        def fastq() -> Iterator[tuple]:
            for place, (header, seq, qual) in fastq_records(partition.uri, partition.start, partition.end):
                yield (partition.uri, place, *header_parts(header), seq.strip().upper().decode(errors="replace"), qual.strip().decode(errors="replace"))

        yield from batched(fastq() if self.quality else fasta(), schema, 4)


class BatchReader(Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.splits(files_of(self.path))


class StreamReader(Reading, DataSourceStreamReader):
    """An offset is the latest time of the files taken, and the names of those that have it."""

    def initialOffset(self) -> dict:
        return {"time": -1, "names": []}

    def _after(self, start: dict) -> list[Found]:
        try:
            files = files_of(self.path)
        except FileNotFoundError:
            return []
        return sorted((x for x in files if x.changed > start["time"] or (x.changed == start["time"] and x.uri not in start["names"])), key=lambda x: (x.changed, x.uri))

    def latestOffset(self) -> dict:
        self.reached = getattr(self, "reached", None) or self.initialOffset()
        for x in self._after(self.reached)[: self.most]:
            self.reached = {"time": x.changed, "names": [*(self.reached["names"] if x.changed == self.reached["time"] else []), x.uri]}
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.reached = max(getattr(self, "reached", None) or end, end, key=lambda x: (x["time"], len(x["names"])))
        return self.splits([x for x in self._after(start) if x.changed < end["time"] or (x.changed == end["time"] and x.uri in end["names"])])

    def commit(self, end: dict) -> None:
        pass


class FastaSource(DataSource):
    """file, offset (of the record in the file, in bytes), seq_id, description, seq."""

    quality = False

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, offset long, seq_id string, description string, seq string" + (", qual string" if self.quality else "")

    def reader(self, schema: object) -> BatchReader:
        return BatchReader(dict(self.options), self.quality)

    def streamReader(self, schema: object) -> StreamReader:
        return StreamReader(dict(self.options), self.quality)


class FastqSource(FastaSource):
    """The same, and qual, of records of four lines."""

    quality = True

    @classmethod
    def name(cls) -> str:
        return "fastq"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(FastqSource)
