"""An index of where the records of FASTA files lie, so that windows and tiles of chromosomes are read from their bytes alone.

All lines of a record but the last must be of one length, as for any such index; what is read is checked for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .genome import CHROMOSOME, TILE
from .ranges import BLOCK, blocks, files_of, header_parts, opened, ranges_of

INDEX = "file string, place long, seq_id string, offset long, line_bases long, line_bytes long, last_end long"


def _starts(uri: str, start: int, end: int) -> Iterator[tuple]:
    """(file, place of the ">", seq_id, place of the bases, bases and bytes of their first line) of the records that begin in a range. Bases are passed over
    in blocks; none is kept."""
    first = max(start - 1, 0)
    rest = b"" if start else b"\n"  # a ">" at the file's start begins a line
    at = first - len(rest)
    for data in chain(blocks(uri, first), [b""]):
        buffer, x, scanned = rest + data, -1, 0
        while (x := buffer.find(b"\n>", scanned)) >= 0:
            if at + x + 1 >= end:
                return
            header_end = buffer.find(b"\n", x + 2)
            line_end = buffer.find(b"\n", header_end + 1) if header_end >= 0 else -1
            if line_end < 0 and data:
                break  # its first lines go on in the next block
            header_end = len(buffer) if header_end < 0 else header_end
            line = buffer[header_end + 1 : len(buffer) if line_end < 0 else line_end]
            line = b"" if line[:1] == b">" else line
            yield uri, at + x + 1, header_parts(buffer[x + 2 : header_end])[0], at + header_end + 1, len(line.rstrip()), len(line) + 1
            scanned = x + 1
        keep = x if x >= 0 else max(len(buffer) - 1, 0)
        rest, at = buffer[keep:], at + keep


def _bases_end(uri: str, size: int) -> int:
    """Where the file's last line ends, without its break."""
    tail = next(blocks(uri, max(size - 4096, 0)), b"")
    return size - (len(tail) - len(tail.rstrip()))


def index_fasta(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """A row for each record of the plain files that a path names: file, seq_id, offset (byte of its first base), line_bases, line_bytes, length. The files'
    names and sizes are listed by the driver; their bytes are passed over once, in splits."""
    found = files_of(path)
    if packed := [x.uri for x in found if x.uri.endswith(".gz")]:
        raise ValueError(f"compressed files have no index: {packed[:3]}")
    ranges = [(x.uri, x.size, a, b) for x in found for a, b in ranges_of(x, split)]
    tasks = max(1, min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, len(ranges) // 16)))
    table = spark.createDataFrame(ranges, "file string, size long, first long, last long").repartition(tasks, "file", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for uri, size, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := list(_starts(uri, first, last)):
                    end = _bases_end(uri, size)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*(row + (end,) for row in rows), strict=True)], names)

    rows = table.mapInArrow(run, INDEX)
    # The bases end before the break in front of the next record, or with the file.
    after = F.lead("place").over(Window.partitionBy("file").orderBy("place")) - (F.col("line_bytes") - F.col("line_bases"))
    size = F.greatest(F.coalesce(after, F.col("last_end")) - F.col("offset"), F.lit(0).cast("long"))
    length = F.expr("_size div line_bytes") * F.col("line_bases") + F.least(F.col("_size") % F.col("line_bytes"), F.col("line_bases"))
    return rows.withColumn("_size", size).withColumn("length", F.when(F.col("line_bases") > 0, length).otherwise(0).cast("long")).select("file", "seq_id", "offset", "line_bases", "line_bytes", "length")


def chromosomes_of(index: DataFrame) -> DataFrame:
    """Of each file the last record, by the name that the file has: chrom, and the columns of the index."""
    last = index.groupBy("file").agg(F.max_by(F.struct(*(c for c in index.columns if c != "file")), "offset").alias("x"))
    return last.select(F.regexp_extract("file", CHROMOSOME, 1).alias("chrom"), "file", "x.*")


def fetch(wanted: DataFrame) -> DataFrame:
    """Rows of an index with start and end, and any further columns -> these rows with seq, upper case, and n_bytes, what was read for it.

    start and end must lie in the record. Rows are dealt by file and place, so each task reads forward through few files."""
    keep = wanted.columns
    rows = wanted.withColumn("_at", F.col("offset") + F.col("start")).repartitionByRange("file", "_at", "end").sortWithinPartitions("file", "_at").drop("_at")
    shape = T.StructType([*rows.schema.fields, T.StructField("seq", T.StringType()), T.StructField("n_bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in ("file", "offset", "line_bases", "line_bytes", "start", "end")}
            seqs, read, first, held = [], [], 0, 0
            for i in range(batch.num_rows):
                start, end, bases, wide = of["start"][i], of["end"][i], of["line_bases"][i], of["line_bytes"][i]
                if of["file"][i] != uri:
                    uri = of["file"][i]
                    system, path = opened(uri)
                    file = system.open_input_file(path)
                if end <= start:
                    seqs.append("")
                    read.append(0)
                    continue
                a = start // bases * wide + start % bases
                b = (end - 1) // bases * wide + (end - 1) % bases + 1
                data = np.frombuffer(file.read_at(b - a, of["offset"][i] + a), np.uint8)
                inside = (np.arange(a, b) % wide) < bases
                if len(data) < b - a or not (data[inside] > 32).all() or not (data[~inside] <= 32).all():
                    raise ValueError(f"{uri}: lines of different lengths at byte {of['offset'][i] + a}")
                seqs.append(data[inside].tobytes().upper().decode())
                read.append(b - a)
                held += b - a
                if held > 4 * BLOCK:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, i + 1 - first).columns, pa.array(seqs), pa.array(read, pa.int64())], shape.names)
                    first, seqs, read, held = i + 1, [], [], 0
            if seqs:
                yield pa.RecordBatch.from_arrays([*batch.slice(first).columns, pa.array(seqs), pa.array(read, pa.int64())], shape.names)

    return rows.mapInArrow(run, shape).select(*keep, "seq", "n_bytes")


def fetch_windows(windows: DataFrame, chromosomes: DataFrame, on_missing: str = "error") -> DataFrame:
    """As ``operators.genome.extract_windows``, from the index: windows (chrom, start, end; further columns are kept) with header, seq and n_bytes,
    what was read for the window. The bytes read are those of the distinct windows, whatever the size of the chromosomes."""
    if on_missing != "skip":
        missing = windows.select("chrom").distinct().join(chromosomes.select("chrom"), "chrom", "left_anti")
        if names := [r.chrom for r in missing.limit(5).collect()]:
            raise ValueError(f"no such chromosome: {', '.join(map(str, names))}")
    # Each window is read once, however many rows ask for it.
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("length")).cast("long")
    asked = windows.select("chrom", F.col("start").alias("_start"), F.col("end").alias("_end")).distinct().join(chromosomes.select("chrom", "file", "offset", "line_bases", "line_bytes", "length"), "chrom")
    found = fetch(asked.withColumn("start", inside("_start")).withColumn("end", inside("_end")))
    header = F.concat_ws("|", "chrom", F.col("_start").cast("string"), F.col("_end").cast("string")).alias("header")
    parts = found.select("chrom", F.col("_start").alias("start"), F.col("_end").alias("end"), header, "seq", "n_bytes")
    return windows.join(parts, ["chrom", "start", "end"]).select(*windows.columns, "header", "seq", "n_bytes")


def fetch_tiles(chromosomes: DataFrame, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Tiles of chromosomes (``sources.genome.tiles``), each read from its own bytes: no task holds a chromosome."""
    n = F.greatest(F.ceil(F.col("length") / tile), F.lit(1))
    rows = chromosomes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("tile")).withColumn("tile_start", F.col("tile") * tile)
    found = fetch(rows.withColumn("start", F.col("tile_start")).withColumn("end", F.least(F.col("tile_start") + tile + halo, F.col("length"))))
    out = found.select("chrom", "tile", "tile_start", "seq", "length")
    return out.withColumn("own", F.least(F.col("length") - F.col("tile_start"), F.lit(tile).cast("long"))) if halo else out
