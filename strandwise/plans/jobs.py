"""Jobs from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.genome import extract_windows
from ..operators.intervals import motif_segments
from ..operators.masking import MotifMask, RepeatMask, mark_up, mask_chain
from ..operators.motifs import Motif, scan_motifs, with_hits
from ..sources.archive import manifest_size, read_manifest, read_records, record_table
from ..sources.fasta import read_fasta, write_fasta
from ..sources.genome import TILE, read_reference, read_windows
from ..sources.scratch import stored


def mask_file(spark: SparkSession, source: str, target: str, patterns: list[RepeatMask | MotifMask]) -> None:
    reads = mask_chain(read_fasta(spark, source), patterns)
    write_fasta(reads.withColumn("header", F.trim(F.concat_ws(" ", "seq_id", "description"))), target, 60, "header")


def scan_reads(reads: DataFrame, motifs: list[Motif], tags: dict[int, str] | None = None) -> dict[str, DataFrame]:
    """hits (seq_no, motif_id, pos), segments of the sequences with hits (label, motifs), and their marked-up text, for any number of
    motifs. tags: label -> tag; by default a piece is tagged with all motifs that cover it."""
    hits = stored(scan_motifs(reads, motifs), "hits")  # three tables are made from them
    some = with_hits(reads, hits)
    pieces = motif_segments(some, hits, {i: m.k for i, m in enumerate(motifs, 1)})
    return {"hits": hits, "segments": pieces, "marked": mark_up(some, pieces, tags)}


def scan_file(spark: SparkSession, source: str, motifs: list[Motif]) -> dict[str, DataFrame]:
    return scan_reads(read_fasta(spark, source, numbered=True), motifs)


def window_file(spark: SparkSession, table: str, folder: str, target: str, columns: tuple[int, int, int] = (1, 2, 3), tile: int = TILE, on_missing: str = "error") -> None:
    found = extract_windows(read_windows(spark, table, *columns), read_reference(spark, folder, tile), tile, on_missing)
    write_fasta(found.orderBy("chrom", "start", "end"), target, 50, "header")


def manifest(spark: SparkSession, report: str, records: str, kind: str, n: int | None = None) -> dict[str, DataFrame]:
    files = read_manifest(spark, report)
    return {"files": files, "size": manifest_size(files), "records": record_table(read_records(spark, records, kind), files, n)}
