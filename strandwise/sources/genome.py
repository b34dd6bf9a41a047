"""Chromosomes as tiles, and requests for windows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fasta import parse_records
from .scratch import stored

TILE = 1 << 20
#: X in X.fa*, or in a folder of that name with one file.
CHROMOSOME = r"([^/]+)\.fa[^/]*(?:/[^/]+)?$"


def tiles(chromosomes: DataFrame, tile: int = TILE, halo: int = 0) -> DataFrame:
    """(chrom, seq) -> (chrom, tile, tile_start, seq, length): long sequences in parts of ``tile`` bases. With a halo, parts go on for so many
    bases of the next ones, and ``own`` says how many bases are the tile's own: what starts in them is the tile's to find."""
    # One pass along the sequence; asking for each tile by its place would walk from the start again and again.
    cut = F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{tile + halo}}})).{{1,{tile}}}"), F.lit(1)) if halo else F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    parts = F.when(F.length("seq") > 0, cut).otherwise(F.array("seq"))
    rows = chromosomes.select("chrom", F.length("seq").cast("long").alias("length"), F.posexplode(parts).alias("tile", "seq"))
    rows = rows.select("chrom", F.col("tile").cast("long").alias("tile"), (F.col("tile").cast("long") * tile).alias("tile_start"), "seq", "length")
    return rows.withColumn("own", F.least(F.col("length") - F.col("tile_start"), F.lit(tile).cast("long"))) if halo else rows


def read_reference(spark: SparkSession, folder: str, tile: int = TILE, halo: int = 0) -> DataFrame:
    """Tiles of all chromosomes in a folder: chromosome X is the last record of a file X.fa*, or of a folder of that name that
    holds one file. Which record is the last is known from a first pass; its row for each chromosome is sent to the records, which stay where
    they are, as long as Spark's broadcast limit allows."""
    raw = spark.read.option("lineSep", "\n>").text(f"{folder}/*.fa*")
    name = F.regexp_extract(F.input_file_name(), CHROMOSOME, 1)
    place = F.monotonically_increasing_id().alias("place")
    last = stored(raw.where(F.length(F.trim("value")) > 0).select(name.alias("chrom"), place).groupBy("chrom").agg(F.max("place").alias("place")), "last")
    rows = parse_records(raw, name.alias("chrom"), place)
    return tiles(rows.join(last, ["chrom", "place"], "left_semi").select("chrom", "seq"), tile, halo)


def read_windows(spark: SparkSession, path: str, col_name: int = 1, col_start: int = 2, col_end: int = 3) -> DataFrame:
    """(chrom, start, end) of a tab-separated file with a header line; columns are counted from 1."""
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    pick = [F.col(f"`{table.columns[i - 1]}`") for i in (col_name, col_start, col_end)]
    return table.select(pick[0].alias("chrom"), pick[1].cast("long").alias("start"), pick[2].cast("long").alias("end"))
