"""Windows cut out of tiled chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.genome import TILE


def extract_windows(windows: DataFrame, tiles: DataFrame, tile: int = TILE, on_missing: str = "error") -> DataFrame:
    """windows (chrom, start, end; any further columns are kept) with header chrom|start|end and seq: the bases
    [start, end), upper case, cut off at the chromosome's end. A window asks for the tiles it spans, by an equi-join on
    (chrom, tile); its parts are put together in order. Windows of chromosomes that are not there raise an error,
    or are left out (on_missing="skip")."""
    if on_missing != "skip":
        missing = windows.select("chrom").distinct().join(tiles.select("chrom").distinct(), "chrom", "left_anti")
        if names := [r.chrom for r in missing.limit(5).collect()]:
            raise ValueError(f"no such chromosome: {', '.join(map(str, names))}")
    start, end = F.greatest("start", F.lit(0)), F.greatest("end", F.lit(0))
    key = ["chrom", "start", "end"]
    spans = windows.select(*key, start.alias("s"), end.alias("e")).where("s < e").distinct()
    wanted = spans.select(*key, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / tile), F.floor((F.col("e") - 1) / tile))).alias("tile"))
    met = wanted.join(tiles, ["chrom", "tile"])
    first = F.greatest(F.col("s") - F.col("tile_start"), F.lit(0))
    last = F.least(F.col("e") - F.col("tile_start"), F.lit(tile).cast("long"))
    part = F.upper(F.col("tiles_seq").substr((first + 1).cast("int"), (last - first).cast("int")))
    met = met.withColumnRenamed("seq", "tiles_seq")
    whole = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tile", part.alias("part")))).alias("parts"))
    there = windows if on_missing != "skip" else windows.join(tiles.select("chrom").distinct(), "chrom", "left_semi")
    out = there.join(whole, key, "left").withColumn("header", F.concat_ws("|", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    seq = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return out.withColumn("seq", F.coalesce(seq, F.lit(""))).drop("parts")
