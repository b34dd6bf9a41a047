"""Intervals on sequences, half-open, as rows (seq_no, start, end).

Sequences may be as long as chromosomes, so intervals are cut at the borders of tiles of TILE bases and every tile is swept
by itself; only the pieces that touch a border, at most two for each tile, are put together along the whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16
#: Motifs whose bits fit a label.
BITS = 62


def hit_windows(hits: DataFrame, k: int, *by: str) -> DataFrame:
    return hits.select("seq_no", *by, F.col("pos").cast("long").alias("start"), (F.col("pos") + k).cast("long").alias("end"))


def _in_tiles(windows: DataFrame, tile: int) -> DataFrame:
    """Each window once for every tile that it reaches into, cut off at the tile's borders."""
    reached = F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))
    rows = windows.where("start < end").withColumn("tile", F.explode(reached))
    return rows.withColumns({"start": F.greatest("start", F.col("tile") * tile), "end": F.least("end", (F.col("tile") + 1) * tile)})


def _stitched(pieces: DataFrame, keys: list[str], same: list[str], tile: int) -> DataFrame:
    """pieces (keys, start, end, same...), disjoint: those that meet at a tile's border and are alike in ``same`` become one."""
    at_border = ((F.col("start") > 0) & (F.col("start") % tile == 0)) | (F.col("end") % tile == 0)
    columns = [*keys, "start", "end", *same]
    order = Window.partitionBy(*keys).orderBy("start")
    goes_on = F.col("start") == F.lag("end").over(order)
    for c in same:
        goes_on = goes_on & F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = pieces.where(at_border).withColumn("_new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.first(c).alias(c) for c in same))
    return pieces.where(~at_border).select(columns).unionByName(joined.select(columns))


def merge_windows(windows: DataFrame, *by: str, tile: int = TILE) -> DataFrame:
    """Disjoint windows for each sequence (and ``by``); overlapping and touching ones become one, empty ones are left out."""
    keys = ["seq_no", *by]
    order = Window.partitionBy(*keys, "tile").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = _in_tiles(windows.select(*keys, "start", "end"), tile).withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "tile", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return _stitched(merged, keys, [], tile)


def _sweep(windows: DataFrame, marks: list[str], tile: int) -> DataFrame:
    """windows (seq_no, start, end, marks...) -> the pieces between the places where the sum of some mark changes, with the sums;
    only what a window covers."""
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), *((F.col(m) * sign).alias(m) for m in marks), F.lit(sign).alias("open"))
    edges = _in_tiles(windows, tile).select("seq_no", "tile", F.explode(F.array(edge("start", 1), edge("end", -1))).alias("x")).select("seq_no", "tile", "x.*")
    places = edges.groupBy("seq_no", "tile", "at").agg(*(F.sum(c).alias(c) for c in (*marks, "open")))
    order = Window.partitionBy("seq_no", "tile").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = places.select("seq_no", "tile", "at", *(F.sum(c).over(running).alias(c) for c in (*marks, "open")))
    # Neighbours with the same sums are one piece; the place where nothing is open any more always stays.
    same = F.lag("open").over(order) > 0
    for m in marks:
        same = same & (F.lag(m).over(order) == F.col(m))
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)) & (F.col("open") > 0)).where(~F.col("_same"))
    pieces = rows.withColumn("end", F.lead("at").over(order)).where("open > 0 and end is not null")
    pieces = pieces.select("seq_no", F.col("at").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *marks)
    return _stitched(pieces, ["seq_no"], marks, tile)


def label_pieces(windows: DataFrame, tile: int = TILE) -> DataFrame:
    """windows: (seq_no, label, start, end), disjoint for each label, labels 1, 2, 4 and so on. -> pieces (seq_no, start,
    end, label) that some window covers, labelled by the sum of those that do: 1 the first only, 2 the second, 3 both."""
    return _sweep(windows.select("seq_no", "start", "end", "label"), ["label"], tile).where("label > 0")


def _whole(reads: DataFrame, marks: list[str]) -> DataFrame:
    """A window of no mark over each sequence."""
    none = [F.lit(0).cast("long").alias(m) for m in marks]
    return reads.select("seq_no", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), *none)


def segments(reads: DataFrame, windows: DataFrame, tile: int = TILE) -> DataFrame:
    """Pieces that cover each sequence of ``reads`` exactly, label 0 where no window lies. windows: as in ``label_pieces``, within
    the sequences."""
    rows = windows.select("seq_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("label").cast("long").alias("label"))
    return _sweep(_whole(reads, ["label"]).unionByName(rows), ["label"], tile)


def motif_segments(reads: DataFrame, hits: DataFrame, lengths: dict[int, int], tile: int = TILE) -> DataFrame:
    """Segments of the hits of any number of motifs: hits (seq_no, motif_id, pos), lengths: motif_id (from 1) -> length. ``motifs``: the
    ids that cover a piece, ascending; label: the sum of 2 ** (motif_id - 1) over them, null where there are more than BITS motifs."""
    size = F.create_map(*(x for i, k in lengths.items() for x in (F.lit(i), F.lit(k))))
    rows = hits.select("seq_no", "motif_id", F.col("pos").cast("long").alias("start"), (F.col("pos") + size[F.col("motif_id")]).cast("long").alias("end"))
    most = max(lengths, default=1)
    words = [f"w{i}" for i in range(-(-most // BITS))]  # a number of BITS bits each
    bit = F.pmod(F.col("motif_id") - 1, F.lit(BITS)).cast("int")
    marks = [F.when(F.floor((F.col("motif_id") - 1) / BITS) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)]
    merged = merge_windows(rows, "motif_id", tile=tile).select("seq_no", "start", "end", *marks)
    pieces = _sweep(_whole(reads, words).unionByName(merged), words, tile)

    def ids(i: int) -> Column:
        first = i * BITS + 1
        return F.filter(F.sequence(F.lit(first), F.lit(min(most, first + BITS - 1))), lambda x: F.getbit(F.col(words[i]), (x - first).cast("int")) == 1)

    label = F.col("w0") if len(words) == 1 else F.lit(None).cast("long")
    return pieces.select("seq_no", "start", "end", label.alias("label"), F.concat(*map(ids, range(len(words)))).alias("motifs"))
