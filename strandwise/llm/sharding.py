"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS places. Each shard stands at many of them (its virtual nodes), which follow from its number alone;
a document's place follows from its doc_id, and its home is the first node at or after that place. No shard takes more
bytes than its bound: what comes to a full shard goes on clockwise to the next node whose shard has room.
So sizes are near equal by construction, whatever the sizes of the documents, and when a shard is added only what the new nodes
take over, and what the lower bound pushes on, moves.

Documents are placed by cell: what shares a cell goes together, in the order of the cells' weights, the heaviest first, so that the
light ones fill the gaps. A pass over the documents gives the cells' weights: a number for each of at most CELLS cells, whatever the
number of documents, which is what the driver sees. A cell that weighs too much to be placed whole (one doc_id may hold
a third of all rows) is divided, evenly by the rows' own numbers, into as many parts as it weighs CELLS-ths of the whole. Slots are
prefix sums: rows are numbered within (part of the input, shard), and the parts' numbers are added up.

Null texts are empty; each row counts one byte more than its text. Repeated rows are rows of their own; rows with a null
doc_id are left out; further columns are not looked at; an empty table gives no rows. A single row is never divided, so a shard
may exceed its bound where one row does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stored

SHARDS = 16
#: Places of the ring.
CELLS = 1 << 15
#: Virtual nodes of each shard.
NODES = 128
#: A shard's bound is so much above the mean.
SLACK = 0.0001


def cell_of(doc_id: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(cells)).cast("int")


def ring_of(shards: int, cells: int = CELLS, nodes: int = NODES) -> tuple[list[int], list[int]]:
    """The places of all virtual nodes, ascending, and whose they are. At a place that two shards chose stands the lower one."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            at.setdefault(int.from_bytes(hashlib.sha256(f"{shard}:{node}".encode()).digest()[:8], "big") % cells, shard)
    places = sorted(at)
    return places, [at[x] for x in places]


def place(weights: Sequence[tuple[int, int, int]], shards: int, cells: int = CELLS, nodes: int = NODES, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """(cell, part, weight) of all parts of cells -> (cell, part) -> shard."""
    places, owner = ring_of(shards, cells, nodes)
    total = sum(w for _, _, w in weights)
    bound = total * (1 + slack) / shards
    load, out = [0] * shards, {}
    for cell, part, weight in sorted(weights, key=lambda x: (-x[2], x[0], x[1])):
        home = bisect_left(places, cell)
        # Clockwise to the first node with room. A shard without room for this has none at its further nodes either.
        refused: set[int] = set()
        for step in range(len(places)):
            shard = owner[(home + step) % len(places)]
            if shard in refused:
                continue
            if load[shard] + weight <= bound:
                break
            refused.add(shard)
            if len(refused) == shards:
                break
        if len(refused) == shards:
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += weight
        out[cell, part] = shard
    return out


def shard(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, with_text: bool = False, cells: int = CELLS, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0 in each shard) and, if asked for, text."""
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    rows = documents(docs, number.alias("_row")).withColumn("size", F.octet_length("text").cast("long") + 1).withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))).withColumn("_cell", cell_of(F.col("doc_id"), cells))
    # Written once: the rows' numbers stay as they are when a task is run again.
    held = stored(rows if with_text else rows.drop("text"), "sharding")
    weights = {r["_cell"]: (r["size"], r["n"]) for r in held.groupBy("_cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}  # at most CELLS rows
    total = sum(size for size, _ in weights.values())
    # A shard has room for many parts of this weight, so the bound can be met closely.
    parts = {cell: min(-(-size * cells // total), n) for cell, (size, n) in weights.items() if n > 1 and size * shards * 64 > total}
    every = [(cell, 0, size) for cell, (size, _) in weights.items() if cell not in parts]
    divided = F.lit(0)
    if parts:
        # No more than 64 * shards cells are divided, into no more than CELLS + 64 * shards parts together.
        table = F.broadcast(spark.createDataFrame(list(parts.items()), "_cell int, _parts int"))
        held = held.join(table, "_cell", "left")
        divided = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0)).cast("int")
        found = held.where("_parts is not null").groupBy("_cell", divided.alias("_part")).agg(F.sum("size").alias("size")).collect()
        every += [(r["_cell"], r["_part"], r["size"]) for r in found]
    placed = [(cell, part, to) for (cell, part), to in place(every, shards, cells, nodes, slack).items()]
    table = F.broadcast(spark.createDataFrame(placed, "_cell int, _part int, shard int"))
    rows = held.withColumn("_part", divided).join(table, ["_cell", "_part"])
    # The upper bits of a row's number tell the part of the input that it came from, the lower ones its place there.
    rows = rows.withColumn("_input", F.shiftright("_row", 33))
    before = rows.groupBy("_input", "shard").agg(F.count("*").alias("_n"))
    before = before.select("_input", "shard", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_input")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_input", "shard").orderBy("_row")) - 1
    rows = rows.withColumn("_within", within).join(before, ["_input", "shard"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_within")).cast("long").alias("slot"), *(["text"] if with_text else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slack: float = SLACK, rows_per_file: int = 1_000_000) -> None:
    """The documents with their slots as Parquet, a folder for each shard, in files of so many rows at most."""
    found = shard(docs, shards, slack, with_text=True)
    found.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
