"""Near-duplicates by min-max hashing.

Each permutation of the shingles' hashes gives two values, its minimum and its maximum, so a signature costs half the
evaluations. Four values make a band. Documents with equal shingle sets are one class and stand behind one
representative. Representatives that share a band are candidates; a candidate pair whose signatures agree in
too few values is dropped (the bound is five standard deviations below what similar sets show), and every other
one is confirmed on the full shingle sets.

No bucket is turned into all its pairs. In the first rounds a few pivots of each bucket, those among its documents that collide most
often, are compared with the members that are not yet in their component; then the components are formed anew, and
buckets within one component are done. That leaves, of a group of copies, the few members that no pivot is linked
with. In the last round the members outside a bucket's largest component are compared with all members of other
components, so every pair of candidates is either compared or already connected, and no link is lost. As many of
those pairs are nearly similar enough, a second signature of one bit for each of many values, made after the first
round and only for the documents that are still in question, sharpens the estimate before full sets are compared. In the last
round a pair is met in the first band that it shares.

A bucket may hold a third of all documents. Pivots come from aggregations with partial results; where members meet pivots or their bucket's
figures, large buckets are dealt over parts of about ``PART`` members, and the few rows on the other side go to every part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, few_files, small_batches, stored, text_key
from .components import components
from .text_kernel import U64, buffers, distinct_in_each, mix, shingles, word_hashes

ROWS = 4
#: Pivots of a bucket in the first rounds.
PIVOTS = (1, 8)
#: Members of a bucket that one join key holds, about.
PART = 1000
#: Values of the second signature (64 to a long), and standard deviations that an estimate may fall short.
SHARP, SHORT = 2048, 5.0
#: Chance to miss a pair just at the threshold, over all bands.
MISS = 1e-5
#: Classes sent to all executors at once, at most (24 bytes each); more go through a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows in a file: of ids, of rows with bands or signatures, of whole sets.
FILE_ROWS, WIDE_ROWS, SET_ROWS = 50_000, 5_000, 500
_numbers = np.random.Generator(np.random.PCG64(20240611))
MULTIPLIERS = _numbers.integers(1, 2**63, SHARP // 2, dtype=U64) * U64(2) + U64(1)
ADDENDS = _numbers.integers(0, 2**63, SHARP // 2, dtype=U64)


def n_bands(similarity: float) -> int:
    """Bands (an even number) that leave at most MISS."""
    return 2 * math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS) / 2)


def signatures(values: np.ndarray, at: np.ndarray, evaluations: int) -> np.ndarray:
    """(texts, 2 * evaluations): minima, then maxima. Every text must have at least one value."""
    out = np.empty((len(at) - 1, 2 * evaluations), U64)
    for j in range(evaluations):
        permuted = values * MULTIPLIERS[j] + ADDENDS[j]
        out[:, j] = np.minimum.reduceat(permuted, at[:-1])
        out[:, evaluations + j] = np.maximum.reduceat(permuted, at[:-1])
    return out


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_in_each(*shingles(*word_hashes(raw, off), size))


def sketch(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, h (key of the text), n (size of the set), k1 and k2 (128 bits that stand for the set), bands array<long>, sig array<long>
    (a byte of each value)."""
    bands = n_bands(similarity)
    evaluations = bands * ROWS // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = shingle_sets(*buffers(batch.column(1)), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            keys = np.zeros((2, len(n)), U64)
            band = np.zeros((len(n), bands), U64)
            sig = np.zeros((len(n), 2 * evaluations), np.uint8)
            if len(full):
                starts = np.concatenate([at[full], at[-1:]])
                for k in range(2):
                    keys[k, full] = np.add.reduceat(mix(values * U64(2 * k + 3)), starts[:-1])
                found = signatures(values, starts, evaluations)
                sig[full] = (found & U64(255)).astype(np.uint8)
                joined = found[:, 0::ROWS].copy()
                for i in range(1, ROWS):
                    joined = mix(joined * U64(0x9FB21C651E98DF25) + found[:, i::ROWS])
                band[full] = joined
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int64).ravel() if x.dtype == U64 else x.view("<i8").ravel()), w).cast(pa.list_(pa.int64())) for x, w in ((band, bands), (np.ascontiguousarray(sig), evaluations // 4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *(pa.array(k.astype(np.int64)) for k in keys), *lists], ["doc_id", "h", "n", "k1", "k2", "bands", "sig"])

    small_batches(docs.sparkSession)
    return documents(docs, text_key().alias("h")).mapInArrow(run, "doc_id long, h long, n long, k1 long, k2 long, bands array<long>, sig array<long>")


def agreeing(a: Column, b: Column, longs: int) -> Column:
    """In how many bytes two arrays of longs agree."""

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(8 * longs) - reduce(lambda x, y: x + y, [differing(i) for i in range(longs)])


def sharp_signatures(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, sharp array<long>): a bit of each of SHARP values, for the classes in ids (id, doc_id, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = shingle_sets(*buffers(batch.column(1)), size)
            # The lowest bit of a product is that of its factors, so a mixed value gives the bit.
            bits = np.packbits((mix(signatures(values, at, SHARP // 2)) & U64(1)).astype(np.uint8), axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(bits.ravel()), SHARP // 64).cast(pa.list_(pa.int64()))], ["id", "sharp"])

    small_batches(docs.sparkSession, 256)
    return only(docs, ids).mapInArrow(run, "id long, sharp array<long>").dropDuplicates(["id"])


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes in ids (id, doc_id, h), a table that is written: by broadcast while they are few, else by a shuffle. A class
    whose row repeats comes as often."""
    few = ids.count() <= BROADCAST_IDS
    return documents(docs, text_key().alias("h")).join(F.broadcast(ids) if few else ids, ["doc_id", "h"]).select("id", "text")


def same_bits(a: Column, b: Column) -> Column:
    differing = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SHARP // 64)]
    return F.lit(SHARP) - reduce(lambda x, y: x + y, differing)


def confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes (id, doc_id, h) with 100 * intersection >= percent * union of their full shingle sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = shingle_sets(*buffers(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    small_batches(docs.sparkSession, 256)
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = stored(few_files(classes.select("id", "doc_id", "h").join(needed, "id", "left_semi"), 2 * pairs.count(), FILE_ROWS), "ids")
    sets = stored(few_files(only(docs, ids).mapInArrow(make, "id long, set binary").dropDuplicates(["id"]), ids.count(), SET_ROWS), "sets")
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def parts_of(size: Column) -> Column:
    """How many parts a bucket of this size is dealt over."""
    return (F.floor(size / PART) + 1).cast("int")


def in_parts(members: DataFrame) -> DataFrame:
    """members (id, size) with the part of their bucket that they belong to."""
    return members.withColumn("part", F.pmod(F.xxhash64("id"), parts_of(F.col("size"))).cast("int"))


def to_every_part(few: DataFrame) -> DataFrame:
    """few (size) for each part of the bucket."""
    return few.withColumn("part", F.explode(F.sequence(F.lit(0), parts_of(F.col("size")) - 1)))


def pivots(members: DataFrame, upto: int) -> DataFrame:
    """Up to ``upto`` members of each bucket: the one that collides most often in each of as many shares of it."""
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(upto))
    rank = F.struct("degree", (-F.col("id")).alias("low"))
    best = members.groupBy("band", "key", share.alias("share")).agg(F.max(rank).alias("best"), F.max("size").alias("size"))
    chosen = to_every_part(best.select("band", "key", "size", (-F.col("best.low")).alias("id")))
    return members.drop("size").join(chosen.drop("size"), ["band", "key", "id"])


def classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, h, k1 and k2 (128 bits that stand for the set), n_shingles, component_id, and ``first``: whether the row's class stands for its component
    (it holds the smallest doc_id; of classes that share that id, the one with the smallest key)."""
    longs = n_bands(percent / 100) * ROWS // 8
    held = stored(sketch(docs, size, percent / 100), "sketch")
    classes = held.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.min_by(F.struct("bands", "sig"), F.struct("doc_id", "h")).alias("x"))
    # An id of its own for each class, as texts may share a doc_id; written once, so it doesn't change.
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "n", "least.doc_id", "least.h", "x.bands", "x.sig")
    classes = stored(few_files(classes, held.count(), WIDE_ROWS), "classes")

    placed = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    crowd = placed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    # Spark splits a partition that one bucket makes too large (adaptive skew join): crowd has one row for each.
    shared = stored(placed.hint("merge").join(crowd, ["band", "key"]).select("band", "key", "id", "n", "size"), "shared")
    degree = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    members = shared.join(degree, "id").join(classes.select("id", "sig"), "id").select("band", "key", "size", "id", "n", "degree", "sig")
    open_ = stored(few_files(members.withColumn("component", F.col("id")), shared.count(), WIDE_ROWS), "members")

    sd = math.sqrt(8 * longs * percent * (100 - percent)) / 100
    least = math.floor(8 * longs * percent / 100 - 5 * sd)
    alike = (F.col("m.n") * 100 >= F.col("p.n") * percent) & (F.col("p.n") * 100 >= F.col("m.n") * percent) & (agreeing(F.col("p.sig"), F.col("m.sig"), longs) >= least)
    before = (F.col("m.degree") < F.col("p.degree")) | ((F.col("m.degree") == F.col("p.degree")) & (F.col("m.id") > F.col("p.id")))
    share = (1 + percent / 100) / 2
    enough = math.floor(SHARP * share - SHORT * math.sqrt(SHARP * share * (1 - share)))
    first = F.coalesce(*(F.when(F.get("p.bands", F.lit(i)) == F.get("m.bands", F.lit(i)), F.lit(i)) for i in range(n_bands(percent / 100))))
    place = ["band", "key", "part"]
    same_part = (F.col("p.band") == F.col("m.band")) & (F.col("p.key") == F.col("m.key")) & (F.col("p.part") == F.col("m.part"))
    links, labels = None, None
    for turn, upto in enumerate((*PIVOTS, None)):
        if open_.isEmpty():
            break
        if turn == 1:
            # From here on pairs are often nearly similar enough.
            rows = open_.count()
            asked = classes.join(open_.select("id").distinct(), "id", "left_semi")
            asked = stored(few_files(asked.select("id", "doc_id", "h"), rows, FILE_ROWS), "ids")
            more = sharp_signatures(docs, asked, size).join(classes.select("id", "bands"), "id")
            open_ = stored(few_files(open_.join(more, "id"), rows, WIDE_ROWS), "sharp")
            alike = alike & (same_bits(F.col("p.sharp"), F.col("m.sharp")) >= enough)
        if upto is None:
            # Members outside their bucket's largest component; of two such members the earlier one is the pivot.
            parts = open_.groupBy("band", "key", "component").agg(F.count("*").alias("c"), F.max("size").alias("size"))
            largest = parts.groupBy("band", "key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.max("size").alias("size"))
            rows = in_parts(open_).join(to_every_part(largest).drop("size"), place).withColumn("outside", F.col("component") != F.col("largest"))
            p, m = to_every_part(rows.where("outside").drop("part")).alias("p"), rows.alias("m")
            chosen = (~F.col("m.outside") | before) & (first == F.col("p.band"))
        else:
            p, m = pivots(open_, upto).alias("p"), in_parts(open_).alias("m")
            chosen = F.lit(True)
        met = p.join(m, same_part & (F.col("p.component") != F.col("m.component")) & chosen & alike)
        pairs = stored(met.select(F.least("p.id", "m.id").alias("a"), F.greatest("p.id", "m.id").alias("b")).distinct(), "pairs")
        found = stored(confirm(docs, classes, pairs, size, percent), "confirmed")
        links = found if links is None else links.union(found)
        labels = components(links)
        if upto is None:
            break
        now = open_.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = now.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("size").alias("size")).where("low <> high")
        open_ = stored(few_files(in_parts(now).join(to_every_part(mixed).select(place), place).drop("part"), open_.count(), WIDE_ROWS), "members")

    of_class = classes.select("k1", "k2", "n", "id", F.struct("doc_id", "h").alias("own"))
    if labels is not None:
        of_class = of_class.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least_of = of_class.groupBy("component").agg(F.min("own").alias("lowest"))
        of_class = of_class.join(least_of, "component")
    else:
        of_class = of_class.withColumn("lowest", F.col("own"))
    of_class = of_class.select("k1", "k2", "n", F.col("lowest.doc_id").alias("component_id"), (F.col("own") == F.col("lowest")).alias("first"))
    rows = held.select("doc_id", "h", "k1", "k2", "n").join(of_class, ["k1", "k2", "n"], "left")
    return rows.select("doc_id", "h", "k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself
    included), kept (doc_id = component_id). size: words of a shingle; percent: least similarity of a link.

    Words are runs of anything but ASCII white space, with A-Z as a-z. A text with fewer words than a shingle is
    one shingle; null texts and texts without words have none and are linked with nothing. Repeated rows share
    their class; different texts that share a doc_id are linked only if they are alike. An empty table gives no rows."""
    rows = classified(docs, size, percent)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component. A row is told by its doc_id and text; of
    repeated rows one stays, as does one of the texts of one doc_id that have the same shingles."""
    keep = classified(docs, size, percent).where("first and doc_id = component_id").groupBy(F.col("doc_id").alias("key"), "k1", "k2", "n_shingles").agg(F.min("h").alias("h")).select("key", "h")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("key"), text_key().alias("h"), F.struct("*").alias("row"))
    return rows.join(keep, ["key", "h"], "left_semi").dropDuplicates(["key", "h"]).select("row.*")
