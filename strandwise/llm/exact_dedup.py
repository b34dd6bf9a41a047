"""Exact deduplication with a cuckoo-filter index.

A digest of the text without white space decides. Every input partition first merges its own rows (so that
a text which makes up a third of all rows reaches the next step once for each partition), then the digests
go to buckets of about ``BUCKET`` digests, which a task works on one after the other. Each bucket has a cuckoo filter of its live digests
and the stored keys: a filter hit is verified against the bucket's keys, a miss needs no look at them; a full
filter is built anew, larger, from the stored keys.

``ExactIndex`` keeps filters and live rows between batches, both in buckets. Documents are inserted and deleted by ``maintain``: the filters tell
which digests can be live at all, only those are looked up among the live rows; only buckets that changes fall into are read and rewritten, and the
number of buckets doubles as the index grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, stored, text_or_empty
from .text_kernel import buffers

WHITE = b" \t\n\x0b\x0c\r"
SLOTS, MAX_KICKS = 4, 256
#: Digests in a bucket, on average: a filter of 0.3 MB, keys of some 20 MB in a task.
BUCKET = 100_000


class CuckooFilter:
    """16-bit fingerprints, four slots in a bucket, two buckets for each fingerprint."""

    def __init__(self, capacity: int = 256, held: bytes | None = None):
        if held is None:
            self.n_buckets = 1 << max(4, int(capacity / SLOTS / 0.9).bit_length())
            self.slots: list[list[int]] = [[] for _ in range(self.n_buckets)]
        else:
            marks = np.frombuffer(held, "<u2").reshape(-1, SLOTS)
            self.n_buckets = len(marks)
            self.slots = [[x for x in row if x] for row in marks.tolist()]
        self._turn = 0

    def to_bytes(self) -> bytes:
        """Fingerprints are never 0, which marks a free slot."""
        return np.array([x + [0] * (SLOTS - len(x)) for x in self.slots], "<u2").tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.n_buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) & (self.n_buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, digest: bytes) -> bool:
        """False where no slot could be freed: then build a larger filter from the stored keys."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                return True
        place = b
        for _ in range(MAX_KICKS):
            self._turn = (self._turn + 1) % SLOTS
            held = self.slots[place]
            mark, held[self._turn] = held[self._turn], mark
            place = self._other(place, mark)
            if len(self.slots[place]) < SLOTS:
                self.slots[place].append(mark)
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Only for digests known to be live (verified against the stored keys)."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            if mark in self.slots[place]:
                self.slots[place].remove(mark)
                return True
        return False


def filter_of(keys: list[bytes], capacity: int) -> CuckooFilter:
    """A filter with all keys, doubled until they fit."""
    while True:
        made = CuckooFilter(capacity)
        if all(made.insert(x) for x in keys):
            return made
        capacity = made.n_buckets * SLOTS * 2


class DigestIndex:
    """One bucket: a cuckoo filter before a store of live keys. A record: [characters, doc_id to keep, rows]."""

    def __init__(self, capacity: int = 256):
        self.filter = CuckooFilter(capacity)
        self.store: dict[bytes, list[int]] = {}
        self.resizes = 0

    def put(self, digest: bytes, length: int, doc_id: int, rows: int = 1) -> None:
        if digest in self.filter and (held := self.store.get(digest)) is not None:
            if (-length, doc_id) < (-held[0], held[1]):
                held[0], held[1] = length, doc_id
            held[2] += rows
            return
        self.store[digest] = [length, doc_id, rows]
        if not self.filter.insert(digest):
            self.resizes += 1
            self.filter = filter_of(list(self.store), self.filter.n_buckets * SLOTS * 2)

    def records(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.store)
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            values = np.array([self.store[k] for k in some], np.int64).reshape(len(some), 3)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array(values[:, i]) for i in range(3))], ["digest", "n_chars", "keep_id", "group_size"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars): SHA-256 of the text without white space; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            whole = raw.tobytes()
            found = [hashlib.sha256(whole[a:b].translate(None, WHITE)).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "digest", "n_chars"])

    small_batches(docs.sparkSession)
    rows = documents(docs, F.length(text_or_empty()).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, digest binary, n_chars long")


def bucket_of(buckets: int, digest: str = "digest") -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def n_buckets(rows: DataFrame) -> int:
    """rows: stored, so that counting reads no more than the files' footers."""
    return rows.count() // BUCKET + 1


RECORD = "digest binary, n_chars long, keep_id long, group_size long"


def _merge_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same digest merged as far as BUCKET digests at a time allow."""
    index = DigestIndex()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            index.put(*row)
        if len(index.store) > BUCKET:
            yield from index.records()
            index = DigestIndex()
    yield from index.records()


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket; only one bucket is held."""
    index, at = DigestIndex(), None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket != at:
                yield from index.records()
                index, at = DigestIndex(), bucket
            index.put(*row)
    yield from index.records()


def build_index(rows: DataFrame) -> DataFrame:
    """The live digests of stored (doc_id, digest, n_chars): one row for each, with the document to keep (most
    characters, then smallest doc_id) and the number of rows. Rows are merged within each partition before
    the shuffle, so a digest sends no more rows to its bucket than there are partitions (or parts of them)."""
    ones = rows.select("digest", "n_chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = ones.mapInArrow(_merge_local, RECORD).select(bucket_of(n_buckets(rows)).alias("bucket"), "*")
    return local.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_buckets, RECORD)


#: Buckets named in a condition; more are joined.
NAMED = 1000
#: Tables that an index may consist of before they are written as one.
TABLES = 8


@dataclass
class Versions:
    """A table in buckets of which single ones are replaced: several stored tables, each partitioned by bucket, and for each bucket the one that holds it.
    The driver keeps two numbers for each bucket."""

    tables: list[DataFrame]
    home: dict[int, int]

    @classmethod
    def first(cls, rows: DataFrame, tag: str, buckets: int) -> Versions:
        return cls([stored(rows.repartition("bucket"), tag, "bucket")], dict.fromkeys(range(buckets), 0))

    def of(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of some buckets: only their files are read."""
        wanted: dict[int, list[int]] = {}
        for bucket in self.home if buckets is None else buckets:
            wanted.setdefault(self.home[bucket], []).append(bucket)
        out = None
        for at, own in sorted(wanted.items()):
            table = self.tables[at]
            if buckets is not None or len(self.tables) > 1:
                few = F.col("bucket").isin(own) if len(own) <= NAMED else None
                table = table.where(few) if few is not None else table.join(F.broadcast(table.sparkSession.createDataFrame([(x,) for x in own], "bucket int")), "bucket", "left_semi")
            out = table if out is None else out.unionByName(table)
        return self.tables[0].limit(0) if out is None else out

    def replaced(self, rows: DataFrame, buckets: list[int], tag: str) -> Versions:
        """With these rows in place of what the buckets held; the files of other buckets stay."""
        made = stored(rows.repartition("bucket"), tag, "bucket")
        found = Versions([*self.tables, made], self.home | dict.fromkeys(buckets, len(self.tables)))
        return found if len(found.tables) <= TABLES else Versions.first(found.of(), tag, len(self.home))


@dataclass
class ExactIndex:
    """live_rows: (digest, n_chars, doc_id, rows, bucket); slots: (bucket, slots), one row for each bucket; sizes: live rows of each bucket."""

    live_rows: Versions
    slots: Versions
    sizes: dict[int, int]
    bucket_size: int = BUCKET

    @property
    def buckets(self) -> int:
        return len(self.live_rows.home)

    @property
    def live(self) -> DataFrame:
        return self.live_rows.of().select(LIVE)

    @property
    def filters(self) -> DataFrame:
        return self.slots.of()

    def records(self) -> DataFrame:
        """One row for each live digest: the document to keep and the number of rows, partially aggregated before the shuffle."""
        best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("low")))
        found = self.live.groupBy("digest").agg(best.alias("best"), F.sum("rows").alias("group_size"))
        return found.select("digest", F.col("best.n_chars").alias("n_chars"), (-F.col("best.low")).alias("keep_id"), "group_size")


LIVE = ["digest", "n_chars", "doc_id", "rows"]
FILTERS = "bucket int, slots binary"


def _new_filter(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    held = keys["digest"].tolist()
    return pd.DataFrame({"bucket": [key[0]], "slots": [filter_of(held, 2 * len(held)).to_bytes()]})


def _sizes(live: DataFrame) -> dict[int, int]:
    return {r["bucket"]: r["n"] for r in live.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each bucket


def _in_buckets(live: DataFrame, buckets: int, bucket_size: int) -> ExactIndex:
    """An index of stored live rows, all written anew."""
    held = Versions.first(live.select(*LIVE, bucket_of(buckets).alias("bucket")), "live", buckets)
    filters = held.of().select("bucket", "digest").distinct().groupBy("bucket").applyInPandas(_new_filter, FILTERS)
    return ExactIndex(held, Versions.first(filters, "filters", buckets), _sizes(held.of()), bucket_size)


def start_index(rows: DataFrame, buckets: int | None = None, bucket_size: int = BUCKET) -> ExactIndex:
    """An index of (doc_id, digest, n_chars), possibly empty, in as many buckets as the rows need; their number doubles as the index grows."""
    rows = stored(rows.select("digest", "n_chars", "doc_id"), "rows")
    live = stored(rows.groupBy("digest", "n_chars", "doc_id").agg(F.count("*").alias("rows")), "live")
    return _in_buckets(live, buckets or rows.count() // bucket_size + 1, bucket_size)


def maintain(index: ExactIndex, changes: DataFrame) -> ExactIndex:
    """The index after ``changes`` (digest, n_chars, doc_id, rows). Positive rows are inserted; negative ones delete that many rows
    of this document with this digest and length, so that the next best document of a group is kept from then on. All changes of
    a row add up before they take effect; deleting what isn't live changes nothing.

    Only the buckets of the changes are read, and of these only what changed is written: live rows and filters of other buckets stay in
    their files. When the buckets hold twice their size on average, their number is doubled, so a bucket never holds many times what one task
    works on; that writes all rows anew, after as many insertions as there were rows."""
    buckets = index.buckets
    wanted = stored(changes.groupBy("digest", "n_chars", "doc_id").agg(F.sum("rows").alias("rows")).where("rows <> 0").withColumn("bucket", bucket_of(buckets)), "changes")
    met = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most a number for each bucket
    if not met:
        return index
    asked = wanted.select("bucket", "digest").distinct()

    def screen(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter(held=filters["slots"].iloc[0]) if len(filters) else CuckooFilter()
        return keys.assign(hit=[x in held for x in keys["digest"]])[["digest", "hit"]]

    own_live, own_filters = index.live_rows.of(met), index.slots.of(met).select("bucket", "slots")
    screened = stored(asked.groupBy("bucket").cogroup(own_filters.groupBy("bucket")).applyInPandas(screen, "digest binary, hit boolean"), "screened")
    hits = screened.where("hit").select("digest")
    # What may be live is looked up among the live rows; the rest is new, and deletions of it are void.
    near = own_live.select(LIVE).join(hits, "digest", "left_semi")
    before = stored(near.select("digest").distinct(), "before")
    summed = near.unionByName(wanted.select(LIVE).join(hits, "digest", "left_semi")).groupBy("digest", "n_chars", "doc_id").agg(F.sum("rows").alias("rows"))
    fresh = wanted.select(LIVE).join(hits, "digest", "left_anti")
    touched = stored(summed.unionByName(fresh).where("rows > 0").select(LIVE), "touched")
    after = touched.select("digest").distinct()
    live = own_live.join(hits, "digest", "left_anti").select(*LIVE).unionByName(touched).withColumn("bucket", bucket_of(buckets))
    live_rows = index.live_rows.replaced(live, met, "live")

    come = after.join(before, "digest", "left_anti").withColumn("step", F.lit(1))
    gone = before.join(after, "digest", "left_anti").withColumn("step", F.lit(-1))
    steps = come.unionByName(gone).select(bucket_of(buckets).alias("bucket"), "digest", "step")

    def change(key: tuple, filters: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        """No slots: the filter overflowed."""
        if not len(steps):
            return filters
        held = CuckooFilter(held=filters["slots"].iloc[0]) if len(filters) else CuckooFilter(2 * len(steps))
        for digest in steps.loc[steps["step"] < 0, "digest"]:
            held.delete(digest)
        fits = all(held.insert(x) for x in steps.loc[steps["step"] > 0, "digest"])
        return pd.DataFrame({"bucket": [key[0]], "slots": [held.to_bytes() if fits else None]})

    changed = stored(own_filters.groupBy("bucket").cogroup(steps.groupBy("bucket")).applyInPandas(change, FILTERS), "filters")
    full = changed.where("slots is null").select("bucket")
    keys = live_rows.of(met).select("bucket", "digest").join(full, "bucket", "left_semi").distinct()
    larger = keys.groupBy("bucket").applyInPandas(_new_filter, FILTERS)
    filters = index.slots.replaced(changed.where("slots is not null").unionByName(larger), met, "filters")
    sizes = {b: n for b, n in index.sizes.items() if b not in set(met)} | _sizes(live_rows.of(met))
    found = ExactIndex(live_rows, filters, sizes, index.bucket_size)
    need = buckets
    while sum(sizes.values()) > 2 * index.bucket_size * need:
        need *= 2
    return found if need == buckets else _in_buckets(stored(found.live, "live"), need, index.bucket_size)


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, n_chars, keep_chars (characters of the row that stays).

    Null and empty texts form one group. Ties on characters go to the smallest doc_id. Where rows repeat
    whole, with the same doc_id, all of them carry ``kept`` (``deduplicate`` returns one of them). An empty
    table gives no rows; further columns of docs are not looked at.
    """
    rows = stored(digests(docs), "digests")
    index = build_index(rows).select("digest", "keep_id", "group_size", F.col("n_chars").alias("keep_chars"))
    # Spark splits a partition of rows that one digest makes too large (adaptive skew join): the index has a row for each digest.
    return rows.join(index, "digest").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest", "n_chars", "keep_chars")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group. A row is told by doc_id, digest and length, so rows
    of different texts that share a doc_id are told apart; of rows equal in all three one stays."""
    keep = groups(docs).where("kept and n_chars = keep_chars").select(F.col("doc_id").alias("key"), F.lower(F.hex("digest")).alias("digest"), "n_chars").distinct()
    text = text_or_empty()
    digest = F.sha2(F.translate(text, WHITE.decode(), ""), 256)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("key"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"), F.struct("*").alias("row"))
    names = ["key", "digest", "n_chars"]
    return rows.join(keep, names, "left_semi").dropDuplicates(names).select("row.*")
