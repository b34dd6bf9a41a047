"""Removal of repeated passages by sorting suffixes bucket by bucket.

Wanted is every byte covered by a string of ``length`` bytes that also starts anywhere else. All starting places at
once would not fit anywhere, so suffixes are dealt to buckets and sorted one bucket at a time:

1. A locally consistent cover: each starting place belongs to the smallest (by hash) 32-byte gram within its
   string, its anchor. Equal strings have equal anchors at equal distances, which is what a difference cover
   is for; as both suffixes are then aligned on their anchors, a cover of one residue in eight does where an unaligned one
   would need several. Consecutive starting places with the same anchor form a segment.
2. Anchors that occur once can't take part in a repeat; they go after one aggregation on the anchors' hashes (hashes that
   collide only make a bucket larger). Segments that are equal as a whole, by 128 bits of BLAKE2b over their bytes, are repeats
   as a whole, and one of them stands for all. A segment that many texts share is dealt over parts of about ``PART`` rows.
3. Of the anchors left, with several different segments, the segments' bytes go to the anchor's bucket. There the
   cover's samples (every eighth byte, counted from the anchor) get ranks for the 192 bytes from each on, by doubling. Suffixes
   are sorted by their first eight bytes; the ties, however long, are resolved by the rank of the next sample and
   the last eight bytes. Neighbours that are equal mark repeats. A task holds a few MB at a time.
4. Anchors with very many different segments (``hot``) are not gathered: their starting places are
   counted one by one, under 128 bits of BLAKE2b, with partial aggregation before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, stored
from .text_kernel import BYTE_CODE, U64, buffers, prefix_hash, span_hash

LENGTH, GRAM = 200, 32
#: What a row of the input is told by.
ROW = ["doc_id", "uid"]
#: Bytes worked on at a time.
CHUNK = 4 << 20
#: Rows of one anchor from which its bucket is not gathered in a task.
HOT = 20_000
WORD = 8
#: Rows of one anchor that one join key holds, about.
PART = 1000


def pieces(off: np.ndarray, length: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, int, int]]:
    """Runs of texts (first, last + 1) with the bytes (from, to) to look at: about ``chunk`` bytes, or a part of one
    long text together with the length - 1 bytes after it."""
    i, n = 0, len(off) - 1
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= chunk:
            j += 1
        if j == i + 1 and off[j] - off[i] > chunk:
            for a in range(int(off[i]), int(off[j]), chunk):
                yield i, j, a, int(min(a + chunk + length - 1, off[j]))
        else:
            yield i, j, int(off[i]), int(off[j])
        i = j


def segments_of(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """raw: bytes of texts that end at ``ends``. -> for each segment: first and last starting place, anchor's place,
    anchor's hash."""
    none = np.zeros(0, np.int64)
    n = len(raw) - length + 1
    if n < 1:
        return none, none, none, none.astype(U64)
    prefix = prefix_hash(BYTE_CODE[raw])
    start = np.arange(len(raw) - gram + 1)
    grams = span_hash(prefix, start, start + gram)
    width = length - gram + 1
    # The smallest hash, then the leftmost place: 40 bits of hash before 24 bits of place (a piece is shorter than 2**24).
    key = (grams & ~U64(0xFFFFFF)) | start.astype(U64)
    padded = np.full(-(-len(key) // width) * width, ~U64(0), U64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    owner = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U64(0xFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, bool)
    begins = np.concatenate([[0], ends[:-1]])
    step = np.zeros(n + 2, np.int64)
    long = ends - begins >= length
    np.add.at(step, begins[long], 1)
    np.add.at(step, (ends - length + 1)[long], -1)
    valid[:n] = np.cumsum(step)[:n] > 0
    border = np.ones(n + 1, bool)
    border[1:n] = (owner[1:] != owner[:-1]) | (valid[1:n] != valid[: n - 1])
    place = np.flatnonzero(border)
    first, last = place[:-1], place[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    anchor = owner[first]
    return first, last, anchor, grams[anchor]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """gram (hash), seg (digest of the segment's bytes), doc_id and uid (the row), first, last, anchor (places in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, uid = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw, off = buffers(batch.column(2))
            for i, j, a, b in pieces(off, length):
                first, last, anchor, grams = segments_of(raw[a:b], np.minimum(off[i + 1 : j + 1], b) - a, length, gram)
                doc = np.searchsorted(off, first + a, side="right") - 1
                shift = a - off[doc]
                part = memoryview(raw[a:b].tobytes())
                segs = [hashlib.blake2b(part[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(segs, pa.binary()), pa.array(doc_id[doc]), pa.array(uid[doc]), *(pa.array(x + shift) for x in (first, last, anchor))], ["gram", "seg", "doc_id", "uid", "first", "last", "anchor"])

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "gram long, seg binary, doc_id long, uid int, first long, last long, anchor long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, text): a row is told by its doc_id and, where rows share that, by 32 bits of its text."""
    return documents(docs).select("doc_id", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("uid"), "text")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, n_bytes, packed): compressed before a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            raw, off = buffers(batch.column(2))
            whole = raw.tobytes()
            data = [codec.compress(whole[a:b], asbytes=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(off)), pa.array(data, pa.binary())], ["doc_id", "uid", "n_bytes", "packed"])

    small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "doc_id long, uid int, n_bytes long, packed binary")


def unpack(data: pa.Scalar, n: int) -> bytes:
    return pa.Codec("zstd").decompress(data.as_buffer(), int(n), asbytes=True) if n else b""


def repeated_in_buckets(texts: list[bytes], anchor: np.ndarray, bucket: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each segment (its bytes, the anchor's place in it, its bucket) the runs [i, j) of starting places whose string occurs
    in another segment of the bucket at the same distance from the anchor."""
    sizes = np.array([len(x) for x in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts) + bytes(WORD), np.uint8)
    word = np.zeros(off[-1] + 1, U64)
    for k in range(WORD):
        word |= raw[k : k + len(word)].astype(U64) << U64(8 * (WORD - 1 - k))
    # Samples: every eighth byte, counted from the anchor, that has eight bytes of its segment before it.
    lowest = anchor % WORD
    n_samples = np.maximum(0, (sizes - lowest) // WORD)
    s_off = np.concatenate([[0], np.cumsum(n_samples)])
    seg_of = np.repeat(np.arange(len(texts)), n_samples)
    left = s_off[1:][seg_of] - np.arange(s_off[-1])  # samples from here to the segment's end
    at = off[seg_of] + lowest[seg_of] + WORD * (np.arange(s_off[-1]) - s_off[seg_of])
    rank = np.unique(word[at], return_inverse=True)[1].astype(np.int64)
    span = length - WORD
    have = WORD
    while have < span:
        step = min(have, span - have)
        shift = step // WORD
        good = left * WORD >= have + step
        pair = np.full(len(rank), -1, np.int64)
        t = np.flatnonzero(good)
        pair[t] = rank[t] * (len(rank) + 1) + rank[t + shift]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        have += step
    n_places = np.maximum(0, sizes - length + 1)
    w_off = np.concatenate([[0], np.cumsum(n_places)])
    seg = np.repeat(np.arange(len(texts)), n_places)
    j = np.arange(w_off[-1]) - w_off[seg]
    ahead = (anchor[seg] - j) % WORD  # bytes to the next sample
    sample = s_off[seg] + (j + ahead - lowest[seg]) // WORD
    head, tie, tail = word[off[seg] + j], rank[sample], word[off[seg] + j + length - WORD]
    distance = anchor[seg] - j
    order = np.lexsort((tail, tie, head, distance, bucket[seg]))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (tail, tie, head, distance, bucket[seg]):
        same &= x[order[1:]] == x[order[:-1]]
    mark = np.zeros(len(order) + 1, bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    mark[-1] = False
    cut = np.zeros(len(order) + 1, bool)
    cut[w_off[:-1][n_places > 0]] = True
    previous = np.concatenate([[False], mark[:-1]])
    begin = np.flatnonzero(mark & (~previous | cut))
    end = np.flatnonzero(previous & (~mark | cut))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        s = int(seg[a])
        out[s].append((a - int(w_off[s]), b - int(w_off[s])))
    return out


def covers(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, uid, a, b): stretches [a, b) of bytes that are covered by repeated strings; they may overlap."""
    found = stored(anchors(docs, length, gram), "anchors")
    twice = stored(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("n > 1").select("gram", "n", (F.col("low") != F.col("high")).alias("mixed")), "twice")
    # Spark splits a partition that one anchor makes too large (adaptive skew join): ``twice`` has a row for each.
    several = stored(found.join(twice, "gram"), "several")
    stretch = [*ROW, F.col("first").alias("a"), (F.col("last") + length).alias("b")]
    whole = several.where("not mixed").select(stretch)

    mixed = several.where("mixed")
    kinds = stored(mixed.groupBy("gram", "seg").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct(*ROW, "first", "last", "anchor")).alias("x")), "kinds")
    parts_of = (F.floor(F.col("n") / PART) + 1).cast("int")
    dealt = mixed.withColumn("part", F.pmod(F.xxhash64(*ROW, "first"), parts_of).cast("int"))
    often = kinds.where("c > 1").select("gram", "seg", F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("part"))
    equal = dealt.join(often, ["gram", "seg", "part"], "left_semi").select(stretch)

    wanted = kinds.select("x.doc_id", "x.uid", F.struct("x.first", "x.last", "x.anchor", "gram", (F.col("c") > 1).alias("known"), (F.col("n") > hot).alias("hot")).alias("s")).groupBy(*ROW).agg(F.collect_list("s").alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("gram", pa.int64()), ("more", pa.binary()), ("doc_id", pa.int64()), ("uid", pa.int32()), ("first", pa.int64()), ("anchor", pa.int64()), ("known", pa.bool_()), ("bytes", pa.binary())])
        for batch in batches:
            rows: list[dict] = []
            for doc_id, uid, n, data, some in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4).to_pylist(), strict=True):
                text = unpack(data, n)
                for s in some:
                    part = text[s["first"] : s["last"] + length]
                    row = {"gram": s["gram"], "more": None, "doc_id": doc_id, "uid": uid, "first": s["first"], "anchor": s["anchor"] - s["first"], "known": s["known"], "bytes": part}
                    if not s["hot"]:
                        rows.append(row)
                        continue
                    for k in range(len(part) - length + 1):
                        rows.append(row | {"more": hashlib.blake2b(part[k : k + length], digest_size=16).digest(), "first": s["first"] + k, "bytes": b""})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    texts = packed_texts(docs).select(*ROW, "n_bytes", "packed")
    parts = stored(texts.join(wanted, ROW).mapInArrow(cut, "gram long, more binary, doc_id long, uid int, first long, anchor long, known boolean, bytes binary"), "parts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(some)
            runs = repeated_in_buckets(table["bytes"].to_pylist(), table["anchor"].to_numpy(), table["gram"].to_numpy(), length)
            out = [(d, u, f + i, f + j - 1 + length) for d, u, f, known, found in zip(*(table[c].to_pylist() for c in (*ROW, "first", "known")), runs, strict=True) if not known for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], [*ROW, "a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            # Whole buckets only: what follows the last change of the gram waits for the next batch.
            joined = pa.Table.from_batches(held).combine_chunks()
            grams = joined["gram"].to_numpy()
            change = np.flatnonzero(grams[1:] != grams[:-1])
            if not len(change):
                continue
            border = int(change[-1]) + 1
            yield solve(joined.slice(0, border).to_batches())
            held = joined.slice(border).to_batches()
            size = sum(x.nbytes for x in held)
        if held:
            yield solve(held)

    names = ["gram", *ROW, "first", "anchor", "known", "bytes"]
    cold = parts.where("more is null").select(names).repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, "doc_id long, uid int, a long, b long")
    warm = parts.where("more is not null")
    again = warm.groupBy("more").agg(F.count("*").alias("c")).where("c > 1")
    warm = warm.where("not known").join(again.select("more"), "more", "left_semi").select(*ROW, F.col("first").alias("a"), (F.col("first") + length).alias("b"))
    return whole.unionAll(equal).unionAll(cold).unionAll(warm)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches; overlapping and touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, removed (array of [start, end) in bytes), n_removed, n_spans, kept_sha256, and
    kept_text where asked for (bytes, as a cut may split a character).

    Null and empty texts, and texts shorter than ``length``, lose nothing. A whole repeated row is a repeat of the
    other, so both lose all of it. An empty table gives no rows."""
    spans = covers(docs, length, gram, hot).groupBy(*ROW).agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, n, data, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text, gone = unpack(data, n), merged([(s["a"], s["b"]) for s in some or ()])
                kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), n], strict=True))
                row = (doc_id, n, [{"start": a, "end": b} for a, b in gone], n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            width = 7 if with_text else 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:width], kinds, strict=False)], ["doc_id", "n_bytes", "removed", "n_removed", "n_spans", "kept_sha256", "kept_text"][:width])

    shape = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if with_text else "")
    return packed_texts(docs).join(spans, ROW, "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(run, shape)
