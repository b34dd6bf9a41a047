"""Packing by concatenating and cutting.

Two passes. The first gives every document its tokens (with an end id) and, within its partition, the
number of tokens before it, and writes both to a shared table. Prefix sums over the partitions' totals then
give every document its place in one long row of tokens, which fixed windows cut into sequences. The second
pass cuts each document at the windows' borders; a piece that goes on from, or into, a neighbouring window
says so. Only the last sequence needs padding. No document, window or partition is gathered in one place:
what is collected is one number for each input partition.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small_batches, stored

WINDOW = 2048
END_ID = 1


def encoder(ranks_path: str, json_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, those that the JSON file gives as it is loaded: its added tokens are found in a text,
    none is put around it. The ranks file holds the same vocabulary and is read by the faster library; where that
    library gives up (runs of a million spaces), the other one is asked."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(json_path, encoding="utf-8") as file:
        added = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def slow(text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        return np.array(Tokenizer.from_file(json_path).encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as error:  # the library's panics don't derive from Exception
            if type(error).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


def public_encoder() -> Callable[[str], np.ndarray]:
    import public_tokenizers

    return encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def tokens(docs: DataFrame, make_encoder: Callable[[], Callable[[str], np.ndarray]] = public_encoder, end_id: int = END_ID) -> DataFrame:
    """First pass: (part, before, doc_id, doc_tokens, ids). ids: little-endian 16-bit numbers, or 32-bit where
    a larger id occurs in the document (then ``wide``). A null text counts as empty: it has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = make_encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, wide, data = [], [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                starts.append(before)
                counts.append(len(ids))
                wide.append(bool(ids.max() > 0xFFFF))
                data.append(ids.astype("<u4" if wide[-1] else "<u2").tobytes())
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(wide), pa.array(data, pa.binary())], ["part", "before", "doc_id", "doc_tokens", "wide", "ids"])

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, "part int, before long, doc_id long, doc_tokens long, wide boolean, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, make_encoder: Callable[[], Callable[[str], np.ndarray]] = public_encoder, ids: str = "array") -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, doc_tokens, sequence_id, offset
    (place in the sequence), from_before and goes_on (boundary marks), sequence_tokens (2048 but for the last),
    and ``token_ids`` array<int> (ids="array") or ``ids_crc32`` long (ids="crc32").
    An empty table gives no rows; a row with null or empty text gives one piece, the end id; repeated rows are
    packed as often as they occur; columns besides doc_id and text are not looked at.
    """
    held = stored(tokens(docs, make_encoder, end_id), "tokens")
    totals = held.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row for each partition of the first pass: 16 bytes for every 128 MB or so of input.
    places = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"), F.sum("total").over(Window.partitionBy()).alias("all"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every, before, doc, n, wide = (np.asarray(batch.column(i)) for i in range(6))
            out: list[list] = [[] for _ in range(9)]
            for i, data in enumerate(batch.column(6)):
                at, end = int(base[i] + before[i]), int(base[i] + before[i] + n[i])
                held_ids = np.frombuffer(data.as_buffer(), "<u4" if wide[i] else "<u2")
                for seq in range(at // window, (end - 1) // window + 1):
                    a, b = max(at, seq * window), min(end, (seq + 1) * window)
                    piece = held_ids[a - at : b - at]
                    row = (doc[i], a - at, b - a, n[i], seq, a - seq * window, a > at, b < end, min(window, int(every[i]) - seq * window))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    tail.append(zlib.crc32(piece.astype("<u4").tobytes()) if ids == "crc32" else piece.astype(np.int32))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            arrays.append(pa.array(tail, pa.int64() if ids == "crc32" else pa.list_(pa.int32())))
            tail.clear()
            yield pa.RecordBatch.from_arrays(arrays, names)

    tail: list = []
    last = "ids_crc32 long" if ids == "crc32" else "token_ids array<int>"
    shape = f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, from_before boolean, goes_on boolean, sequence_tokens long, {last}"
    names = [x.split()[0] for x in shape.split(", ")]
    joined = held.join(F.broadcast(places), "part").select("base", "all", "before", "doc_id", "doc_tokens", "wide", "ids")
    return joined.mapInArrow(cut, shape)
