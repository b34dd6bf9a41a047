"""Fill-in-middle: each document is cut at two line ends, and its parts are put in another order.

Where the cuts fall is counted in lines, so it takes the line counts of a whole document before it can be cut. Texts
are split into chunks at places that their content chooses (a rolling hash over the last 16 bytes), so a passage that
many documents share gives the same chunks in all of them. For each chunk a summary is kept in a cache whose key is the
chunk's content, so a hit is a match of all its bytes: code points, line breaks and the places of these. Sums of the
summaries say in which chunk a cut falls, and that chunk's places where in it. The cache belongs to a task
and is bounded; no row is moved.

Empty and null texts, and texts that hold one of the marks, stay as they are (form "plain"). Each row is worked on by itself, so
repeated rows give equal rows and an empty table gives none; rows with a null doc_id are left out; further columns are
not looked at. Long texts are hashed in pieces of 4 MB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Documents in a hundred that are cut, and those of them in a hundred whose suffix comes first.
RATE, SPM = 100, 50

#: Bytes that the rolling hash looks back on, a power of two.
REACH = 16
#: A chunk ends where so many low bits of the hash are zero: 1 in 1024 places.
BITS = 10
LEAST, MOST = 64, 8192
#: Bytes hashed at a time.
SPAN = 4 << 20
#: Summaries that a task keeps: of chunks of at most MOST bytes.
CACHED = 4096

#: A number for each byte value, by which the hash tells bytes apart.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def chunk_ends(data: bytes) -> np.ndarray:
    """Where the chunks of data end. Whether a place further than LEAST into a chunk ends it depends on the REACH bytes before it
    only; a chunk without such a place is cut at MOST."""
    places = []
    for a in range(0, len(data), SPAN):
        first = max(a - REACH + 1, 0)
        h = GEAR[np.frombuffer(data, np.uint8, min(a + SPAN, len(data)) - first, first)]
        reach = 1
        while reach < REACH:  # sums over 1, 2, 4, ... bytes, older bytes shifted further
            h[reach:] += h[:-reach] << np.uint32(reach)
            reach *= 2
        places.append(np.flatnonzero((h[a - first :] >> np.uint32(REACH - BITS)) & np.uint32((1 << BITS) - 1) == 0) + a + 1)
    ends, last = [], 0
    for place in [*np.concatenate(places).tolist(), len(data)] if places else []:
        while place - last > MOST:
            last += MOST
            ends.append(last)
        if place - last >= LEAST or place == len(data) > last:
            last = place
            ends.append(last)
    return np.array(ends, np.int64)


def code_points(data: bytes | memoryview) -> int:
    """Bytes that begin a code point."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)) if len(data) else 0


class Summaries:
    """Summaries by content. Of two generations the older one goes when the younger is full, so what is met again stays."""

    def __init__(self, most: int = CACHED) -> None:
        self.most, self.young, self.old = most, {}, {}
        self.asked = self.made = 0

    def of(self, chunk: bytes) -> tuple[int, np.ndarray]:
        """(code points, places after line breaks) of a chunk."""
        self.asked += 1
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.made += 1
                found = (code_points(chunk), np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + 1)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found


class Lines:
    """The lines of one text, from its chunks' summaries."""

    def __init__(self, data: bytes, cache: Summaries) -> None:
        self.data = data
        ends = chunk_ends(data)
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.found = [cache.of(data[a:b]) for a, b in zip(self.starts.tolist(), ends.tolist(), strict=True)]
        self.points = np.cumsum([0, *(x[0] for x in self.found)])
        self.breaks = np.cumsum([0, *(len(x[1]) for x in self.found)])
        #: A last line without a break is a line too.
        self.n = int(self.breaks[-1]) + (len(data) > 0 and data[-1] != 10)

    def end(self, line: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the line of that number; lines count from 1."""
        if line == 0:
            return 0, 0
        if line > self.breaks[-1]:
            return len(self.data), int(self.points[-1])
        i = int(np.searchsorted(self.breaks, line)) - 1
        at = int(self.found[i][1][line - 1 - self.breaks[i]])
        start = int(self.starts[i])
        return start + at, int(self.points[i]) + code_points(self.data[start : start + at])


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that follow from seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars and middle_chars (code points; null if plain), output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Summaries()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_buffer().to_pybytes()
                lines = Lines(text, cache)
                one, two, three, four = draws(doc_id, seed)
                if not text or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
                    rows.append((lines.n, "plain", None, None, text))
                    continue
                first, last = sorted((one % (lines.n + 1), two % (lines.n + 1)))
                (a, before), (b, until) = lines.end(first), lines.end(last)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if four % 100 < spm:
                    rows.append((lines.n, "spm", before, until - before, b"<S>%b<P>%b<M>%b" % (suffix, prefix, middle)))
                else:
                    rows.append((lines.n, "psm", before, until - before, b"<P>%b<S>%b<M>%b" % (prefix, suffix, middle)))
            n, form, before, between, output = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that is cut holds none of the marks, so the first place of each mark is
    the one that was put in."""
    first, second = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = output.substr(F.length(first) + 1, F.length(output))
    at, to = F.locate(SUFFIX, body), F.locate(PREFIX, body)
    cut = F.when(form == "psm", at).otherwise(to)
    rest = body.substr(cut + F.length(second), F.length(body))
    end = F.locate(MIDDLE, rest)
    one, two, middle = body.substr(F.lit(1), cut - 1), rest.substr(F.lit(1), end - 1), rest.substr(end + len(MIDDLE), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
