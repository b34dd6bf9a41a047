"""Alignment of two tokenizers over the same texts.

Each text is tokenised whole by both. Byte places where a token of A and a token of B both end cut the tokens into groups;
the tokens of a group are linked, each of A's with each of B's. Shared ends that come before a space-marked token on both
sides are anchors: they split a document into windows, most of them a word, and since a window's groups follow from its
token ids alone, they are worked out once for each pair of id tuples and remembered. Links hold in a window
whatever stands around it, which the check of the bytes makes sure of: a document's tokens, put together, must be its bytes.

How many documents hold a pair of ids linked is counted in blocks: a task closes a block at a number of pairs, sends one row
for each pair and block to be summed, and gets the sums of its own pairs back, block by block. So what is shuffled is
pairs by block, not links, and neither a frequent pair nor a long list of documents meets in one task.
What is broadcast is a row for each id of A, which its vocabulary bounds.

A text that is null, empty, or that a tokenizer doesn't give back byte by byte (it holds the space mark itself, say) has no
tokens: its row has zeros and an empty string. Repeated rows count as documents of their own; rows with a null doc_id are left out; further
columns are not looked at; an empty table gives no rows. A long text is worked on as one, in memory in proportion to it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, stored

#: A block is closed when its documents have so many pairs, each document's counted once.
BLOCK = 1 << 20
#: Window alignments that a task keeps, and the tokens of the longest window that is kept.
CACHED, LONGEST = 1 << 17, 64
#: Tokens whose bytes are compared at a time.
PART = 1 << 18
#: Links of a group that are written out one by one; those of larger groups are counted by id.
LINKS = 1 << 12
#: Rows of an Arrow batch.
ROWS = 2048
#: Tokens of the texts that are worked on together.
TOGETHER = 1 << 20
#: Numbers that tell the places in a window apart.
ODD = np.random.default_rng(13).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


@dataclass
class Side:
    """A tokenizer: the bytes of each id, and a function from texts to the ids of each."""

    pieces: list[bytes]
    encode: Callable[[list[str]], list[np.ndarray]]
    sizes: np.ndarray = field(init=False)
    spaced: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(x) for x in self.pieces], np.int32)
        self.spaced = np.array([x.startswith(b" ") for x in self.pieces])
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.every = np.frombuffer(b"".join(self.pieces), np.uint8)

    def tokens(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, "<u4") for x in self.encode(texts)]

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the ids' bytes make up the text. Compared a part at a time."""
        given, at = np.frombuffer(text, np.uint8), 0
        for i in range(0, len(ids), PART):
            part = ids[i : i + PART]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes, dtype=np.int32)
            places = np.repeat(self.starts[part] - ends + sizes, sizes)
            places += np.arange(len(places), dtype=np.int32)
            if not np.array_equal(self.every[places], given[at : at + len(places)]):
                return False
            at += len(places)
        return at == len(given)


def byte_level(ranks_path: str, json_path: str, pattern: str) -> Side:
    """A byte-level vocabulary, with a space in front of each text; special tokens' strings are plain text. The rank file holds the
    same vocabulary as the JSON file as bytes; where the faster library gives up, the other one is asked."""
    import json

    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(json_path, encoding="utf-8") as file:
        added = {x["id"]: x["content"].encode() for x in json.load(file)["added_tokens"]}
    pieces = [b""] * (max(*ranks.values(), *added) + 1)
    for piece, i in [*((x, i) for i, x in added.items()), *ranks.items()]:
        pieces[i] = piece
    fast = tiktoken.Encoding("aligning", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def one(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as error:  # the library's panics don't derive from Exception
            if type(error).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(json_path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids)

    return Side(pieces, lambda texts: [one(" " + x) for x in texts])


def piece_level(model_path: str) -> Side:
    """A vocabulary of pieces that puts a space in front of a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
    return Side(pieces, lambda texts: model.encode(texts, num_threads=1))


def public_sides() -> tuple[Side, Side]:
    import public_tokenizers as P

    return byte_level(P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN), piece_level(P.path("piece_bpe_32k.model"))


#: The alignment of one pair of id tuples: groups as text, their number, that of links, the pairs linked, and (pair, further links) of pairs with several
#: links. A pair of ids is a number: a's id times the size of B's vocabulary, and b's id. Plain tuples, as there are very many.
Window = tuple[str, int, int, list[int], list[tuple[int, int]]]


def pair_kind(n_a: int, n_b: int) -> str:
    return "<u4" if n_a * n_b < 1 << 32 else "<i8"


class Aligner:
    def __init__(self, a: Side, b: Side, cached: int = CACHED) -> None:
        self.a, self.b, self.cached = a, b, cached
        self.width = len(b.pieces)
        self.sizes_a, self.sizes_b = a.sizes.tolist(), b.sizes.tolist()
        #: In which pairs are stored.
        self.kind = pair_kind(len(a.pieces), len(b.pieces))
        #: An id as it is written, with what follows it: a comma within a side, a bar behind A's ids, a semicolon behind a group.
        self.said = [f"{i}{x}" for i in range(max(len(a.pieces), len(b.pieces))) for x in ",|;"]
        self.young: dict[tuple[bytes, bytes], Window] = {}
        self.old: dict[tuple[bytes, bytes], Window] = {}

    def groups(self, a: list[int], b: list[int]) -> Window:
        """The groups of tokens that spell the same bytes."""
        sizes_a, sizes_b, width = self.sizes_a, self.sizes_b, self.width
        texts, links, found, repeated = [], 0, [], []
        i = j = u = v = end_a = end_b = 0
        while u < len(a):
            end_a += sizes_a[a[u]]
            u += 1
            while end_b < end_a:
                end_b += sizes_b[b[v]]
                v += 1
            if end_a < end_b:
                continue
            if u - i == v - j == 1:
                texts.append(f"{a[i]}|{b[j]}")
                found.append(a[i] * width + b[j])
            else:
                own, other = a[i:u], b[j:v]
                texts.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
                links += len(own) * len(other) - 1
                if len(own) * len(other) <= LONGEST:
                    found += [x * width + y for x in own for y in other]
                else:  # each id once with its number: a large group of repeated tokens has few pairs of ids
                    counted = Counter(other)
                    for x, n in Counter(own).items():
                        found += [x * width + y for y in counted]
                        repeated += [(x * width + y, n * m - 1) for y, m in counted.items() if n * m > 1]
            i, j = u, v
        if len(set(found)) < len(found):
            counted = Counter(found)
            repeated += [(pair, n - 1) for pair, n in counted.items() if n > 1]
            found = list(counted)
        return ";".join(texts), len(texts), links + len(texts), found, repeated

    def known(self, keys: list[tuple[bytes, bytes]]) -> list[Window]:
        """The alignments of pairs of ids' bytes, each given once. Those not met before are worked out together, and remembered but for very long ones; of
        two generations the older one goes when the younger is full."""
        found = list(map(self.young.get, keys))
        missing = [key for key, window in zip(keys, found, strict=True) if window is None]
        if missing:
            before = list(map(self.old.get, missing))
            made = iter(self.together([key for key, window in zip(missing, before, strict=True) if window is None]))
            came = [next(made) if window is None else window for window in before]
            if max(map(len, chain.from_iterable(missing))) > 2 * LONGEST:
                self.young.update((key, window) for key, window in zip(missing, came, strict=True) if len(key[0]) + len(key[1]) <= 4 * LONGEST)
            else:
                self.young.update(zip(missing, came, strict=True))
            if len(self.young) >= self.cached:
                self.old, self.young = self.young, {}
            rest = iter(came)
            found = [next(rest) if window is None else window for window in found]
        return found

    def together(self, keys: list[tuple[bytes, bytes]]) -> list[Window]:
        """``groups`` of many windows in one go. Put in a row, both sides of the windows spell the same bytes, so the shared ends of the rows are those of
        the windows."""
        if not keys:
            return []
        rows = [np.frombuffer(b"".join(side), "<u4") for side in zip(*keys, strict=True)]
        counts = [np.array([len(x) // 4 for x in side]) for side in zip(*keys, strict=True)]
        ends = [np.cumsum(side.sizes[ids], dtype=np.int64) for side, ids in zip((self.a, self.b), rows, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(shared, x) for x in ends]
        n = [np.bincount(x, minlength=len(shared)) for x in group]
        size = n[0] * n[1]
        window_ends = np.cumsum(counts[0])
        last_group = group[0][window_ends - 1] + 1
        first_group = np.concatenate([[0], last_group[:-1]])
        # Windows with groups of very many links are worked out one by one.
        large = np.add.reduceat(size > LINKS, first_group) > 0
        texts = self._texts(rows, group, n, counts)
        pairs, more, links = self._pairs(rows, group, n, np.where(size > LINKS, 0, size), last_group)
        numbers = (last_group - first_group).tolist()
        out = list(zip(texts, numbers, links, pairs, more, strict=True))
        for i in np.flatnonzero(large).tolist():
            out[i] = self.groups(*(memoryview(x).cast("I").tolist() for x in keys[i]))
        return out

    def _texts(self, rows: list[np.ndarray], group: list[np.ndarray], n: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
        """The groups of each window as text: tokens in the order in which they are written, each with what follows it."""
        before = [np.concatenate([[0], np.cumsum(x)]) for x in n]
        written = np.empty(len(rows[0]) + len(rows[1]), np.int64)
        for side, (ids, of) in enumerate(zip(rows, group, strict=True)):
            place = np.arange(len(ids)) + before[1 - side][of + side]
            last = np.append(of[1:] != of[:-1], True)
            written[place] = 3 * ids.astype(np.int64) + np.where(last, 1 + side, 0)
        said = list(map(self.said.__getitem__, written.tolist()))
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        return ["".join(said[a:b])[:-1] for a, b in zip([0, *ends], ends, strict=False)]

    def _pairs(self, rows: list[np.ndarray], group: list[np.ndarray], n: list[np.ndarray], size: np.ndarray, last_group: np.ndarray) -> tuple[list, list, list]:
        """The pairs of each window, those with several links, and how many links it has."""
        first = [np.cumsum(x) - x for x in n]
        of = np.repeat(np.arange(len(size)), size)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        wide = n[1][of]
        pair = rows[0][first[0][of] + turn // wide].astype(np.int64) * self.width + rows[1][first[1][of] + turn % wide]
        window = np.searchsorted(last_group, of, "right")
        links = np.bincount(window, minlength=len(last_group)).tolist()
        order = np.lexsort((pair, window))
        pair, window = pair[order], window[order]
        start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (window[1:] != window[:-1])])) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(pair)))
        pair, window = pair[start], window[start]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=len(last_group)))]).tolist()
        every = pair.tolist()
        none: list[tuple[int, int]] = []
        more = [none] * len(links)
        for i in np.flatnonzero(times > 1).tolist():
            more[window[i]] = [*more[window[i]], (every[i], int(times[i]) - 1)]
        return [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], more, links

    def windows(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of a row of texts begin, among the tokens of A and of B. Both sides spell the same bytes, so a byte's place is one
        number for both; a window begins where a text does, and where tokens of both sides begin with a space at one place."""
        starts = []
        for side, ids, first in ((self.a, a, first_a), (self.b, b, first_b)):
            sizes = side.sizes[ids]
            begins = side.spaced[ids]
            begins[first] = True
            at = np.flatnonzero(begins)
            starts.append((at, (np.cumsum(sizes, dtype=np.int64) - sizes)[at]))
        _, i, j = np.intersect1d(starts[0][1], starts[1][1], assume_unique=True, return_indices=True)
        return starts[0][0][i], starts[1][0][j]

    def distinct(self, rows: list[np.ndarray], begins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(a window of each kind, the kind of each window): windows of equal ids are of one kind. Told by a hash; each window's ids are then compared
        with those of the window that stands for its kind, and should two kinds share a hash, all are told by their ids."""
        h = np.zeros(len(begins[0]), np.uint64)
        places, sizes, of = [], [], []
        for ids, begin in zip(rows, begins, strict=True):
            size = np.diff(np.append(begin, len(ids)))
            window = np.repeat(np.arange(len(begin)), size)
            place = np.arange(len(ids)) - begin[window]
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * ODD[place & (len(ODD) - 1)]
            mixed ^= mixed >> np.uint64(32)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), begin)
            places.append(place)
            sizes.append(size)
            of.append(window)
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        stands = first[kind]
        if all(np.array_equal(size, size[stands]) for size in sizes) and all(np.array_equal(ids, ids[begin[stands][window] + place]) for ids, begin, window, place in zip(rows, begins, of, places, strict=True)):
            return first, kind
        number: dict[tuple[bytes, bytes], int] = {}
        kind = np.array([number.setdefault(key, len(number)) for key in self.keys(rows, begins, np.arange(len(h)))])
        return np.unique(kind, return_index=True)[1], kind

    @staticmethod
    def keys(rows: list[np.ndarray], begins: list[np.ndarray], which: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The ids of some windows, as bytes."""
        sides = []
        for ids, begin in zip(rows, begins, strict=True):
            raw = ids.tobytes()
            ends = np.append(begin[1:], len(ids))
            sides.append([raw[i:j] for i, j in zip((4 * begin[which]).tolist(), (4 * ends[which]).tolist(), strict=True)])
        return list(zip(*sides, strict=True))

    def align(self, texts: list[str], of_a: list[np.ndarray], of_b: list[np.ndarray]) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray] | None]:
        """For each text: groups as text, their number, that of links, the pairs of ids linked, and how many links each has; None where
        the tokens aren't the text. Texts are worked on together, as many as have TOGETHER tokens."""
        held: list[tuple[np.ndarray, np.ndarray] | None] = []
        size = 0
        for text, a, b in zip(texts, of_a, of_b, strict=True):
            spelt = b" " + text.encode()
            good = bool(text) and self.a.spells(a, spelt) and self.b.spells(b, spelt)
            held.append((a, b) if good else None)
            size += len(a)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, held: list[tuple[np.ndarray, np.ndarray] | None]) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray] | None]:
        good = [x for x in held if x is not None]
        if not good:
            yield from held
            return
        rows = [np.concatenate(side) for side in zip(*good, strict=True)]
        firsts = [np.cumsum([0, *map(len, side[:-1])]) for side in zip(*good, strict=True)]
        begins = list(self.windows(*rows, *firsts))
        stands, kind = self.distinct(rows, begins)
        said, groups, links, linked, more = zip(*self.known(self.keys(rows, begins, stands)), strict=True)
        # The windows of each text, and the pairs of each window, by kind.
        cuts = np.searchsorted(begins[0], [*firsts[0].tolist(), len(rows[0])])
        of = np.repeat(np.arange(len(good)), np.diff(cuts))
        numbers = [np.add.reduceat(np.array(x, np.int64)[kind], cuts[:-1]).tolist() for x in (groups, links)]
        n = np.fromiter(map(len, linked), np.int64, len(linked))
        every, at = np.fromiter(chain.from_iterable(linked), "<i8"), np.cumsum(n) - n
        n = n[kind]
        pair = every[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[kind], n)]
        space = len(self.a.pieces) * self.width
        pair, times = np.unique(np.repeat(of, n) * space + pair, return_counts=True)
        for i in np.flatnonzero(np.isin(kind, [i for i, x in enumerate(more) if x])).tolist():
            for one, further in more[kind[i]]:
                times[np.searchsorted(pair, of[i] * space + one)] += further
        ends = np.searchsorted(pair, np.arange(len(good) + 1) * space).tolist()
        texts, cuts = np.array([*said, None], object)[kind].tolist(), cuts.tolist()
        done = ((";".join(texts[cuts[i] : cuts[i + 1]]), numbers[0][i], numbers[1][i], pair[ends[i] : ends[i + 1]] - i * space, times[ends[i] : ends[i + 1]]) for i in range(len(good)))
        for x in held:
            yield None if x is None else next(done)


DOCUMENT = "block long, of_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, times binary, block_pairs array<long>, block_docs array<long>"


def aligned(docs: DataFrame, make_sides: Callable[[], tuple[Side, Side]], with_groups: bool, block: int = BLOCK) -> DataFrame:
    """A row for each document, with its pairs of ids and how often they are linked in it, and a row for each block, with its
    pairs and in how many of its documents they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is remembered is very many objects and no cycles: looking for cycles among them takes time for nothing.
        gc.disable()
        try:
            yield from rows_of(batches)
        finally:
            gc.enable()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(*make_sides())
        kind = both.kind
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def rows(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
            fields = [x.split() for x in DOCUMENT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields], [name for name, _ in fields])

        def closed() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return rows(block=[number], of_block=[True], block_pairs=[pairs], block_docs=[n])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            of_a, of_b = both.a.tokens(texts), both.b.tokens(texts)
            out: dict[str, list] = {name: [] for name in ("block", "of_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times")}
            for doc_id, a, b, found in zip(batch.column(0).to_pylist(), of_a, of_b, both.align(["" if x is None else x for x in texts], of_a, of_b), strict=True):
                groups, n_groups, n_links, pairs, times = found or ("", 0, 0, np.zeros(0, "<i8"), np.zeros(0, "<i8"))
                row = (number, False, doc_id, len(a) if found else 0, len(b) if found else 0, n_groups, n_links, hashlib.sha256(groups.encode()).hexdigest() if found else "", groups if with_groups else None, pairs.astype(kind).tobytes(), times.astype("<i8").tobytes())
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                held.append(pairs)
                size += len(pairs)
                if size >= block:
                    yield rows(**out)
                    for column in out.values():
                        column.clear()
                    yield closed()
                    number, held, size = number + 1, [], 0
            if out["block"]:
                yield rows(**out)
        if held:
            yield closed()

    small_batches(docs.sparkSession, ROWS)
    return documents(docs).mapInArrow(run, DOCUMENT)


def align(docs: DataFrame, make_sides: Callable[[], tuple[Side, Side]] = public_sides, with_groups: bool = True, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Two tables. Of documents: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is in as many documents
    as any pair of its id of A), count_sum (over its links, in how many documents the pair is), groups_sha256 and, if asked for, groups:
    ids of A, "|", ids of B, with commas between ids and semicolons between groups. Of pairs: a, b, n_docs, best."""
    held = stored(aligned(docs, make_sides, with_groups, block), "aligned")
    a, b = make_sides()
    width, kind = len(b.pieces), pair_kind(len(a.pieces), len(b.pieces))
    of_blocks = held.where("of_block").select("block", F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("x")).select("block", F.col("x.block_pairs").alias("pair"), F.col("x.block_docs").alias("n"))
    totals = stored(of_blocks.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = totals.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each id of A, at most
    marked = totals.join(F.broadcast(most), "a").withColumn("best", F.col("n_docs") == F.col("most"))
    known = of_blocks.select(F.col("block").alias("of"), "pair").join(marked.select("pair", "n_docs", "best"), "pair")

    def count(own: pa.Table, pairs: pa.Table) -> pa.Table:
        keys, n, best = (pairs.column(c).to_numpy() for c in ("pair", "n_docs", "best"))
        order = np.argsort(keys)
        keys, n, best = keys[order], n[order], best[order]
        sums, bests = [], []
        for wanted, times in zip(own.column("pairs"), own.column("times"), strict=True):
            at = np.searchsorted(keys, np.frombuffer(wanted.as_buffer(), kind).astype(np.int64))
            times = np.frombuffer(times.as_buffer(), "<i8")
            sums.append(int((n[at] * times).sum()))
            bests.append(int(times[best[at].astype(bool)].sum()))
        return own.drop_columns(["block", "pairs", "times"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("groups string, " if with_groups else "") + "n_best long, count_sum long"
    rows = held.where("not of_block").select("block", *names, "pairs", "times").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(count, shape)
    return rows, marked.select("a", F.expr(f"pair % {width}").alias("b"), "n_docs", "best")
