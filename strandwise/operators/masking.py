"""Masking of repeats and motifs with N, and marking up of hits. Everything happens inside the row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import checked
from .motifs import Motif
from .rolling import TILE, bound_batches, layout, near, window_codes


def _revcom(text: str) -> str:
    return text.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def mask_runs(seq: Column, unit: str, n_min: int, n_max: int | None = None) -> Column:
    """Greedy runs of n_min (up to n_max) repeats of ``unit`` (in either case), from left to right, become N. What lies between the
    runs and the runs are put together again, so a sequence is cut into as few strings as it has runs."""
    run = f"(?:{checked(unit, 'unit')}){{{n_min},{'' if n_max is None else n_max}}}"
    runs = F.transform(F.regexp_extract_all(seq, F.lit(run), F.lit(0)), lambda x: F.repeat(F.lit("N"), F.length(x)))
    pairs = F.arrays_zip(F.split(seq, run, -1).alias("between"), runs.alias("run"))
    masked = F.array_join(F.transform(pairs, lambda x: F.concat(F.coalesce(x["between"], F.lit("")), F.coalesce(x["run"], F.lit("")))), "")
    return F.when(seq.rlike(run), masked).otherwise(seq)


def mask_repeats(seq: Column, unit: str, n_min: int, revcom: bool = True, n_max: int | None = None) -> Column:
    """Runs of the unit, then runs of its reverse complement on the text masked so far."""
    out = mask_runs(seq, unit, n_min, n_max)
    return mask_runs(out, _revcom(checked(unit, "unit")), n_min, n_max) if revcom else out


@dataclass(frozen=True)
class RepeatMask:
    unit: str
    n_min: int
    revcom: bool = True
    n_max: int | None = None

    def apply(self, seq: Column) -> Column:
        return mask_repeats(seq, self.unit, self.n_min, self.revcom, self.n_max)

    def on_bytes(self) -> Callable[[np.ndarray], np.ndarray]:
        """The same on bytes; a line break ends a run."""
        unit = checked(self.unit, "unit")
        runs = [re.compile(b"(?:%b){%d,%b}" % (x.encode(), self.n_min, b"" if self.n_max is None else b"%d" % self.n_max)) for x in ([unit, _revcom(unit)] if self.revcom else [unit])]

        def masked(raw: np.ndarray) -> np.ndarray:
            data = raw.tobytes()
            for run in runs:
                data = run.sub(lambda m: b"N" * len(m[0]), data)
            return np.frombuffer(data, np.uint8)

        return masked


@dataclass(frozen=True)
class MotifMask:
    seq: str
    d: int
    revcom: bool = True

    def apply(self, seq: Column) -> Column:
        return mask_motif(seq, Motif(self.seq, self.d, self.revcom))

    def on_bytes(self) -> Callable[[np.ndarray], np.ndarray]:
        motif = Motif(self.seq, self.d, self.revcom)
        k, targets = motif.k, [motif.code, motif.rc_code] if motif.revcom else [motif.code]
        if motif.d >= k:
            raise ValueError("the number of substitutions must be less than the motif's length")

        def masked(raw: np.ndarray) -> np.ndarray:
            """With N where a hit lies; hits are sought in the bytes as they were, tile by tile."""
            out = raw.copy()
            for a in range(0, len(raw), TILE):
                code, good = window_codes(raw[a : a + TILE + k - 1], k)
                hit = a + np.flatnonzero(good & np.logical_or.reduce([near(code, t, motif.d) for t in targets]))
                for i in range(k):
                    out[hit + i] = ord("N")
            return out

        return masked


#: Bytes of short sequences that are masked together.
TOGETHER = 4 << 20


def masked(seq: Column, patterns: list[RepeatMask | MotifMask]) -> Column:
    """The patterns in turn, each on what the one before has left, as one function over Arrow arrays. Masking changes no length, so the
    result takes the places of the bytes it is made from. Short sequences are worked on TOGETHER, a line break between them; a
    longer one by itself."""
    steps = [p.on_bytes() for p in patterns]

    def through(raw: np.ndarray) -> np.ndarray:
        for step in steps:
            raw = step(raw)
        return raw

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            starts, data = layout(part.fill_null(""))
            out, i = np.empty(starts[-1] - starts[0], np.uint8), 0
            while i < len(part):
                j = max(int(np.searchsorted(starts, starts[i] + TOGETHER, "right")) - 1, i + 1)
                whole = through(np.frombuffer(b"\n".join(data[a:b].tobytes() for a, b in zip(starts[i:j].tolist(), starts[i + 1 : j + 1].tolist(), strict=True)), np.uint8))
                inside = np.ones(len(whole), bool)
                inside[starts[i + 1 : j] - starts[i] + np.arange(j - i - 1)] = False
                out[starts[i] - starts[0] : starts[j] - starts[0]] = whole[inside]
                i = j
            places = (starts - starts[0]).astype(np.int32)
            yield pc.if_else(part.is_valid(), pa.StringArray.from_buffers(len(part), pa.py_buffer(places), pa.py_buffer(out)), None)

    return run(seq)


def mask_motif(seq: Column, motif: Motif) -> Column:
    """Every base that a hit covers becomes N; hits are sought in the text before any is masked."""
    return masked(seq, [MotifMask(motif.consensus, motif.d, motif.revcom)])


def mask_chain(reads: DataFrame, patterns: list[RepeatMask | MotifMask], column: str = "seq") -> DataFrame:
    """The sequences in upper case, masked by each pattern in turn. Repeats of one unit are built-in functions; with a motif or several patterns the
    whole chain is one function, so sequences go to Python and back once, however many patterns there are."""
    bound_batches(reads.sparkSession)
    if len(patterns) == 1 and isinstance(patterns[0], RepeatMask):
        return reads.withColumn(column, F.upper(column)).withColumn(column, patterns[0].apply(F.col(column)))
    return reads.withColumn(column, masked(F.upper(column), patterns) if patterns else F.upper(column))


def mark_up(reads: DataFrame, segments: DataFrame, tags: dict[int, str] | None = None) -> DataFrame:
    """seq_no, marked: the sequence with a tag around each piece that has one. segments: (seq_no, start, end, label), and ``motifs``
    where no tags are given: a piece is then named by the motifs that cover it, as motif1_3."""
    if tags is None:
        tag = F.when(F.size("motifs") > 0, F.concat(F.lit("motif"), F.array_join("motifs", "_")))
    else:
        tag = F.create_map(*(x for label, name in tags.items() for x in (F.lit(label).cast("long"), F.lit(name))))[F.col("label").cast("long")]
    parts = segments.groupBy("seq_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", tag.alias("tag")))).alias("parts"))

    def piece(x: Column) -> Column:
        text = F.col("seq").substr((x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        return F.when(x["tag"].isNull(), text).otherwise(F.concat(F.lit("<"), x["tag"], F.lit(">"), text, F.lit("</"), x["tag"], F.lit(">")))

    return reads.join(parts, "seq_no").select("seq_no", F.array_join(F.transform("parts", piece), "").alias("marked"))
