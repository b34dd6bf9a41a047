"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, letters without their accents, look-alike letters of other scripts as plain letters; in words that
have letters, digits become the letters that they stand for (plain numbers stay numbers); letters spelt out with marks or spaces
between become a word; everything else becomes a space. An Aho-Corasick automaton finds the lexicon's entries (whole words
and beginnings of words) in one pass. Matches inside an exception phrase don't count; each word counts once, with
its heaviest entry. The sum of weights, also normalised by length, goes through a calibrated logistic function.

Seeds are written down; further entries and all weights come from labelled rows. What is learned is bounded
(parameters of ``learn``: rows, entries, letters of a word's beginning, and how often an entry must have been seen); scoring covers every whole text, in its own row, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches
from .text_model import descend, sigmoid

# Words that are insults or threats by themselves.
SEEDS = "asshole bastard bitch clown cretin cunt degenerate despicable dickhead disgusting dumbass faggot fool freak garbage halfwit idiot imbecile jackass jerk kike loser lunatic moron nigger parasite pathetic pig prick retard scum scumbag slut stupid subhuman swine trash vermin whore worthless arschloch dumm idiota imbecil estupido basura pendejo cabron connard salaud ordure stupide minable".split()
# Phrases in which such a word is none.
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "pig iron", "guinea pig", "class clown act", "garbage collector", "garbage collection", "garbage truck", "fool proof", "jerk chicken", "freak wave", "prick test", "loser bracket", "trash talk radio"]
# Look-alikes of plain letters (Cyrillic, Greek, IPA, full width by rule below), and digits read as letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтЬαοενρτυχικɡıɑʟոսց", "aeopcyxijshdqwbkmhtbaoevptuxikgialnug", strict=True))
DIGITS = str.maketrans("0123456789", "oizeasbtbg")
SAMPLE, MAX_TERMS, SHORTEST, LONGEST, LEAST_SEEN = 16_000, 4000, 5, 9, 3
#: Zero-width characters, which may hide a word, are taken out.
HIDDEN = "​‌‍⁠﻿­"


class _Fold(dict):
    """A table for str.translate that works out each character once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        parts = [] if c in HIDDEN else [LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x)]
        out = self[code] = "".join(x if x.isalnum() else " " for x in parts)
        return out


_FOLD = _Fold()
#: Letters with one mark between every two of them.
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[.*·_~-][^\W_]){2,}(?![^\W_])")
_MARKS = str.maketrans("", "", ".*·_~-")
#: Single letters as words, four at least.
_LETTERS = re.compile(r" (?:[^\W\d_] ){4,}")
#: Words of letters and digits.
_MIXED = re.compile(r"\b(?=[^\W\d_]*\d)(?=\d*[^\W\d_])\w+")


def fold(text: str) -> str:
    """The folded words, each with one space before it, and a space at the end."""
    text = _SPELT.sub(lambda m: m.group().translate(_MARKS), text.lower())
    words = text.translate(_FOLD).split()
    if not words:
        return " "
    folded = " " + " ".join(words) + " "
    folded = _MIXED.sub(lambda m: m.group().translate(DIGITS), folded)
    return _LETTERS.sub(lambda m: " " + m.group().replace(" ", "") + " ", folded)


def split_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out of all learning."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


@dataclass
class Lexicon:
    terms: dict[str, float]  # " word " or " beginning"
    exceptions: list[str]
    calibration: np.ndarray  # intercept and weights of ``measures``

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (len(fold(phrase)), None))
        found.make_automaton()
        return found


def measures(folded: str, automaton) -> tuple[float, float, float, float]:  # noqa: ANN001
    """Sum of weights, heaviest weight, sum by the root of the length in words, root of the number of heavy words."""
    words: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            free.append((start, end - 1))
        elif words.get(start, -1.0) < weight:
            words[start] = weight
    if free:
        words = {s: w for s, w in words.items() if not any(a <= s < b for a, b in free)}
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    total = sum(words.values())
    n = max(1, folded.count(" ") - 1)
    return total, max(words.values()), total / n**0.5, sum(w >= 2 for w in words.values()) ** 0.5


def _terms(folded: str, longest: int = LONGEST) -> set[str]:
    out = set()
    for word in set(folded.split()):
        if word.isdigit():
            continue
        out.add(f" {word} ")
        for n in range(SHORTEST, min(longest, len(word)) + 1):
            out.add(" " + word[:n])
    return out


def labelled(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows outside the held-out fifth, by the hash of their id: (doc_id, label, part)."""
    rows = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"), split_of().cast("int").alias("part")).where("part > 0")
    return rows.orderBy(F.xxhash64("doc_id"), "label").limit(limit).dropDuplicates(["doc_id"])


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, most_terms: int = MAX_TERMS, longest: int = LONGEST, least_seen: int = LEAST_SEEN) -> Lexicon:
    """Entries and weights from parts 1 to 3, calibration from part 4 (so weights of chance finds don't count).

    limit: labelled rows, at most. What the lexicon may hold is bounded by parameters too: the ``most_terms`` best entries besides the
    seeds, beginnings of words up to ``longest`` letters (whole words of any length), seen in ``least_seen`` toxic texts. Without labels of both kinds the seeds stand alone, with equal weights.
    """
    small_batches(docs.sparkSession)
    some = labelled(labels, limit)
    rows = documents(docs).join(F.broadcast(some), "doc_id").select("text", "label", "part").persist()  # broadcast: ``limit`` rows of 16 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label == 1].update(_terms(fold(text), longest))
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    train = rows.where("part < 4")
    n = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    terms = {fold(x): 3.0 for x in SEEDS}
    if n1 and n0:
        odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
        counted = train.select("text", "label").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # A standard error below the log odds, so that rare entries weigh little.
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        best = counted.where(F.col("toxic") >= least_seen).select("term", (odds - error).alias("weight"), F.col("toxic")).where("weight > 1").orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(most_terms)
        terms |= {r.term: float(r.weight) for r in best.collect()}
    lexicon = Lexicon(terms, EXCEPTIONS, np.array([-3.0, 0.0, 1.2, 0.0, 0.0]))
    held = lexicon.__dict__.copy()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(**held).automaton()
        for batch in batches:
            found = np.array([measures(fold(t), automaton) for t in batch.column(0).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(found[:, k]) for k in range(4))], ["label", "a", "b", "c", "d"])

    if n1 and n0:
        seen = rows.where("part = 4").select("text", "label").mapInArrow(measure, "label int, a double, b double, c double, d double").toArrow()
        x = np.stack([seen[c].to_numpy() for c in "abcd"], axis=1) if len(seen) else np.zeros((0, 4))
        y = (seen["label"].to_numpy() == 1).astype(float)
        if 0 < y.sum() < len(y):
            lexicon.calibration = calibrate(x, y)
    rows.unpersist()
    return lexicon


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with weights that aren't negative: more or heavier words never lower a score."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    z = x / scale

    def gradient(p: np.ndarray) -> np.ndarray:
        w = np.exp(p[1:])
        g = (sigmoid(p[0] + z @ w) - y) / len(y)
        return np.concatenate([[g.sum()], (g @ z) * w]) + 1e-4 * np.concatenate([[0.0], p[1:]])

    p = descend(gradient, np.array([-2.0, 0, 0, 0, 0]), 600, 0.05)
    return np.concatenate([p[:1], np.exp(p[1:]) / scale])


def score(docs: DataFrame, lexicon: Lexicon, *more: Column) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), n_hits_weight (sum of weights), and ``more``.

    Null and empty texts, and texts without any entry, get the score of no evidence. Repeated rows score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = np.array([measures(fold(t), automaton) for t in batch.column(1).to_pylist()], float).reshape(-1, 4)
            p = sigmoid(lexicon.calibration[0] + found @ lexicon.calibration[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(found[:, 0]), *batch.columns[2:]], ["doc_id", "score", "weight", *batch.schema.names[2:]])

    small_batches(docs.sparkSession)
    rows = documents(docs, *more)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, "doc_id long, score double, weight double" + (", " + kept if kept else ""))
