"""Mixing sources to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of the labels table, gives every document its posterior over the
domains. Document rates are then found by projected gradient descent on the squared, relative distance between the
expected tokens of each domain, sum of rate * tokens * posterior, and their targets; the projection keeps a
rate between 0 and ``most``. Tokens are those that packing counts.

The gradient of a document's rate is its tokens times posterior . residual; its step size is the inverse of a bound on the curvature,
tokens times posterior . (natural / target), so the tokens cancel and documents with equal posteriors keep equal rates. That
is why one pass over the documents is enough: it adds up tokens by cells of the posterior (``GRID`` steps a domain), with their exact
sums for each domain, and the descent, with momentum, goes on over the table of cells. It ends when every target is met, or when it is
proven that they can't all be: a bound on the least possible distance (the duality gap) shows that what was reached is within
``GAP`` of it.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, stored, text_key
from .packing import public_encoder
from .text_kernel import buffers
from .text_model import DIMS, SAMPLE, Sample, descend, labelled_sample, scores_of_present

#: Domains, told from a row of the labels table.
DOMAINS = ["low", "toxic", "clean"]
WEIGHTS = {"low": 0.03, "toxic": 0.05, "clean": 0.92}
STEPS, RATE, SHRINK = 120, 0.1, 1e-5
#: Features count that this many labelled documents have, by how far their log odds are from even, less so many standard errors.
SEEN, ERRORS = 3, 2.0
#: Parts of a posterior's range that make cells.
GRID = 100
#: A target is met within this share. Steps between two writings of the rates (their expression grows with them).
CLOSE, TURNS = 1e-3, 40
#: Targets that can't be met: the distance left is at most this share above the least possible. Passes after which the descent stops, with a warning.
GAP, LIMIT = 0.01, 1000
#: With ``cover``: the target of the covered domain, as a multiple of all its tokens.
REACH = 1.05
#: Rows of 50 bytes sent to all executors at once, at most; a larger table of cells is joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def domain_of_labels(domains: Sequence[str] = DOMAINS) -> Column:
    """The domain's number among ``domains``; null where it is none of them."""
    name = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return F.nullif(F.array_position(F.lit(list(domains)), name).cast("int"), F.lit(0)) - 1


@dataclass
class Softmax:
    weights: np.ndarray  # (DIMS, domains)
    bias: np.ndarray

    def posteriors(self, s: np.ndarray) -> np.ndarray:
        e = np.exp((z := s + self.bias) - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def evidence(sample: Sample, n_domains: int) -> np.ndarray:
    """For each feature how surely its presence tells domains apart: the largest, over the domains, of the log of how much more often
    (or less) it is present there than elsewhere, less ERRORS standard errors; squared."""
    n = np.bincount(sample.label, minlength=n_domains)[:, None]
    of_row = np.repeat(sample.label, np.diff(sample.at))
    seen = np.stack([np.bincount(sample.idx[of_row == k], minlength=DIMS) for k in range(n_domains)])
    elsewhere = seen.sum(axis=0) - seen
    odds = np.log((seen + 0.5) / (n + 1)) - np.log((elsewhere + 0.5) / (n.sum() - n + 1))
    error = np.sqrt(1 / (seen + 0.5) + 1 / (elsewhere + 0.5))
    sure = np.maximum(np.abs(odds) - ERRORS * error, 0).max(axis=0) ** 2
    return np.where(seen.sum(axis=0) >= SEEN, sure, 0.0)


def fit(sample: Sample, n_domains: int, steps: int = STEPS) -> Softmax:
    """Maximum likelihood over present features, each scaled by its evidence, with a slight shrinkage; without labels all domains are
    equally likely."""
    y = np.eye(n_domains)[sample.label] if len(sample.label) else np.zeros((0, n_domains))
    n = max(1, len(y))
    scale = 0.1 * evidence(sample, n_domains)
    scaled = replace(sample, value=scale[sample.idx])

    def gradient(p: np.ndarray) -> np.ndarray:
        w = p[: DIMS * n_domains].reshape(n_domains, DIMS)
        model = Softmax(w.T, p[DIMS * n_domains :])
        g = (model.posteriors(np.stack([scaled.times(x) for x in w], axis=1)) - y) / n
        return np.concatenate([*(scaled.back(g[:, k]) + SHRINK * w[k] for k in range(n_domains)), g.sum(axis=0)])

    start = np.concatenate([np.zeros(DIMS * n_domains), np.log(y.sum(axis=0) / n + 1e-3) if len(y) else np.zeros(n_domains)])
    p = descend(gradient, start, steps, RATE) if len(y) else start
    return Softmax(np.ascontiguousarray(scale[:, None] * p[: DIMS * n_domains].reshape(n_domains, DIMS).T), p[DIMS * n_domains :])


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, domains: Sequence[str] = DOMAINS) -> Softmax:
    """A classifier of these domains; labelled documents of other ones are left out."""
    return fit(labelled_sample(docs, labels, domain_of_labels(domains), 0.0, limit), len(domains))


def memberships(docs: DataFrame, model: Softmax, domains: list[str] = DOMAINS, make_encoder: Callable = public_encoder) -> DataFrame:
    """doc_id, h (key of the text), tokens, and p_<domain> for each domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            raw, off = buffers(batch.column(1))
            p = model.posteriors(scores_of_present(raw, off, model.weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(encode(x.as_py())) for x in batch.column(1)], pa.int64()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))], ["doc_id", "h", "tokens", *(f"p_{d}" for d in domains)])

    small_batches(docs.sparkSession)
    return documents(docs, text_key().alias("h")).mapInArrow(run, "doc_id long, h long, tokens long, " + ", ".join(f"p_{d} double" for d in domains))


def cell_of(domains: list[str]) -> list[Column]:
    """The cell of a posterior: one number for each domain but the last."""
    return [F.floor(F.col(f"p_{d}") * GRID).cast("int").alias(f"c_{d}") for d in domains[:-1]]


def cells_of(held: DataFrame, domains: list[str]) -> DataFrame:
    """A row for each cell: its key, tokens, and p_<domain>: the share of its tokens that the domain is expected to have, so that
    no rounding enters the domains' totals. At most comb(GRID + domains, domains - 1) rows, however many documents."""
    keys = cell_of(domains)
    mean = [F.coalesce(F.try_divide(F.sum(F.col("tokens") * F.col(f"p_{d}")), F.sum("tokens")), F.avg(f"p_{d}")).alias(f"p_{d}") for d in domains]
    return held.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), *mean)


def moved(cells: DataFrame, steps: list[list[float]], domains: list[str], most: float) -> DataFrame:
    """cells (with rate, and ``before``: the rate one step earlier) after the given steps: for each, one number and one divisor
    for each domain, and the momentum."""
    if not steps:
        return cells
    n = len(domains)

    def step(state: Column, by: Column) -> Column:
        at = state["rate"] + F.get(by, F.lit(2 * n)) * (state["rate"] - state["before"])
        down, over = (sum((F.col(f"p_{d}") * F.get(by, F.lit(first + k)) for k, d in enumerate(domains)), F.lit(0.0)) for first in (0, n))
        return F.struct(F.least(F.greatest(at - down / F.greatest(over, F.lit(1e-9)), F.lit(0.0)), F.lit(most)).alias("rate"), state["rate"].alias("before"))

    # An array of the steps keeps the expression's size fixed.
    state = F.aggregate(F.lit(steps).cast("array<array<double>>"), F.struct("rate", "before"), step)
    return cells.withColumn("state", state).withColumns({"rate": F.col("state.rate"), "before": F.col("state.before")}).drop("state")


def solve(held: DataFrame, weights: dict[str, float], budget: float | None, cover: str | None, most: float) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """held (tokens, p_<domain>...) with ``rate``, the targets, and the expected totals that were reached. They differ by more than CLOSE
    only where the targets can't all be met; then the rates are the best ones but for GAP. Where LIMIT passes show neither, the rates
    of the last one, with a warning.

    budget: tokens in all, as a multiple of the input's. cover: instead, choose the budget so that this domain's target
    is REACH times all its expected tokens, so that nothing of it has to go."""
    domains = list(weights)
    keys = [f"c_{d}" for d in domains[:-1]]

    def totals(rated: DataFrame, off: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Expected totals at ``rate``; with off, the residuals at ``before``: also the duality gap there."""
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in domains]
        if off is not None:
            slope = sum((F.col(f"p_{d}") * F.lit(float(x)) for d, x in zip(domains, off, strict=True)), F.lit(0.0))
            sums.append(F.sum(F.col("tokens") * F.greatest(slope * F.col("before"), slope * (F.col("before") - F.lit(most)))).alias("_gap"))
        row = rated.agg(*sums).first()
        return np.array([row[d] or 0.0 for d in domains]), (row["_gap"] or 0.0) if off is not None else math.inf

    def of_documents(cells: DataFrame, rate: str) -> DataFrame:
        rates = stored(cells.select(*keys, F.col(rate).alias("rate")), "rates")
        few = rates.count() <= BROADCAST_CELLS
        return held.withColumns(dict(zip(keys, cell_of(domains), strict=True))).join(F.broadcast(rates) if few else rates, keys).drop(*keys)

    start = F.lit(min(1.0, most))
    cells = stored(cells_of(held, domains).withColumns({"rate": start, "before": start}), "cells")
    named = lambda x: dict(zip(domains, x, strict=True))
    now, _ = totals(cells)
    natural = now / min(1.0, most)
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    if cover is not None:
        total = REACH * natural[domains.index(cover)] / share[domains.index(cover)]
    else:
        total = (1.0 if budget is None else budget) * natural.sum()
    target = np.maximum(share * total, 1e-9)
    off = (now - target) / target
    if natural.sum() == 0 or np.abs(off).max() < CLOSE:
        return of_documents(cells, "rate"), named(target), named(now)

    # The distance is half the sum of target * off ** 2. A step of 1 / sum(p * natural / target) can't raise it.
    at, steps, past, turn = cells, [], now, 1.0
    for _ in range(LIMIT):
        after = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        momentum, turn = (turn - 1) / after, after
        ahead = (now + momentum * (now - past) - target) / target  # totals are linear in the rates
        steps.append([*map(float, ahead), *map(float, natural / target), momentum])
        reached, gap = totals(moved(at, steps, domains, most), off)
        distance = (target * off**2).sum() / 2
        if gap <= GAP * distance:
            return of_documents(moved(at, steps, domains, most), "before"), named(target), named(now)
        past, now = now, reached
        off = (now - target) / target
        if np.abs(off).max() < CLOSE:
            return of_documents(moved(at, steps, domains, most), "rate"), named(target), named(now)
        if (target * off**2).sum() / 2 > distance:
            turn = 1.0
        if len(steps) == TURNS:
            at, steps = stored(moved(at, steps, domains, most), "cells"), []
    warnings.warn(f"after {LIMIT} passes the totals {named(now)} neither meet the targets {named(target)} nor are known to be the nearest", stacklevel=3)
    return of_documents(moved(at, steps, domains, most), "rate"), named(target), named(now)


def mix(docs: DataFrame, model: Softmax, weights: dict[str, float] = WEIGHTS, budget: float | None = None, cover: str | None = None, most: float = 1.0, seed: int = 0, make_encoder: Callable = public_encoder) -> DataFrame:
    """One row per row of docs: doc_id, h (key of the text), tokens, p_<domain>..., rate, copies. ``copies``: the rate rounded up or
    down by a hash of the row, so that on average it is the rate.

    Null and empty texts have no tokens; they follow the prior. Repeated rows get the same rate. An empty table gives
    no rows. weights: relative, one for each domain of the model. Targets that no rates between 0 and ``most`` meet
    (but for that of a covered domain, which is out of reach on purpose) are approached as far as can be, with a warning
    that names them."""
    domains = list(weights)
    held = stored(memberships(docs, model, domains, make_encoder), "memberships")
    rated, target, reached = solve(held, weights, budget, cover, most)
    missed = {d: reached[d] / target[d] for d in domains if d != cover and abs(reached[d] / target[d] - 1) >= CLOSE and sum(reached.values()) > 0}
    if missed:
        warnings.warn("out of reach; share of the target that is reached: " + ", ".join(f"{d} {x:.3f}" for d, x in missed.items()), stacklevel=2)
    dice = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def resample(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """docs with each row as often as ``copies`` says (rates of at most 1: rows stay or go). Rows are told by doc_id and text."""
    times = mixed.groupBy(F.col("doc_id").alias("key"), "h").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_key().alias("h"), F.struct("*").alias("row"))  # so that no column's name can clash
    return rows.join(times, ["key", "h"]).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
