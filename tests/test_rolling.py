"""Codes rolled over tiles, super-k-mers, the seed index, and masking in one function."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions.codec import code_of, kmer_of
from strandwise.operators import counts as C
from strandwise.operators import kmers as K
from strandwise.operators import masking as X
from strandwise.operators import motifs as M
from strandwise.operators import rolling as R
from strandwise.operators import superkmers as S
from strandwise.sources import genome as G

SEQS = st.lists(st.one_of(st.none(), st.text("ACGTN", max_size=90), st.text("AC", max_size=200), st.integers(0, 120).map(lambda n: "T" * n)), min_size=1, max_size=8)


def windows_of(seqs, k):
    return [(i, p, s[p : p + k]) for i, s in enumerate(x or "" for x in seqs) for p in range(len(s) - k + 1) if not set(s[p : p + k]) - set("ACGT")]


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def tiled(monkeypatch, n):
    monkeypatch.setattr(R, "TILE", n)
    monkeypatch.setattr(S, "TILE", n)


@pytest.mark.parametrize("tile", [1, 7, 64, 1 << 20])
def test_windows_don_t_depend_on_tiles(monkeypatch, tile):
    tiled(monkeypatch, tile)

    @settings(max_examples=40, deadline=None)
    @given(SEQS, st.sampled_from([1, 2, 5, 13, 31]), st.integers(0, 2))
    def check(seqs, k, skip):
        seqs = seqs[skip:]
        array = pa.array([*(["ACGT"] * skip), *seqs], pa.string())[skip:]
        filled, found = pc.fill_null(array, ""), []
        for w in R.rolled(array, k):
            found += zip(w.row.tolist(), w.pos.tolist(), R.letters(filled, k, w.at).to_pylist(), w.code.tolist(), strict=True)
        assert found == [(*x, code_of(x[2])) for x in windows_of(seqs, k)]
        pairs = [(a, b) for row, code in K._distinct(R.rolled(array, k), k) for a, b in zip(row.tolist(), code.tolist(), strict=True)]
        assert sorted(pairs) == sorted({(i, code_of(x)) for i, _, x in windows_of(seqs, k)})

    check()


@pytest.mark.parametrize("tile", [9, 40, 1 << 20])
def test_runs_hold_every_k_mer_once_and_meet_by_k_mer(monkeypatch, tile):
    tiled(monkeypatch, tile)

    @settings(max_examples=40, deadline=None)
    @given(SEQS, st.sampled_from([[12], [12, 25], [13, 14, 31], [17, 31]]))
    def check(seqs, ks):
        starts, data = R.layout(pa.array([x or "" for x in seqs], pa.string()))
        met: dict[int, Counter] = {k: Counter() for k in ks}
        where: dict[tuple[int, int], set[int]] = {}
        for a in range(0, int(starts[-1]), S.TILE):
            raw = data[a : min(a + S.TILE + S.HALF, int(starts[-1]))]
            ends = starts[np.searchsorted(starts, a, "right") : np.searchsorted(starts, a + len(raw), "right")] - a
            for k, runs in zip(ks, S._runs(raw, ends, min(S.TILE, len(raw)), ks), strict=True):
                *runs, n = S._added_up(*runs)
                assert max(runs[3], default=0) <= S.RUN
                for bucket, first, second, bases, times in zip(*(x.tolist() for x in runs), n.tolist(), strict=True):
                    letters = (kmer_of(first, S.HALF) + kmer_of(second, S.HALF))[:bases]
                    assert bucket & 31 == k
                    for i in range(bases - k + 1):
                        met[k][code_of(letters[i : i + k])] += times
                        where.setdefault((k, code_of(letters[i : i + k])), set()).add(bucket)
        for k in ks:
            assert met[k] == Counter(code_of(x) for _, _, x in windows_of(seqs, k))
        assert all(len(x) == 1 for x in where.values())

    check()


def shuffled(frame):
    """Bytes written to shuffles by a query that has run, from the plan's metrics."""
    total, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        metric = node.metrics().get("shuffleBytesWritten")
        total += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_a_range_of_k_is_counted_with_one_pass_and_one_small_shuffle(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(4000)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string").repartition(3)
    found = S.count_ks(reads, [8, 12, 25, 31])
    plan = found._jdf.queryExecution().toString()
    rows = found.collect()
    for k in (8, 12, 25, 31):
        assert {r.kmer: r.n for r in rows if r.k == k} == Counter(x for _, _, x in windows_of(seqs, k))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning(bucket") == 1 and physical.count("Exchange") == 2  # the other one is the test's own
    alone = S.count_ks(reads.coalesce(2).persist(), [25])
    n = alone.agg(F.sum("n").alias("n"))
    total = n.first().n
    assert shuffled(n) / total < 4, (shuffled(n), total)


def test_one_read_that_is_a_third_of_all_is_added_up_before_the_shuffle(spark):
    rng = random.Random(8)
    hot = "".join(rng.choice("ACGT") for _ in range(100))
    seqs = [hot if i % 3 == 0 else "".join(rng.choice("ACGT") for _ in range(100)) for i in range(3000)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string").coalesce(1)
    rows = S.runs_of(reads, [25])
    held = rows.groupBy("bucket").count().agg(F.max("count").alias("most")).first().most
    assert held < 60
    assert {r.kmer: r.n for r in S.count_ks(reads, [25]).collect()} == Counter(x for _, _, x in windows_of(seqs, 25))


def test_memory_doesn_t_grow_with_a_sequence():
    rng = np.random.default_rng(1)
    seq = pa.array([np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, 50_000_000)].tobytes().decode()])
    tracemalloc.start()
    n = sum(len(w.code) for w in R.rolled(seq, 25))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 50_000_000 - 24 and peak < 150 << 20


def test_tiles_give_what_whole_sequences_give(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(rng.choice([0, 5, 64, 65, 300]))) for _ in range(20)]
    chromosomes = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "chrom string, seq string")
    cut = G.tiles(chromosomes, 64, 7).persist()
    assert max(len(r.seq) for r in cut.collect()) <= 71
    assert sorted((int(r.chrom), r.pos, r.kmer) for r in K.kmers_of_tiles(cut, 8).collect()) == windows_of(seqs, 8)
    motif = M.Motif("ACGTTC", 1)
    whole = M.motif_match(chromosomes.select(F.col("chrom").cast("long").alias("seq_no"), "seq"), motif)
    assert sorted((int(r.chrom), r.strand, r.pos) for r in M.match_tiles(cut, motif).collect()) == sorted((r.seq_no, r.strand, r.pos) for r in whole.collect())


def test_ball_takes_either_case_and_refuses_other_letters(spark):
    assert {(r.code, r.kmer) for r in K.hamming_ball(spark, "acgt", 1).collect()} == {(r.code, r.kmer) for r in K.hamming_ball(spark, "ACGT", 1).collect()}
    assert all(code_of(r.kmer) == r.code for r in K.hamming_ball(spark, "acgt", 1).collect())
    for bad in ("ACNT", "", "AC GT", None):
        with pytest.raises(ValueError):
            K.hamming_ball(spark, bad, 1)


def test_five_hundred_motifs_by_their_seeds(spark):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    motifs = [M.Motif(letters(k), d, revcom) for k, d, revcom in (rng.choice([(6, 1, True), (9, 2, True), (10, 2, False), (12, 3, True), (5, 0, True)]) for _ in range(497))]
    motifs += [M.Motif("ACGTACGT", 2), M.Motif("AACGTT", 1), M.Motif("AAATTA", 2)]  # palindromes, and one near to its own complement
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(120)) for _ in range(12)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string")
    distance = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    expected = set()
    for i, m in enumerate(motifs, 1):
        other = kmer_of(m.rc_code, m.k)
        expected |= {(s, i, p) for s, p, x in windows_of(seqs, m.k) if distance(x, m.consensus) <= m.d or (m.revcom and distance(x, other) <= m.d)}
    found = M.scan_motifs(reads, motifs)
    rows = [(r.seq_no, r.motif_id, r.pos) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def plainly_masked(seq, patterns):
    import re

    for p in patterns:
        if isinstance(p, X.RepeatMask):
            for unit in [p.unit, *([rc(p.unit)] if p.revcom else [])]:
                seq = re.sub(f"(?:{unit}){{{p.n_min},{'' if p.n_max is None else p.n_max}}}", lambda m: "N" * len(m[0]), seq)
        else:
            k, targets = len(p.seq), [p.seq, *([rc(p.seq)] if p.revcom else [])]
            hits = [i for i in range(len(seq) - k + 1) if not set(seq[i : i + k]) - set("ACGT") and any(sum(a != b for a, b in zip(seq[i : i + k], t, strict=True)) <= p.d for t in targets)]
            hidden = {i + j for i in hits for j in range(k)}
            seq = "".join("N" if i in hidden else b for i, b in enumerate(seq))
    return seq


def test_twenty_masks_are_one_function(spark):
    rng = random.Random(6)
    patterns = [X.MotifMask("".join(rng.choice("ACGT") for _ in range(6)), rng.choice([0, 1])) if i % 2 else X.RepeatMask(rng.choice(["A", "C", "AT", "CAG"]), rng.choice([2, 4, 7]), i % 3 > 0, rng.choice([None, 9])) for i in range(20)]
    seqs = ["".join(rng.choice("acgtACGTN") for _ in range(n)) for n in (0, 1, 5, 80, 300)] + [None, "CAG" * 30, "AT" * 20 + "G"]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string").coalesce(1)
    for some in (patterns, patterns[1:2], patterns[:1], [], [p for p in patterns if isinstance(p, X.RepeatMask)]):
        done = X.mask_chain(reads, some)
        assert [r.seq for r in done.orderBy("seq_no").collect()] == [None if s is None else plainly_masked(s.upper(), some) for s in seqs]
        assert done._jdf.queryExecution().executedPlan().toString().count("EvalPython") == (some not in ([], patterns[:1]))


def test_counts_per_sequence_need_no_shuffle(spark):
    reads = spark.createDataFrame([(0, "ACGACG"), (1, None), (2, "ACGNACG"), (2, "AAAA")], "seq_no long, seq string").coalesce(1)
    found = C.counts_per_sequence(reads, 3)
    assert sorted((r.seq_no, r.kmer, r.n) for r in found.collect()) == [(0, "ACG", 2), (0, "CGA", 1), (0, "GAC", 1), (2, "AAA", 2), (2, "ACG", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
