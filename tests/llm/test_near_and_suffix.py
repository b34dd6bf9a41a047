import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import components as C
from strandwise.llm import minhash as M
from strandwise.llm import suffix_dedup as S
from strandwise.llm.components import components

from .conftest import make, prose


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(texts, size, percent):
    sets = [shingle_set(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_against_brute_force(docs, texts, size, percent):
    expected, sets = brute_components(texts, size, percent)
    for r in M.near_duplicates(docs, size, percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_a_large_group_of_near_copies_with_outsiders(spark):
    """Copies of one text with one to many changes: some are linked only through others, some with none."""
    rng = random.Random(3)
    words = prose(rng, 150).split()
    some = []
    for _ in range(160):
        out = list(words)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
        some.append(" ".join(out))
    expected, _ = brute_components(some, 3, 85)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(make(spark, some), 3, 85).collect()}
    assert [got[i] for i in range(len(some))] == expected and len(set(expected)) > 1


def test_near_deduplication_keeps_one_with_all_columns(docs, texts):
    kept = M.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_components(texts, 5, 80)[0]))


def test_different_texts_that_share_a_doc_id_all_stay(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    near = a.rsplit(" ", 1)[0] + " end"
    rows = make(spark, [a, b, near, " ", "", b, b.upper()]).withColumn("doc_id", (F.col("doc_id") - F.col("doc_id") + 1).cast("long"))
    kept = sorted((r.text or "").lower().split()[:1] for r in M.deduplicate(rows).collect())
    assert kept == sorted([a.lower().split()[:1], b.lower().split()[:1], []])


@pytest.mark.parametrize("part", [1000, 7])
def test_large_buckets_in_parts(spark, monkeypatch, part):
    """A third of all texts are near copies of one; some are linked over others only."""
    monkeypatch.setattr(M, "PART", part)
    rng = random.Random(9)
    words = prose(rng, 120).split()
    some = [prose(rng, 40) for _ in range(60)]
    for _ in range(60):
        out = list(words)
        for _ in range(rng.choice([1, 2, 3, 5])):
            out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
        some.append(" ".join(out))
    expected, _ = brute_components(some, 5, 80)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(make(spark, some)).collect()}
    assert [got[i] for i in range(len(some))] == expected


def test_nothing_in_nothing_out(empty):
    assert M.near_duplicates(empty).count() == 0 and M.deduplicate(empty).count() == 0


def test_repeated_rows_share_their_class(docs):
    rows = M.near_duplicates(docs.union(docs), 3, 85).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows).most_common()[-1][1] == 2


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    x = M.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]), 128)
    assert abs((x[0] == x[1]).mean() - 1600 / 2400) < 0.1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_removed_bytes_against_brute_force(docs, texts, hot):
    expected = brute_removed(texts, 200)
    for r in S.remove_repeats(docs, hot=hot).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_text)) == expected[r.doc_id]


def test_periods_and_overlaps(spark):
    some = ["ab" * 300, "x" + "ab" * 150, "abc" * 70, "q" * 199, "q" * 200, "q" * 201, "é" * 150, "z" + "é" * 150]
    expected = brute_removed(some, 200)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(make(spark, some), with_text=False).collect()} == {i: e[:4] for i, e in enumerate(expected)}


@pytest.mark.parametrize(("part", "hot"), [(3, 20_000), (3, 5), (1000, 20_000)])
def test_a_passage_in_a_third_of_all_texts(spark, monkeypatch, part, hot):
    """Shared whole or cut off, dealt over parts; strings that a polynomial hash modulo 2**64 can't tell apart; texts that share a doc_id."""
    monkeypatch.setattr(S, "PART", part)
    rng = random.Random(11)
    passage, morse = prose(rng, 70), "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    some = [f"{prose(rng, 20)} {passage[rng.randrange(60) :]} {prose(rng, 10)}" for _ in range(30)]
    some += [prose(rng, 60) for _ in range(40)] + [f"{prose(rng, 3)} {passage} {prose(rng, 3)}" for _ in range(10)]
    some += [morse[:1024] + prose(rng, 40), morse[1024:] + prose(rng, 40)]
    expected = brute_removed(some, 200)
    rows = make(spark, some).withColumn("n_chars", F.col("doc_id")).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    docs = rows.withColumn("lang", F.col("n_chars").cast("string"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, hot=hot, with_text=False).collect())
    assert got == sorted((i // 2, *e[:4]) for i, e in enumerate(expected))


def test_long_texts_are_cut_into_pieces():
    off = np.array([0, 10, 5000, 5000, 5020])
    parts = list(S.pieces(off, 200, 1000))
    covered = sorted((a, b) for _, _, a, b in parts)
    assert covered[0] == (0, 10) and all(b - a <= 1199 for a, b in covered)
    starts = {s for i, j, a, b in parts for s in range(a, b - 199)}
    assert set(range(10, 5000 - 199)) <= starts


def test_no_rows_and_repeated_rows(spark, empty):
    assert S.remove_repeats(empty).count() == 0
    rng = random.Random(2)
    one = make(spark, [prose(rng, 80), "short"])
    rows = S.remove_repeats(one.union(one)).collect()
    assert len(rows) == 4 and all(r.n_removed == (r.n_bytes if r.n_bytes >= 200 else 0) for r in rows)


def test_small_working_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: each file costs an executor a commit and, locally, processes."""
    most, files = spark.sparkContext.defaultParallelism, {}
    for module in (M, C):
        monkeypatch.setattr(module, "stored", lambda df, tag, f=module.stored: (out := f(df, tag), files.setdefault(tag, []).append(len(out.inputFiles())))[0])
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    rng = random.Random(4)
    words = prose(rng, 150).split()
    some = [prose(rng, 30) for _ in range(20)]
    for _ in range(60):
        out = list(words)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
        some.append(" ".join(out))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in M.near_duplicates(make(spark, some), 3, 85).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[i] for i in range(len(some))] == brute_components(some, 3, 85)[0]
    assert {"classes", "members", "ids", "sets", "sharp", "links", "labels"} <= set(files)
    assert all(max(files[t]) <= most for t in ("classes", "members", "ids", "sets", "sharp", "links", "labels")), files
