import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import topk as T

SHAPE = "id long, code long"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(rows, asked, k):
    out = {}
    for q, code in asked.items():
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in rows.items() if i != q)[:k]
        out |= {(q, n): (i, d) for n, (d, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_against_brute_force(spark, spread):
    rng = random.Random(spread)
    centres = [rng.getrandbits(64) for _ in range(5)]
    rows = {}
    for i in range(300):
        code = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            code ^= 1 << rng.randrange(64)
        rows[i] = signed(code if spread < 64 else rng.getrandbits(64))
    rows |= {1000 + i: rows[7] for i in range(40)}  # a very common code
    base = spark.createDataFrame(list(rows.items()), SHAPE)
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.distance) for r in T.search(base, base.where("id % 20 = 0"), 10).collect()}
    assert got == brute(rows, {i: c for i, c in rows.items() if i % 20 == 0}, 10)


def test_fewer_rows_than_asked_for_nulls_and_repeats(spark):
    base = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (None, 3), (4, None)], SHAPE)
    assert sorted(tuple(r) for r in T.search(base, base, 10).collect()) == [(1, 1, 2, 1), (2, 1, 1, 1)]


def test_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    some = spark.createDataFrame([(1, 5)], SHAPE)
    assert T.search(none, none).count() == 0 and T.search(some, none).count() == 0 and T.search(none, some).count() == 0


def test_many_ties_at_the_last_place(spark):
    """Hundreds of codes at the same distance: the smallest ids win, and no more than k + 1 codes are kept."""
    rng = random.Random(12)
    rows = {0: 0, 20: 5} | {1000 - i: signed(1 << rng.randrange(64) | 1 << (i % 64)) for i in range(300)}
    base = spark.createDataFrame(list(rows.items()), SHAPE)
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.distance) for r in T.search(base, base.where("id in (0, 20)"), 5).collect()}
    assert got == brute(rows, {0: 0, 20: 5}, 5)


def test_sign_code_of_odd_vectors(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [1.0]), (3, [float("nan"), -1.0, None, 0.5])], "id long, v array<float>")
    got = {r.id: r.code for r in rows.select("id", T.sign_code(F.col("v")).alias("code")).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 9}


def test_sign_code(spark):
    row = spark.createDataFrame([([0.5, -1.0, 0.0] + [0.0] * 60 + [2.0],)], "v array<float>").select(T.sign_code(F.col("v"))).first()
    assert row[0] == signed(1 | 1 << 63)
