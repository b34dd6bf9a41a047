from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions import codec
from strandwise.operators import counts as C
from strandwise.operators import kmers as K

DNA = st.text("ACGT", min_size=1, max_size=31)


def reads(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string")


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@given(DNA)
def test_driver_codes_round_trip(s):
    code = codec.code_of(s)
    assert codec.kmer_of(code, len(s)) == s
    assert codec.kmer_of(codec.revcom_of(code, len(s)), len(s)) == rc(s)


def test_codes_in_columns(spark):
    for k in (1, 4, 5, 8, 16, 31):
        some = ["ACGT" * 8, "TTTT" * 8, "AAAA" * 8, "GATTACAT" * 4, "CCGGTTAA" * 4]
        rows = spark.createDataFrame([(s[:k],) for s in some], "kmer string").withColumn("code", codec.encode(F.col("kmer")))
        out = rows.select("kmer", "code", codec.decode(F.col("code"), k).alias("back"), codec.decode(codec.revcom_code(F.col("code"), k), k).alias("rc")).collect()
        for r in out:
            assert (r.code, r.back, r.rc) == (codec.code_of(r.kmer), r.kmer, rc(r.kmer))


def test_missing_bases_have_no_code(spark):
    row = spark.createDataFrame([("ACNT", "")], "a string, b string").select(codec.encode(F.col("a")).alias("a"), codec.encode(F.col("b")).alias("b")).first()
    assert row.a is None and row.b is None


def test_literal_cases(spark):
    row = spark.createDataFrame([("AACTG", "GGATCC", "ANN")], "a string, p string, n string").select(codec.revcom(F.col("a")).alias("a"), codec.is_palindrome(F.col("p")).alias("p"), codec.is_palindrome(F.col("a")).alias("q"), codec.revcom(F.col("n")).alias("n")).first()
    assert (row.a, row.p, row.q, row.n) == ("CAGTT", True, False, "NNT")
    assert [codec.mutation_limit(k) for k in (3, 4, 7, 8, 20)] == [0, 1, 1, 2, 2]


def test_hamming_agrees_with_strings(spark):
    pairs = [("ACGTACGT", "ACGTTCGA"), ("AAAA", "TTTT"), ("GATTACA", "GATTACA"), ("A" * 31, "C" * 31)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", codec.hamming(codec.encode(F.col("a")), codec.encode(F.col("b"))).alias("d"))
    assert all(r.d == sum(x != y for x, y in zip(r.a, r.b, strict=True)) for r in rows.collect())


def test_ball(spark):
    ball = {r.kmer for r in K.hamming_ball(spark, "AACTG", 1).collect()}
    assert len(ball) == 16 and {"CACTG", "GACTG", "TACTG", "ACCTG", "AACTT"} <= ball
    assert K.hamming_ball(spark, "AACTG", 2).count() == 1 + 15 + 10 * 9


def test_windows_with_missing_bases_and_short_sequences(spark):
    rows = K.kmers(reads(spark, "ACGNACGT", "AC", "", "NNNN"), 3).orderBy("seq_no", "pos").collect()
    assert [(r.seq_no, r.pos, r.kmer) for r in rows] == [(0, 0, "ACG"), (0, 4, "ACG"), (0, 5, "CGT")]


def test_counts_modes_and_totals(spark):
    some = reads(spark, "AAAAA", "AAACC", "")
    unique = {r.kmer: r.n for r in C.count_kmers(some, 3).collect()}
    every = {r.kmer: r.n for r in C.count_kmers(some, 3, False).collect()}
    assert unique == {"AAA": 2, "AAC": 1, "ACC": 1} and every == {"AAA": 4, "AAC": 1, "ACC": 1}
    assert tuple(C.collection_summary(some, 3).first()) == (3, 6, 3)


def test_pairs_count_palindromes_once(spark):
    counts = C.count_kmers(reads(spark, "ACGT", "ACGT", "AAAC", "GTTT"), 4)
    pairs = {r.kmer: (r.n, r.rc_n, r.pair_n, r.is_palindrome) for r in C.strand_pairs(counts, 4).collect()}
    assert pairs == {"ACGT": (2, 2, 2, True), "AAAC": (1, 1, 2, False)}


def test_merge_keeps_pairs_seen_on_the_other_strand_only(spark):
    counts = C.count_kmers(reads(spark, "GTTT"), 4)
    assert [(r.kmer, r.n) for r in C.merge_revcom(counts, 4).collect()] == [("AAAC", 1)]
    assert C.merge_revcom(counts, 4, drop_unpaired=True).count() == 0
    assert [r.kmer for r in C.merge_revcom(counts, 4, keep_lower=False).collect()] == ["GTTT"]


def test_derived_counts_never_exceed_direct_ones(spark):
    seq = "ACGTTGCAAGGCTTACGATCGATCGGATTACAGGCATCGATCGACTAGCTAGCTGATCGATCGTAGCTAGCTAGCATCGACTGCAT"
    some = reads(spark, seq)
    direct = {r.kmer: r.n for r in C.count_kmers(some, 8, False).collect()}
    derived = {r.kmer: r.n for r in C.convert_counts(C.count_kmers(some, 11, False), 11, 8).collect()}
    assert derived and all(n <= direct[x] for x, n in derived.items())
    assert {x for x in direct if derived.get(x, 0) < direct[x]} <= {seq[i : i + 8] for i in (*range(3), *range(len(seq) - 10, len(seq) - 7))}


def test_contained_motifs_on_both_strands(spark):
    big = "TTGATTACATT"
    rows = spark.createDataFrame([(big,), (rc(big),), ("CCCCCCCCCCC",)], "kmer string").withColumn("code", codec.encode(F.col("kmer")))
    assert [r[0] for r in rows.select(K.contain_motif(F.col("code"), 11, "GATTACA", 0)).collect()] == [True, True, False]
    assert [r[0] for r in rows.select(K.contain_motif(F.col("code"), 11, "GATTACA", 0, False)).collect()] == [True, False, False]


def test_query_list(spark):
    import pytest

    counts = C.count_kmers(reads(spark, "AAAC", "GTTT", "ACGT"), 4)
    rows = {r.kmer: (r.n, r.rc_n, r.pair_n) for r in C.query_kmers(counts, C.kmer_list(spark, ["AAAC", "ACGT", "CCCC"]), 4).collect()}
    assert rows == {"AAAC": (1, 1, 2), "ACGT": (1, 1, 1), "CCCC": (0, 0, 0)}
    with pytest.raises(ValueError):
        C.query_kmers(counts, C.kmer_list(spark, ["AAA"]), 4)


def test_sample_is_repeatable_and_keeps_the_top(spark):
    counts = C.count_kmers(reads(spark, "ACGTTGCAAGGCTTACGATCGATCGGATTACAGG"), 4)
    top = C.top_kmers(counts, 4, 2)
    a, b = ({r.kmer for r in C.sample_kmers(counts, 4, top, 5).collect()} for _ in range(2))
    assert a == b and {r.kmer for r in top.collect()} <= a
    assert not any(rc(x) in a for x in a if rc(x) != x)


def test_first_seen_order(spark):
    some = reads(spark, "CCCC", "GAGA")
    rows = C.top_kmers_first_seen(some, C.count_kmers(some, 4), 4, 2).collect()
    assert [r.kmer for r in rows] == ["CCCC", "GAGA"]
