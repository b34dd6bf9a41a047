import pytest
from pyspark.sql import functions as F

from strandwise.operators import counts as C
from strandwise.operators import genome as G
from strandwise.operators import intervals as V
from strandwise.operators import masking as X
from strandwise.operators import motifs as M
from strandwise.plans import chipseq as P
from strandwise.plans import discovery as D
from strandwise.plans import jobs as J
from strandwise.sources import archive, fasta
from strandwise.sources import genome as S
from strandwise.streaming import counts as T

TEXT = "AAAAAAAAAAACGTGCCCCCGTGGGGGCGTGAAAACACGCCCCCACGTTTTCACGTTTTCACG"


def reads(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string")


def test_masks_one_after_the_other(spark):
    steps = [X.RepeatMask("A", 4), X.RepeatMask("C", 4), X.MotifMask("CGTG", 1, False)]
    made = [X.mask_chain(reads(spark, "AAAACGTGCCCCCGTGAAACACGTTTTCACG"), steps[:n]).first().seq for n in (1, 2, 3)]
    assert made == ["NNNNCGTGCCCCCGTGAAACACGNNNNCACG", "NNNNCGTGNNNNNGTGAAACACGNNNNCACG", "NNNNNNNNNNNNNGTGAAACACGNNNNCACG"]


def test_repeats_with_a_limit_and_short_runs(spark):
    row = reads(spark, "ATATATATGAT").select(X.mask_runs(F.col("seq"), "AT", 2, 3).alias("a"), X.mask_runs(F.col("seq"), "G", 2).alias("b")).first()
    assert (row.a, row.b) == ("NNNNNNATGAT", "ATATATATGAT")


def test_scan_both_strands(spark):
    assert [r.pos for r in M.scan(reads(spark, "TCTATCCTAAGTGAAAACTGAATATATATTAGA"), M.Motif("AAAA", 0)).orderBy("pos").collect()] == [13]
    found = [r.pos for r in M.scan(reads(spark, TEXT), M.Motif("CGTG", 0)).orderBy("pos").collect()]
    assert found == [i for i in range(len(TEXT) - 3) if TEXT[i : i + 4] in ("CGTG", "CACG")]


def test_palindromes_have_one_strand(spark):
    hits = M.motif_match(reads(spark, "TTACGTTT"), M.Motif("ACGT", 0)).collect()
    assert [(r.strand, r.pos) for r in hits] == [("+", 2)]


def test_sites_match_hits(spark):
    some, motif = reads(spark, TEXT, "", "ACG", "CGTGCACG"), M.Motif("CGTG", 1)
    hits = {(r.seq_no, r.strand): r["count"] for r in M.motif_match(some, motif).groupBy("seq_no", "strand").count().collect()}
    for r in M.site_counts(some, motif).collect():
        assert (r.n_fwd, r.n_rev) == (hits.get((r.seq_no, "+"), 0), hits.get((r.seq_no, "-"), 0))


def test_bins_follow_the_edges(spark):
    import numpy as np

    places = [(p, n) for n in range(1, 60) for p in range(n + 1)]
    rows = spark.createDataFrame(places, "p int, n int").select("p", "n", M.bin_of(F.col("p") / F.col("n")).alias("bin")).collect()
    edges = np.array([i * 0.01 for i in range(101)])
    for r in rows:
        assert r.bin == min(99, int(np.searchsorted(edges, r.p / r.n, side="right")) - 1)


def test_histogram_of_a_sequence_of_one_window(spark):
    some = reads(spark, "ACGTA")
    assert [(r.bin, r.n) for r in M.position_histogram(M.placed_hits(some, M.Motif("ACGTA", 0, False)), 5).collect()] == [(0, 1)]


def test_density_sums_to_one(spark):
    histogram = spark.createDataFrame([("+", 10, 3), ("-", 50, 1)], "strand string, bin int, n long")
    assert abs(M.position_density(histogram).agg(F.sum("density")).first()[0] - 1) < 1e-9


def pieces(df):
    return [(r.start, r.end, r.label) for r in df.orderBy("start").collect()]


def test_segments_tile_the_sequence(spark):
    some = reads(spark, "A" * 50)
    one, two = [3, 8, 17, 20], [5, 12, 17, 19, 30]

    def found(second):
        rows = [(0, i, p, p + 4) for i, places in ((1, one), (2, second)) for p in places]
        windows = V.merge_windows(spark.createDataFrame(rows, "seq_no long, label int, start long, end long"), "label")
        return pieces(V.segments(some, windows))

    assert found([]) == [(0, 3, 0), (3, 7, 1), (7, 8, 0), (8, 12, 1), (12, 17, 0), (17, 24, 1), (24, 50, 0)]
    assert found(two) == [(0, 3, 0), (3, 5, 1), (5, 7, 3), (7, 8, 2), (8, 9, 3), (9, 12, 1), (12, 16, 2), (16, 17, 0), (17, 23, 3), (23, 24, 1), (24, 30, 0), (30, 34, 2), (34, 50, 0)]


def test_segments_without_windows_and_at_the_end(spark):
    some = reads(spark, "ACGT", "ACGT", "")
    windows = spark.createDataFrame([(1, 1, 2, 4)], "seq_no long, label int, start long, end long")
    rows = [(r.seq_no, r.start, r.end, r.label) for r in V.segments(some, windows).orderBy("seq_no", "start").collect()]
    assert rows == [(0, 0, 4, 0), (1, 0, 2, 0), (1, 2, 4, 1)]


def test_marked_text(spark):
    found = J.scan_reads(reads(spark, "TTACGTGTT", "CCCC"), [M.Motif("ACGTG", 0, False), M.Motif("TGTT", 0, False)])
    assert [(r.seq_no, r.marked) for r in found["marked"].collect()] == [(0, "TT<motif1>ACG</motif1><motif1_2>TG</motif1_2><motif2>TT</motif2>")]


def test_windows_span_tiles_and_stop_at_the_end(spark):
    import pytest

    seq = "ACGTTGCAAGGCTTACGATCGATC"
    tiles = S.tiles(spark.createDataFrame([("1", seq), ("2", "")], "chrom string, seq string"), 5)
    asked = spark.createDataFrame([("1", 3, 14), ("1", 20, 99), ("1", 40, 50), ("1", 3, 14), ("2", 0, 4)], "chrom string, start long, end long")
    got = [(r.header, r.seq) for r in G.extract_windows(asked, tiles, 5).orderBy("header", "seq").collect()]
    assert got == [("1|20|99", seq[20:]), ("1|3|14", seq[3:14]), ("1|3|14", seq[3:14]), ("1|40|50", ""), ("2|0|4", "")]
    with pytest.raises(ValueError):
        G.extract_windows(spark.createDataFrame([("9", 0, 1)], asked.schema), tiles, 5)
    assert G.extract_windows(spark.createDataFrame([("9", 0, 1)], asked.schema), tiles, 5, "skip").count() == 0


def test_fasta_files(spark, tmp_path):
    import gzip

    body = b">a one two\nACGT\nacg\n>b\nNN\n\n>c x\r\nAC\r\nGT\r\n"
    (tmp_path / "x.fa").write_bytes(body)
    with gzip.open(tmp_path / "y.fa.gz", "wb") as file:
        file.write(body)
    for name in ("x.fa", "y.fa.gz"):
        rows = fasta.read_fasta(spark, str(tmp_path / name), numbered=True).orderBy("seq_no").collect()
        assert [tuple(r) for r in rows] == [(0, "a", "one two", "ACGTACG"), (1, "b", "", "NN"), (2, "c", "x", "ACGT")]


def test_fastq_quality_may_look_like_a_header(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a d\nACGT\n+\n@@@@\n@b\nAC\n+b\nII\n")
    rows = fasta.read_fastq(spark, str(tmp_path / "x.fq")).orderBy("seq_no").collect()
    assert [tuple(r)[1:] for r in rows] == [("a", "d", "ACGT", "@@@@"), ("b", "", "AC", "II")]


def test_written_lines_have_no_empty_end(spark, tmp_path):
    fasta.write_fasta(spark.createDataFrame([("a", "A" * 120), ("b", "C" * 61)], "seq_id string, seq string").coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split("\n") == [">a", "A" * 60, "A" * 60, ">b", "C" * 60, "C", ""]


def test_reference_folder_last_record_wins(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">old\nAAAA\n>new\nACGTACGT\n")
    (tmp_path / "X.fasta").write_text(">x\nGG\n")
    rows = S.read_reference(spark, str(tmp_path), 4).orderBy("chrom", "tile").collect()
    assert [(r.chrom, r.tile_start, r.seq, r.length) for r in rows] == [("1", 0, "ACGT", 8), ("1", 4, "ACGT", 8), ("X", 0, "GG", 2)]


def test_window_table_columns_count_from_one(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("id\tchrom\tend\tstart\nq\tchr1\t20\t10\n")
    assert [tuple(r) for r in S.read_windows(spark, str(tmp_path / "w.tsv"), 2, 4, 3).collect()] == [("chr1", 10, 20)]


def test_manifest(spark):
    lines = spark.createDataFrame([("run links md5 bytes",), ("R1 ftp.x/a_1.gz;ftp.x/a_2.gz m 1500000000;2500000000",), ("R2 ftp.x/b.gz m 10",), ("R3",), ("R4 ftp.x/c.gz",)], "value string")
    files = archive.parse_manifest(lines)
    assert [(r.accession, r.layout, r.file_name, r.bytes) for r in files.orderBy("link").collect()] == [("R1", "PAIRED", "a_1.gz", 1500000000), ("R1", "PAIRED", "a_2.gz", 2500000000), ("R2", "SINGLE", "b.gz", 10), ("R4", "SINGLE", "c.gz", None)]
    assert archive.manifest_size(files).first()[0] == 4.0


def test_study_records(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<SET><STUDY><IDENTIFIERS><PRIMARY_ID>S1</PRIMARY_ID></IDENTIFIERS><DESCRIPTOR><STUDY_TITLE>one</STUDY_TITLE></DESCRIPTOR></STUDY></SET>")
    assert [tuple(r) for r in archive.read_records(spark, str(tmp_path / "s.xml"), "study").collect()] == [("S1", "one")]


def test_job_over_several_lengths(spark):
    some = reads(spark, *["TTGGCAAGT", "CCTTGGCAA", "TTGCCAAGG", "ACTTGGCAT"] * 3)
    rows = {r.k: r for r in P.chipseq(some, 5, 6).collect()}
    assert rows[6].n_seq == 12 and rows[6].pair_n == max(C.strand_pairs(C.count_kmers(some, 6), 6).agg(F.max("pair_n")).first())


def test_rounds_and_trend(spark):
    some = reads(spark, *["TTGGCAAGT", "CCTTGGCAA", "TTGCCAAGG", "ACTTGGCAT"] * 3).withColumn("round", (F.col("seq_no") % 2 + 1).cast("int"))
    assert {r.round for r in P.selex(some, 6).collect()} == {1, 2}
    rows = P.selex_trend(some, 6, 2, 5).collect()
    assert rows and all((r.pair_n == 0) == (r.frequency == 0) for r in rows)


def test_discovery_shrinks_what_is_left(spark, tmp_path):
    some = reads(spark, *["TTGGCAAGTACC", "CCTTGGCAATTG", "GATTACAGATTA", "GGATTACAGGAT"] * 3)
    D.count_range(some, 6, 6, str(tmp_path / "c"), 3)
    left = [x[2] for x in D.discover(spark, str(tmp_path / "c"), 6, 9, 3, 0)]
    assert left == sorted(left, reverse=True) and len(left) == 3


def test_streaming_complete_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nACGTA\n>b\nACG\n")
    writer = T.write_counts(T.stream_counts(T.stream_fasta(spark, str(tmp_path / "in")), 3), "seen", str(tmp_path / "p"))
    query = writer.start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.fa").write_text(">c\nACGACG\n")
    query.processAllAvailable()
    query.stop()
    assert {r.kmer: r.n for r in spark.table("seen").collect()} == {"ACG": 3, "CGT": 1, "GTA": 1, "CGA": 1, "GAC": 1}


@pytest.mark.parametrize("ends", ["\n", ""])
def test_fastq_in_any_splits(spark, tmp_path, ends):
    """Qualities that begin with "@", also twice, at every place of a file that is read in many splits."""
    import random

    rng = random.Random(6)
    records = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@@@+IF#") for _ in range(n))) for i, n in enumerate(rng.randrange(1, 40) for _ in range(400))]
    (tmp_path / "x.fq").write_text("\n".join(f"@{a} x\n{b}\n+\n{c}" for a, b, c in records) + ends)
    (tmp_path / "y.fq").write_text("@z\nA\n+\n@")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    try:
        rows = fasta.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.seq_id, r.seq, r.qual) for r in rows) == sorted([*records, ("z", "A", "@")])
    assert len({r.seq_no for r in rows}) == 401


def test_input_of_users_is_normalised(spark):
    from strandwise.operators import counts as C
    from strandwise.operators.masking import RepeatMask, mask_chain
    from strandwise.operators.motifs import Motif

    reads = spark.createDataFrame([(1, "AAAAAATTACGTAC")], "seq_no long, seq string")
    counts = C.count_kmers(reads, 6)
    assert [r.n for r in C.query_kmers(counts, C.kmer_list(spark, ["aaaaaa"]), 6).collect()] == [1]
    for bad in ("NNNNNN", "ACGTNA", "ACG", None):
        with pytest.raises(ValueError, match="must be 6 letters"):
            C.query_kmers(counts, C.kmer_list(spark, [bad]), 6)
        if bad is None or len(bad) == 6:
            with pytest.raises(ValueError, match="must be letters"):
                Motif(bad, 1)
    assert Motif("acgt", 1) == Motif("ACGT", 1)
    assert mask_chain(reads, [RepeatMask("a", 3)]).first().seq == "NNNNNNTTACGTAC"


@pytest.mark.parametrize("tile", [4, 7, 1 << 16])
def test_intervals_in_tiles_against_brute_force(spark, tile):
    import random

    from strandwise.operators import intervals as V

    rng = random.Random(tile)
    reads = [(i, "A" * rng.randrange(0, 60)) for i in range(12)]
    spans = [(i, m, s, min(len(x), s + rng.randrange(0, 20))) for i, x in reads for m in (1, 2, 70) for s in (rng.randrange(0, len(x) + 1) for _ in range(3))]
    frame = spark.createDataFrame(spans, "seq_no long, m int, start long, end long")
    merged = V.merge_windows(frame, "m", tile=tile)
    cover = {}
    for i, m, a, b in spans:
        for x in range(a, b):
            cover.setdefault((i, m), set()).add(x)
    expected = set()
    for (i, m), xs in cover.items():
        for a in sorted(xs):
            if a - 1 not in xs:
                expected.add((i, m, a, next(b for b in range(a, 100) if b not in xs)))
    assert {(r.seq_no, r.m, r.start, r.end) for r in merged.collect()} == expected

    hits = spark.createDataFrame([(i, m, a) for i, m, a, b in spans if b - a >= 5], "seq_no long, motif_id int, pos int")
    pieces = V.motif_segments(spark.createDataFrame(reads, "seq_no long, seq string"), hits, {1: 5, 2: 5, 70: 5}, tile=tile).collect()
    at = {}
    for r in pieces:
        for x in range(r.start, r.end):
            assert (r.seq_no, x) not in at
            at[r.seq_no, x] = tuple(r.motifs)
    for i, x in reads:
        for p in range(len(x)):
            assert at[i, p] == tuple(m for m in (1, 2, 70) if any(j == i and n == m and b - a >= 5 and a <= p < a + 5 for j, n, a, b in spans))
    by_place = sorted((r.seq_no, r.start, r.end, tuple(r.motifs)) for r in pieces)
    assert all(a[0] != b[0] or (a[2] == b[1] and a[3] != b[3]) for a, b in zip(by_place, by_place[1:], strict=False))


def test_counts_of_rounds(spark):
    from collections import Counter

    from strandwise.operators import counts as C

    import random

    rng = random.Random(1)
    rows = [(i, 1 + i % 2, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 40, 50, 51, 400])))) for i in range(30)] + [(99, 1, None)]
    reads = spark.createDataFrame(rows, "seq_no long, round int, seq string")
    for unique in (True, False):
        expected = Counter()
        for _, r, s in rows:
            found = [s[i : i + 3] for i in range(len(s or "") - 2) if "N" not in s[i : i + 3]]
            expected.update((r, x) for x in (set(found) if unique else found))
        assert {(r.round, r.kmer): r.n for r in C.count_kmers(reads, 3, unique, "round").collect()} == expected


def test_working_tables_are_cleared(spark):
    from pathlib import Path

    from strandwise.sources import scratch

    scratch.clear()
    path = scratch.new_path(spark, "x")
    scratch.stored(spark.range(3), "y")
    spark.range(2).write.parquet(path)
    assert Path(path.removeprefix("file:").lstrip("/").join(["/", ""])).exists()
    assert scratch.clear() == 2 and scratch.clear() == 0
    assert not Path("/" + path.removeprefix("file:").lstrip("/")).exists()
