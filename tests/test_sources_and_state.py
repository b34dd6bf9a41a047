"""Data sources, the offset index, look-ups in saved counts, exact tops without a table of counts, and state that outlives a restart."""

import gzip
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions.codec import code_of, revcom_of
from strandwise.operators import counts as C
from strandwise.operators import genome as G
from strandwise.operators import kmers as K
from strandwise.operators import top as T
from strandwise.sources import datasource, fasta, offsets, ranges, store
from strandwise.sources.genome import read_reference

from .test_rolling import windows_of

BASES = st.text("ACGTacgtN", max_size=70)
NAMES = st.sampled_from(["a", "b1", "chr_2|x", ""])
NOTES = st.sampled_from(["", " one", "\ttwo words ", "  >three"])


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(NAMES, NOTES, BASES), max_size=8), st.integers(5, 30), st.integers(1, 80), st.sampled_from(["\n", "\r\n"]), st.booleans())
def test_records_are_whole_whatever_the_splits(tmp_path_factory, records, width, split, end, last):
    path = str(tmp_path_factory.mktemp("fa") / "x.fa")
    text = "".join(f">{name}{note}{end}" + "".join(f"{seq[i : i + width]}{end}" for i in range(0, len(seq), width)) for name, note, seq in records)
    text = text if last or not records else text.removesuffix(end)
    with open(path, "wb") as file:
        file.write(text.encode())
    found = []
    for file in ranges.files_of(path):
        for a, b in ranges.ranges_of(file, split):
            found += ranges.fasta_records(file.uri, a, b)
    assert [x for x, _ in found] == sorted({x for x, _ in found})
    rows = [(*ranges.header_parts(r.partition(b"\n")[0]), "".join(r.partition(b"\n")[2].decode().split())) for _, r in found]
    expected = [(name, note.strip(), seq) if name else ((note.split() or [""])[0] if note[:1].strip() else "", note.strip(), seq) for name, note, seq in records]
    assert rows == expected
    places = [i for i in range(len(text)) if text[i] == ">" and (i == 0 or text[i - 1] == "\n")]
    assert [x for x, _ in found] == places


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(NAMES, st.text("ACGT", max_size=20), st.sampled_from("@+I>")), max_size=8), st.integers(1, 60), st.sampled_from(["\n", "\r\n"]))
def test_fastq_records_whatever_the_splits(tmp_path_factory, records, split, end):
    path = str(tmp_path_factory.mktemp("fq") / "x.fq")
    with open(path, "wb") as file:
        file.write("".join(f"@{name} x{end}{seq}{end}+{end}{q * len(seq)}{end}" for name, seq, q in records).encode())
    found = []
    for file in ranges.files_of(path):
        for a, b in ranges.ranges_of(file, split):
            found += ranges.fastq_records(file.uri, a, b)
    assert [tuple(x.decode() for x in r) for _, r in found] == [(f"{name} x", seq, q * len(seq)) for name, seq, q in records]


def test_long_records_over_many_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1000, 0, 63, 64, 65, 300)]
    path = tmp_path / "x.fa"
    path.write_text("".join(f">s{i}\n" + "".join(f"{s[j : j + 60]}\n" for j in range(0, len(s), 60)) for i, s in enumerate(seqs)))
    for split in (50, 100, 10_000):
        found = [r for a, b in ranges.ranges_of(ranges.files_of(str(path))[0], split) for _, r in ranges.fasta_records(str(path), a, b)]
        assert [r.partition(b"\n")[2].replace(b"\n", b"").decode() for r in found] == seqs


def test_sources_read_folders_patterns_and_compressed_files(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.fa").write_bytes(b">x\tnote here\r\nacg\r\nTTN\r\n>y\r\n\r\n")
    with gzip.open(tmp_path / "b.fa.gz", "wb") as file:
        file.write(b">z of gz\nACGT\nAC\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "c.txt").write_text("no record")
    rows = spark.read.format("fasta").option("splitSize", 4).load(f"{tmp_path}/*.fa*")
    assert sorted(tuple(r) for r in rows.select("seq_id", "description", "seq").collect()) == [("x", "note here", "ACGTTN"), ("y", "", ""), ("z", "of gz", "ACGTAC")]
    assert spark.read.format("fasta").load(str(tmp_path)).count() == 3
    assert {r.offset for r in rows.where("seq_id = 'y'").collect()} == {24}
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("fasta").load(f"{tmp_path}/none").collect()
    (tmp_path / "q.fastq").write_bytes(b"@r1\tx\r\nacgt\r\n+\r\n@@@I\r\n@r2\r\nA\r\n+r2\r\n@")
    expected = [("r1", "x", "ACGT", "@@@I"), ("r2", "", "A", "@")]
    assert [tuple(r)[2:] for r in spark.read.format("fastq").load(f"{tmp_path}/q.fastq").orderBy("offset").collect()] == expected
    assert [tuple(r)[1:] for r in fasta.read_fastq(spark, f"{tmp_path}/q.fastq").orderBy("seq_no").collect()] == expected


def test_text_source_takes_either_line_break_and_any_white_space(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">id1\tdesc here \r\nacg\r\nTT\r\n>id2\x0bv\r\nA\r\n>\r\nC\r\n")
    assert [tuple(r)[1:] for r in fasta.read_fasta(spark, f"{tmp_path}/a.fa").orderBy("seq_no").collect()] == [("id1", "desc here", "ACGTT"), ("id2", "v", "A"), ("", "", "C")]
    (tmp_path / "b.fq").write_bytes(b"@r1 d\r\nAC\r\n+\r\nII\r\n@r2\tx\r\n\r\n+\r\n\r\n@r3\r\nG\r\n+\r\nI\r\n")
    assert [tuple(r)[1:] for r in fasta.read_fastq(spark, f"{tmp_path}/b.fq").orderBy("seq_no").collect()] == [("r1", "d", "AC", "II"), ("r2", "x", "", ""), ("r3", "", "G", "I")]


def test_a_stream_takes_each_file_once_over_a_restart(spark, tmp_path):
    datasource.register(spark)
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = spark.readStream.format("fasta").option("maxFilesPerTrigger", 2).load(str(source)).select("seq_id", "seq")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").option("path", str(target)).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.seq_id for r in spark.read.parquet(str(target)).collect())

    for i in range(5):
        (source / f"{i}.fa").write_text(f">s{i}\nACGT\n")
    assert run() == [f"s{i}" for i in range(5)]
    for i in range(5, 8):
        (source / f"{i}.fa").write_text(f">s{i}\nACGT\n")
    assert run() == [f"s{i}" for i in range(8)]


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    """Chromosomes in files of either line break, in lines of several lengths, of which the last record counts."""
    folder, rng = tmp_path_factory.mktemp("genome"), random.Random(4)
    seqs = {}
    for i, (n, width, end) in enumerate([(5000, 60, "\n"), (1, 60, "\n"), (4999, 50, "\r\n"), (120, 60, "\n"), (119, 200, "\n"), (0, 60, "\n"), (3000, 77, "\r\n")]):
        seq = "".join(rng.choice("acgtACGTN") for _ in range(n))
        body = end.join(seq[j : j + width] for j in range(0, n, width))
        (folder / f"chr{i}.fa").write_bytes(f">early{end}ACGTAC{end}>last one{end}{body}{end if i % 2 else ''}".encode())
        seqs[f"chr{i}"] = seq.upper()
    return str(folder), seqs


@pytest.mark.parametrize("split", [16, 1000, 64 << 20])
def test_index_and_windows_by_offset(spark, genome, split):
    folder, seqs = genome
    index = offsets.chromosomes_of(offsets.index_fasta(spark, folder, split)).persist()
    assert {r.chrom: r.length for r in index.collect()} == {c: len(s) for c, s in seqs.items()}
    rng = random.Random(9)
    asked = [(i, rng.choice([*seqs, "chr99"]), a, a + rng.choice([0, 1, 30, 200])) for i, a in enumerate(rng.randrange(-50, 5100) for _ in range(150))]
    windows = spark.createDataFrame(asked, "id int, chrom string, start long, end long")
    found = offsets.fetch_windows(windows, index, "skip").collect()
    cut = lambda c, a, b: seqs[c][max(a, 0) : max(b, 0)]
    assert sorted((r.id, r.chrom, r.start, r.end, r.header, r.seq) for r in found) == sorted((i, c, a, b, f"{c}|{a}|{b}", cut(c, a, b)) for i, c, a, b in asked if c in seqs)
    assert sum(r.n_bytes for r in found) <= sum(len(r.seq) for r in found) * 1.06 + 4 * len(found)
    with pytest.raises(ValueError, match="chr99"):
        offsets.fetch_windows(windows, index)
    plain = G.extract_windows(windows, read_reference(spark, folder, 512), 512, "skip")
    assert sorted((r.id, r.seq) for r in plain.collect()) == sorted((r.id, r.seq) for r in found)


def test_tiles_by_offset(spark, genome):
    folder, seqs = genome
    index = offsets.chromosomes_of(offsets.index_fasta(spark, folder, 900))
    for halo in (0, 9):
        ours, theirs = offsets.fetch_tiles(index, 700, halo), read_reference(spark, folder, 700, halo)
        assert sorted(map(tuple, ours.select(theirs.columns).collect())) == sorted(map(tuple, theirs.collect()))
    found = K.kmers_of_tiles(offsets.fetch_tiles(index, 700, 9), 10)
    names = sorted(seqs)
    assert sorted((names.index(r.chrom), r.pos, r.kmer) for r in found.collect()) == windows_of([seqs[c] for c in names], 10)


def test_lines_of_different_lengths_are_found_out(spark, tmp_path):
    (tmp_path / "chr1.fa").write_text(">x\nACGTAC\nACG\nACGTAC\n")
    index = offsets.chromosomes_of(offsets.index_fasta(spark, str(tmp_path)))
    with pytest.raises(Exception, match="lines of different lengths"):
        offsets.fetch_tiles(index, 100).collect()
    with gzip.open(tmp_path / "chr2.fa.gz", "wb") as file:
        file.write(b">x\nA\n")
    with pytest.raises(ValueError, match="compressed"):
        offsets.index_fasta(spark, str(tmp_path))


def rows_read(frame):
    """Rows that the scans of a query that has run have given, from the plan's metrics."""
    total, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            total += node.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" else 0
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_ten_k_mers_need_few_of_the_saved_counts(spark, tmp_path):
    rng = random.Random(2)
    k, seqs = 12, ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(60)]
    counts = C.count_kmers(spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string"), k, False).persist()
    store.save_counts(counts.unionByName(counts.limit(0).withColumn("k", F.lit(3))), f"{tmp_path}/counts", 32_768)
    every = {r.kmer: r.n for r in counts.collect()}
    wanted = [*rng.sample(sorted(every), 9), "acgtacgtacgt"]
    found = store.query_saved(spark, f"{tmp_path}/counts", wanted, k)
    assert {r.kmer: (r.n, r.rc_n) for r in found.collect()} == {x.upper(): (every.get(x.upper(), 0), every.get(rc(x.upper()), 0)) for x in wanted}
    codes = [c for x in wanted for c in (code_of(x), revcom_of(code_of(x), k))]
    asked = store.load_counts(spark, f"{tmp_path}/counts", k).where(store.among(codes))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan.replace("\n", "") and asked.count() >= 9
    asked.collect()
    assert rows_read(asked) < len(every) / 3, (rows_read(asked), len(every))
    many = rng.sample(sorted(every), 300)
    assert {r.kmer: r.n for r in store.query_saved(spark, f"{tmp_path}/counts", many, k).collect()} == {x: every[x] for x in many}
    assert store.query_saved(spark, f"{tmp_path}/counts", [None, "ACG"], k, "null").where("n is null").count() == 2
    with pytest.raises(ValueError):
        store.query_saved(spark, f"{tmp_path}/counts", ["ACGN"], k)


@given(st.lists(st.text("ACGT", min_size=9, max_size=9), min_size=1, max_size=20))
def test_reverse_complements_of_codes(kmers):
    for k in (1, 4, 9):
        own = [x[:k] for x in kmers]
        assert T.revcom_codes(np.array([code_of(x) for x in own]), k).tolist() == [code_of(rc(x)) for x in own]


@pytest.mark.parametrize("k,m,buckets,unique", [(3, 4, 7, True), (9, 5, 1 << 20, False), (14, 10, 300, True), (31, 3, 64, False), (5, 400, 50, True), (5, 600, 50, True)])
def test_tops_without_a_table_of_counts(spark, k, m, buckets, unique):
    rng = random.Random(k)
    motif = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(60)) + (motif[: rng.randrange(41)] if rng.random() < 0.7 else rc(motif)) for _ in range(80)] + [None, ""]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string")
    expected = C.top_kmers(C.count_kmers(reads, k, unique), k, m)
    assert [tuple(r) for r in T.top_pairs(reads, k, m, unique, buckets).collect()] == [tuple(r) for r in expected.collect()]


def test_only_candidates_are_counted(spark):
    rng = random.Random(1)
    motif = "ACGGTTCAGATTACACCATG"
    seqs = ["".join(rng.choice("ACGT") for _ in range(80)) + motif for _ in range(300)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "seq_no long, seq string")
    assert T.candidates(reads, 15, 5).count() < C.count_kmers(reads, 15).count() / 50


def test_running_counts_go_on_after_a_restart(spark, tmp_path):
    from strandwise.streaming.counts import follow, followed, state_in_rocksdb, stream_fasta

    rng = random.Random(3)
    source = tmp_path / "in"
    source.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seqs = []
    for part in range(3):
        for i in range(2):
            some = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(5)]
            seqs += some
            (source / f"{part}-{i}.fa").write_text("".join(f">s{j}\n{s}\n" for j, s in enumerate(some)))
        with state_in_rocksdb(spark):
            query = follow(stream_fasta(spark, str(source), 1), 4, f"{tmp_path}/out", f"{tmp_path}/progress", False).trigger(availableNow=True).start()
        query.awaitTermination()
        assert {r.kmer: r.n for r in followed(spark, f"{tmp_path}/out").collect()} == Counter(x for _, _, x in windows_of(seqs, 4))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    state = list((tmp_path / "progress" / "state").rglob("*.changelog"))
    assert state and len(list((tmp_path / "out").glob("batch=*"))) == 6
