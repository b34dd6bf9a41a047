"""A query for each operator on sequences, over reads made of the documents table, and its DuckDB twin.

The tables hold no DNA, so reads are the letters A, C, G, T, N of each text. DuckDB's regular expressions have no
lookahead: its twins cut windows by place, which also makes them an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .functions import interval as I
from .operators import counts as C
from .operators import genome as G
from .operators import intervals as V
from .operators import kmers as K
from .operators import masking as X
from .operators import motifs as M
from .operators import superkmers as SK
from .operators import top as T
from .plans import chipseq as P
from .plans import discovery as D
from .plans import jobs as J
from .sources import archive, datasource, fasta, offsets, store
from .sources import genome as S
from .sources.scratch import new_path, stored

k = 6
MOTIF = M.Motif("ATTATA", 1)
OTHER = M.Motif("CATTA", 1)
LONG = 9

# --- twins ---------------------------------------------------------------------------------------------------------

READS = "reads AS (SELECT doc_id AS seq_no, upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents)"


def cut(size: int | str = k, name: str = "km", table: str = "reads", keep: str = "") -> str:
    return f"{name} AS (SELECT seq_no{keep}, i AS pos, substr(seq, i + 1, {size}) AS kmer FROM {table}, unnest(range(0, greatest(length(seq) - {size} + 1, 0))) t(i) WHERE regexp_full_match(substr(seq, i + 1, {size}), '[ACGT]+'))"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def code(x: str) -> str:
    return f"list_reduce(list_transform(string_split({x}, ''), lambda c: (instr('ACGT', c) - 1)::BIGINT), lambda a, b: a * 4 + b)"


def near(x: str, motif: M.Motif, strand: str = "") -> str:
    own, other = f"hamming({x}, '{motif.consensus}') <= {motif.d}", f"hamming({x}, '{codec.kmer_of(motif.rc_code, motif.k)}') <= {motif.d}"
    return {"+": own, "-": other}.get(strand, f"({own} OR {other})")


UNIQUE = "counts AS (SELECT kmer, count(DISTINCT seq_no) AS n FROM km GROUP BY kmer)"
EVERY = "counts AS (SELECT kmer, count(*) AS n FROM km GROUP BY kmer)"
PAIRS = f"pairs AS (SELECT least(kmer, {rc('kmer')}) AS canon, sum(n)::BIGINT AS pair_n FROM counts GROUP BY 1)"
HITS = f"hits AS (SELECT seq_no, '+' AS strand, pos FROM km WHERE {near('kmer', MOTIF, '+')} UNION ALL SELECT seq_no, '-', pos FROM km WHERE {near('kmer', MOTIF, '-')} AND '{MOTIF.two_strands}' = 'True')"
SITES = "sites AS (SELECT r.seq_no, count(h.seq_no) FILTER (strand = '+')::INTEGER AS n_fwd, count(h.seq_no) FILTER (strand = '-')::INTEGER AS n_rev FROM reads r LEFT JOIN hits h USING (seq_no) GROUP BY r.seq_no)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.reads_of_documents(table(spark, sf_dir, "documents"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("round", (F.pmod("seq_no", F.lit(4)) + 1).cast("int"))


def unique_counts(spark: SparkSession, sf_dir: str, size: int = k) -> DataFrame:
    return C.count_kmers(reads(spark, sf_dir), size)


def total_counts(spark: SparkSession, sf_dir: str, size: int = k) -> DataFrame:
    return C.count_kmers(reads(spark, sf_dir), size, False)


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, 'len ' || length(seq) AS description, seq FROM reads")
def a1_read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    fasta.write_fasta(reads(spark, sf_dir).withColumn("header", F.concat_ws(" ", "seq_id", F.lit("len"), F.length("seq").cast("string"))), path, 60, "header")
    return fasta.read_fasta(spark, path).select("seq_id", "description", "seq")


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, seq, repeat('@', length(seq)) AS qual FROM reads WHERE length(seq) > 0")
def a2_read_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fastq")
    some = reads(spark, sf_dir).where(F.length("seq") > 0)
    some.select(F.concat(F.lit("@"), "seq_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('@', length(seq))")).alias("value")).write.text(path)
    return fasta.read_fastq(spark, path).select("seq_id", "seq", "qual")


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, 'len ' || length(seq) AS description, seq FROM reads")
def a1_fasta_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the data source, in small splits; lines end in CRLF, and a tab stands behind the name."""
    path = new_path(spark, "fasta")
    line = fasta.fasta_text(F.concat("seq_id", F.lit("\tlen "), F.length("seq").cast("string")), F.col("seq"), 60)
    reads(spark, sf_dir).select(F.concat(F.regexp_replace(line, "\n", "\r\n"), F.lit("\r")).alias("value")).write.text(path)
    datasource.register(spark)
    return spark.read.format("fasta").option("splitSize", 100_000).load(path).select("seq_id", "description", "seq")


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, 'len ' || length(seq) AS description, seq FROM reads")
def a1_fasta_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the text source."""
    path = new_path(spark, "fasta")
    line = fasta.fasta_text(F.concat("seq_id", F.lit("\tlen "), F.length("seq").cast("string")), F.col("seq"), 60)
    reads(spark, sf_dir).select(F.concat(F.regexp_replace(line, "\n", "\r\n"), F.lit("\r")).alias("value")).write.text(path)
    return fasta.read_fasta(spark, path).select("seq_id", "description", "seq")


def fastq_crlf(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "fastq")
    record = F.concat(F.lit("@"), "seq_id", F.lit("\tx y\r\n"), "seq", F.lit("\r\n+\r\n"), F.expr("if(seq_no % 2 = 0, repeat('@', length(seq)), repeat('I', length(seq)))"), F.lit("\r"))
    reads(spark, sf_dir).where(F.length("seq") > 0).select(record.alias("value")).write.text(path)
    return path


FASTQ_CRLF = f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, 'x y' AS description, seq, repeat(CASE WHEN seq_no % 2 = 0 THEN '@' ELSE 'I' END, length(seq)) AS qual FROM reads WHERE length(seq) > 0"


@query(FASTQ_CRLF)
def a2_fastq_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fastq_crlf(spark, sf_dir)
    datasource.register(spark)
    return spark.read.format("fastq").option("splitSize", 100_000).load(path).select("seq_id", "description", "seq", "qual")


@query(FASTQ_CRLF)
def a2_fastq_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.read_fastq(spark, fastq_crlf(spark, sf_dir)).select("seq_id", "description", "seq", "qual")


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, (seq_no % 4 + 1)::INTEGER AS round, seq FROM reads WHERE seq_no % 4 < 3")
def a3_read_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = []
    for r in range(1, 5):
        paths.append(new_path(spark, f"round{r}"))
        fasta.write_fasta(rounds(spark, sf_dir).where(F.col("round") == r), paths[-1])
    return fasta.read_rounds(spark, paths, 1, 3).select("seq_id", "round", "seq")


WINDOWS = "windows AS (SELECT event_id, user_id::VARCHAR AS chrom, (event_id * 37) % 400 AS start, (event_id * 37) % 400 + 60 AS \"end\" FROM events)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") * 37) % 400
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("chrom"), start.alias("start"), (start + 60).alias("end"))


@query(f'WITH {WINDOWS} SELECT chrom, start, "end" FROM windows')
def a4_read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tsv")
    windows(spark, sf_dir).select("event_id", "chrom", "end", "start").write.csv(path, sep="\t", header=True)
    return S.read_windows(spark, path, 2, 4, 3)


TILE = 256
TILES = f"tiles AS (SELECT seq_no::VARCHAR AS chrom, t AS tile, t * {TILE} AS tile_start, substr(seq, t * {TILE} + 1, {TILE}) AS seq, length(seq) AS length FROM reads, unnest(range(0, greatest((length(seq) + {TILE - 1}) // {TILE}, 1))) u(t))"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tiles(reads(spark, sf_dir).select(F.col("seq_id").alias("chrom"), "seq"), TILE)


@query(f"WITH {READS}, {TILES} SELECT * FROM tiles")
def a5_reference_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir)


@query(f"""WITH {READS} SELECT u AS line FROM (SELECT unnest(list_concat(['>' || seq_no], CASE WHEN length(seq) = 0 THEN [''] ELSE list_transform(range(0, (length(seq) + 49) // 50), lambda i: substr(seq, i * 50 + 1, 50)) END)) AS u FROM reads)""")
def a6_write_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    fasta.write_fasta(reads(spark, sf_dir), path, 50)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"WITH {READS}, {cut(7)}, {UNIQUE} SELECT 7 AS k, kmer, n FROM counts")
def a7_saved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "counts")
    store.save_counts(unique_counts(spark, sf_dir).unionByName(unique_counts(spark, sf_dir, 7)), path)
    return store.load_counts(spark, path, 7).select("k", "kmer", "n")


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS} SELECT canon, pair_n FROM pairs ORDER BY pair_n DESC, canon LIMIT 10")
def a8_saved_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "result")
    store.save_result({"counts": unique_counts(spark, sf_dir)}, path)
    saved = store.load_result(spark, path, ["counts"])
    return C.strand_pairs(saved["counts"], k).orderBy(F.desc("pair_n"), "canon").limit(10).select(codec.decode(F.col("canon"), k).alias("canon"), "pair_n")


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    one, two = F.concat(F.lit("ftp.host/d/"), i, F.lit("_1.gz")), F.concat(F.lit("ftp.host/d/"), i, F.lit("_2.gz"))
    pair = F.col("doc_id") % 3 == 0
    links = F.when(F.col("doc_id") % 7 == 0, F.lit("none")).when(pair, F.concat_ws(";", one, two)).otherwise(one)
    sizes = F.when(pair, F.concat_ws(";", (F.col("doc_id") * 1000003).cast("string"), (F.col("doc_id") * 1000).cast("string"))).otherwise((F.col("doc_id") * 1000003).cast("string"))
    return table(spark, sf_dir, "documents").select(F.concat_ws("\t", F.concat(F.lit("R"), i), links, F.lit("md5"), sizes).alias("value"))


MANIFEST = """files AS (
    SELECT 'R' || doc_id AS accession, CASE WHEN doc_id % 3 = 0 THEN 'PAIRED' ELSE 'SINGLE' END AS layout, p::INTEGER AS file_no,
           doc_id || '_' || (p + 1) || '.gz' AS file_name, 'ftp://ftp.host/d/' || doc_id || '_' || (p + 1) || '.gz' AS link,
           CASE WHEN p = 0 THEN doc_id * 1000003 ELSE doc_id * 1000 END AS bytes
    FROM documents, unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) t(p) WHERE doc_id % 7 <> 0)"""


@query(f"WITH {MANIFEST} SELECT * FROM files")
def a9_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    manifest_lines(spark, sf_dir).write.text(path)
    return archive.read_manifest(spark, path)


@query(f"WITH {MANIFEST} SELECT 'R' || d.doc_id AS accession, lang || ' run' AS title, (SELECT max(layout) FROM files f WHERE f.accession = 'R' || d.doc_id) AS layout, '{archive.BROWSE}R' || d.doc_id AS url FROM documents d")
def a10_record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "xml")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("<RUN><IDENTIFIERS><PRIMARY_ID>R"), F.col("doc_id").cast("string"), F.lit("</PRIMARY_ID></IDENTIFIERS><TITLE>"), "lang", F.lit(" run</TITLE></RUN>")).alias("value"))
    rows.write.text(path)
    return archive.record_table(archive.read_records(spark, path, "run"), archive.parse_manifest(manifest_lines(spark, sf_dir)))


# --- generators and scalar functions ------------------------------------------------------------------------------------


@query(f"WITH {READS}, {cut()} SELECT seq_no, pos::INTEGER AS pos, kmer FROM km")
def b1_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmers(reads(spark, sf_dir), k)


@query(f"WITH {READS}, {cut()} SELECT seq_no::VARCHAR AS chrom, pos, kmer FROM km")
def b1_kmers_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile gives the k-mers that start in it."""
    cut = S.tiles(reads(spark, sf_dir).select(F.col("seq_id").alias("chrom"), "seq"), TILE, k - 1)
    return K.kmers_of_tiles(cut, k)


@query(f"WITH {READS}, {cut(4, 'a')}, {cut(5, 'b')}, {cut(6, 'c')}, u AS (SELECT 4 AS k, * FROM a UNION ALL SELECT 5, * FROM b UNION ALL SELECT 6, * FROM c) SELECT k, kmer, count(*) AS n, max(pos)::INTEGER AS last_pos FROM u GROUP BY ALL")
def b2_kmers_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmers_multi(reads(spark, sf_dir), 4, 6).groupBy("k", "kmer").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query(f"WITH {READS}, {cut(LONG)}, {UNIQUE} SELECT c.kmer, i::INTEGER AS place, substr(c.kmer, i + 1, {k}) AS sub FROM counts c, unnest(range(0, {LONG - k + 1})) t(i)")
def b3_sub_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique_counts(spark, sf_dir, LONG).select("kmer", F.posexplode(K.sub_kmers(F.col("code"), LONG, k)).alias("place", "sub"))
    return rows.select("kmer", "place", codec.decode(F.col("sub"), k).alias("sub"))


@query(f"""WITH {READS}, {cut(5)}, {UNIQUE}, best AS (SELECT kmer FROM counts ORDER BY n DESC, kmer LIMIT 1),
    s AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), every AS (SELECT a.b || c.b || d.b || e.b || f.b AS kmer FROM s a, s c, s d, s e, s f)
    SELECT every.kmer, {code('every.kmer')} AS code FROM every, best WHERE hamming(every.kmer, best.kmer) <= 2""")
def b4_hamming_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hamming_ball(spark, C.consensus(unique_counts(spark, sf_dir, 5), 5, False), 2)


@query(f"""WITH {READS}, {cut(5)}, {UNIQUE}, best AS (SELECT kmer FROM counts ORDER BY n DESC, kmer LIMIT 1),
    s AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), every AS (SELECT a.b || c.b || d.b || e.b || f.b AS kmer FROM s a, s c, s d, s e, s f)
    SELECT every.kmer, {code('every.kmer')} AS code FROM every, best WHERE hamming(every.kmer, best.kmer) <= 2""")
def b4_ball_of_lower_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hamming_ball(spark, C.consensus(unique_counts(spark, sf_dir, 5), 5, False).lower(), 2)


@query(f"""WITH {READS}, {cut(11)}, {UNIQUE} SELECT kmer, {code('kmer')} AS code, {rc('kmer')} AS revcom, {code(rc('kmer'))} AS rc_code, kmer AS decoded,
    hamming(kmer, {rc('kmer')})::INTEGER AS own_distance, kmer = {rc('kmer')} AS is_palindrome, least({code('kmer')}, {code(rc('kmer'))}) AS canonical FROM counts""")
def c1_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmer = codec.normalise(F.lower("kmer"))
    rows = unique_counts(spark, sf_dir, 11).select("kmer", codec.encode(kmer).alias("code"))
    c = F.col("code")
    rc_code = codec.revcom_code(c, 11)
    return rows.select("kmer", c, codec.revcom(F.col("kmer")).alias("revcom"), rc_code.alias("rc_code"), codec.decode(c, 11).alias("decoded"), codec.hamming(c, rc_code).alias("own_distance"), codec.is_palindrome(F.col("kmer")).alias("is_palindrome"), codec.canonical(c, 11).alias("canonical"))


@query(f"""WITH {READS}, {cut()}, {HITS} SELECT seq_no, strand, pos::INTEGER AS pos,
    round(CASE WHEN length(seq) > {k} THEN pos::DOUBLE / (length(seq) - {k}) ELSE 0 END, 6) AS place FROM hits JOIN reads USING (seq_no)""")
def c9_relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.placed_hits(reads(spark, sf_dir), MOTIF).select("seq_no", "strand", "pos", F.round(codec.relative_position(F.col("pos"), F.col("length"), k), 6).alias("place"))


# --- predicates ------------------------------------------------------------------------------------------------------------


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT kmer, n, {near('kmer', MOTIF)} AS is_motif FROM counts")
def d1_is_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_counts(spark, sf_dir).select("kmer", "n", K.is_motif(F.col("code"), MOTIF.consensus, MOTIF.d).alias("is_motif"))


@query(f"WITH {READS}, {cut(LONG)}, {UNIQUE} SELECT kmer, n FROM counts WHERE len(list_filter(range(1, {LONG - k + 2}), lambda i: {near(f'substr(kmer, i, {k})', MOTIF)})) > 0")
def d2_contain_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_counts(spark, sf_dir, LONG).where(K.contain_motif(F.col("code"), LONG, MOTIF.consensus, MOTIF.d)).select("kmer", "n")


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT kmer, n FROM counts WHERE {near('kmer', MOTIF, '+')}")
def d3_observed_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.observed_ball(unique_counts(spark, sf_dir), MOTIF.consensus, MOTIF.d).select("kmer", "n")


@query(f"WITH {READS}, {cut()} SELECT seq_no, length(seq)::INTEGER AS length FROM reads WHERE seq_no IN (SELECT seq_no FROM km WHERE {near('kmer', MOTIF)})")
def d4_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = reads(spark, sf_dir)
    return M.with_hits(some, M.motif_match(some, MOTIF)).select("seq_no", F.length("seq").alias("length"))


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS} SELECT canon, pair_n FROM pairs WHERE NOT {near('canon', MOTIF)} ORDER BY pair_n DESC, canon LIMIT 5")
def d5_second_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = C.kept_kmers(C.without_motif(unique_counts(spark, sf_dir), MOTIF.consensus, MOTIF.d))
    return C.strand_pairs(left, k).orderBy(F.desc("pair_n"), "canon").limit(5).select(codec.decode(F.col("canon"), k).alias("canon"), "pair_n")


# --- aggregations ----------------------------------------------------------------------------------------------------------


@query(f"WITH {READS}, {cut()} SELECT seq_no, kmer, count(*) AS n FROM km GROUP BY ALL")
def e1_counts_per_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counts_per_sequence(reads(spark, sf_dir), k)


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT {k} AS k, {code('kmer')} AS code, kmer, n FROM counts")
def e2_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_counts(spark, sf_dir)


@query(f"WITH {READS}, {cut()}, {EVERY} SELECT {k} AS k, {code('kmer')} AS code, kmer, n FROM counts")
def e3_total_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_counts(spark, sf_dir)


@query(f"WITH {READS}, {cut()} SELECT (SELECT count(*) FROM reads) AS n_seq, (SELECT count(*) FROM km) AS n_total_kmer, (SELECT count(DISTINCT kmer) FROM km) AS n_distinct_kmer")
def e4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collection_summary(reads(spark, sf_dir), k)


@query(f"WITH {READS}, {cut()}, {EVERY} SELECT kmer, n FROM counts")
def e5_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = rounds(spark, sf_dir)
    parts = [C.count_kmers(some.where(F.col("round") == r), k, False) for r in range(1, 5)]
    return C.merge_counts(*parts).select("kmer", "n")


@query(f"WITH {READS}, {cut()}, {EVERY}, {PAIRS} SELECT canon AS kmer, pair_n AS n, canon IN (SELECT kmer FROM counts) AS own_seen FROM pairs")
def e6_merge_revcom(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = total_counts(spark, sf_dir)
    every = C.merge_revcom(counts, k)
    seen = C.merge_revcom(counts, k, drop_unpaired=True).select("kmer", F.lit(True).alias("own_seen"))
    return every.join(seen, "kmer", "left").select("kmer", "n", F.coalesce("own_seen", F.lit(False)).alias("own_seen"))


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS} SELECT kmer, n, pair_n FROM counts JOIN pairs ON canon = least(kmer, {rc('kmer')})")
def e7_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_counts(unique_counts(spark, sf_dir), k).select("kmer", "n", "pair_n")


@query(f"WITH {READS}, {cut(LONG)}, {EVERY}, s AS (SELECT substr(kmer, i, {k}) AS kmer, n FROM counts, unnest(range(1, {LONG - k + 2})) t(i)), d AS (SELECT kmer, (sum(n) // {LONG - k + 1})::BIGINT AS n FROM s GROUP BY kmer) SELECT kmer, n FROM d WHERE n > 0")
def e8_convert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.convert_counts(total_counts(spark, sf_dir, LONG), LONG, k).select("kmer", "n")


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT least(hamming(kmer, '{MOTIF.consensus}'), hamming(kmer, {rc(chr(39) + MOTIF.consensus + chr(39))}))::INTEGER AS dist, count(*) AS n_kmers, sum(n)::BIGINT AS n FROM counts GROUP BY 1")
def e9_hamming_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hamming_profile(unique_counts(spark, sf_dir), MOTIF.consensus)


MATRIX_MOTIF = OTHER
MATRIX = f"""members AS (SELECT kmer, n FROM counts UNION ALL SELECT {rc('kmer')}, n FROM counts WHERE kmer <> {rc('kmer')}),
    ball AS (SELECT kmer, sum(n)::BIGINT AS n FROM members WHERE {near('kmer', MATRIX_MOTIF, '+')} GROUP BY kmer),
    letters AS (SELECT i::INTEGER AS pos, substr(kmer, i + 1, 1) AS base, n FROM ball, unnest(range(0, {MATRIX_MOTIF.k})) t(i)),
    matrix AS (SELECT pos, coalesce(sum(n) FILTER (base = 'A'), 0)::BIGINT AS A, coalesce(sum(n) FILTER (base = 'C'), 0)::BIGINT AS C, coalesce(sum(n) FILTER (base = 'G'), 0)::BIGINT AS G, coalesce(sum(n) FILTER (base = 'T'), 0)::BIGINT AS T FROM letters GROUP BY pos)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.motif_matrix(unique_counts(spark, sf_dir, MATRIX_MOTIF.k), MATRIX_MOTIF)


@query(f"WITH {READS}, {cut(MATRIX_MOTIF.k)}, {UNIQUE}, {MATRIX} SELECT * FROM matrix")
def e10_motif_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(f"WITH {READS}, {cut(MATRIX_MOTIF.k)}, {UNIQUE}, {MATRIX} SELECT ({MATRIX_MOTIF.k - 1} - pos)::INTEGER AS pos, T AS A, G AS C, C AS G, A AS T FROM matrix")
def e11_revcom_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.revcom_matrix(matrix(spark, sf_dir), MATRIX_MOTIF.k)


@query(f"""WITH {READS}, {cut(MATRIX_MOTIF.k)}, {UNIQUE}, {MATRIX}, l AS (SELECT pos, base, cnt FROM (SELECT pos, unnest(['A', 'C', 'G', 'T']) AS base, unnest([A, C, G, T]) AS cnt FROM matrix)),
    p AS (SELECT *, (cnt + 1e-6) / sum(cnt + 1e-6) OVER (PARTITION BY pos) AS pfm FROM l)
    SELECT pos, base, cnt, round(pfm, 6) AS pfm, round((2 + sum(pfm * log2(pfm)) OVER (PARTITION BY pos)) * pfm, 6) AS pwm FROM p""")
def e12_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weights(matrix(spark, sf_dir)).select("pos", "base", "cnt", six("pfm"), six("pwm"))


PLACED = f"placed AS (SELECT strand, CASE WHEN length(seq) > {k} THEN pos::DOUBLE / (length(seq) - {k})::DOUBLE ELSE 0::DOUBLE END AS x FROM hits JOIN reads USING (seq_no))"
HISTOGRAM = "histogram AS (SELECT strand, least(i + CASE WHEN x >= (i + 1) * 0.01::DOUBLE THEN 1 ELSE 0 END - CASE WHEN x < i * 0.01::DOUBLE THEN 1 ELSE 0 END, 99)::INTEGER AS bin, count(*) AS n FROM (SELECT *, floor(x * 100::DOUBLE)::INTEGER AS i FROM placed) GROUP BY ALL)"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.position_histogram(M.placed_hits(reads(spark, sf_dir), MOTIF), k)


@query(f"WITH {READS}, {cut()}, {HITS}, {PLACED}, {HISTOGRAM} SELECT * FROM histogram")
def e13_position_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


@query(f"WITH {READS}, {cut()}, {HITS}, {SITES} SELECT * FROM sites")
def e14_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.site_counts(reads(spark, sf_dir), MOTIF)


STATS = """count(*) AS n_seq, count(*) FILTER (n_fwd > 0) AS n_fwd_seq, count(*) FILTER (n_rev > 0) AS n_rev_seq, count(*) FILTER (n_fwd > 0 OR n_rev > 0) AS n_either_seq,
    count(*) FILTER (n_fwd > 0 AND n_rev > 0) AS n_both_seq, sum(n_fwd)::BIGINT AS n_fwd_hits, sum(n_rev)::BIGINT AS n_rev_hits,
    round(count(*) FILTER (n_fwd > 0) * 100.0::DOUBLE / count(*), 2) AS fwd_percent, round(count(*) FILTER (n_rev > 0) * 100.0::DOUBLE / count(*), 2) AS rev_percent, round(count(*) FILTER (n_fwd > 0 OR n_rev > 0) * 100.0::DOUBLE / count(*), 2) AS either_percent,
    round(count(*) FILTER (n_fwd > 1) / nullif(count(*) FILTER (n_fwd > 0), 0)::DOUBLE, 6) AS ff, round(count(*) FILTER (n_fwd > 0 AND n_rev > 0) / nullif(count(*) FILTER (n_fwd > 0 OR n_rev > 0), 0)::DOUBLE, 6) AS fr"""


@query(f"WITH {READS}, {cut()}, {HITS}, {SITES} SELECT {STATS} FROM sites")
def e15_motif_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.motif_stats(M.site_counts(reads(spark, sf_dir), MOTIF))
    return found.withColumns({"ff": F.round("ff", 6), "fr": F.round("fr", 6)})


@query(f"WITH {READS}, {cut()}, {HITS}, {SITES} SELECT n_fwd, n_rev, count(*) AS n, (SELECT round(count(*) FILTER (n_fwd > 0 OR n_rev > 0) * 100.0::DOUBLE / count(*), 1) FROM sites) AS percent FROM sites WHERE n_fwd > 0 OR n_rev > 0 GROUP BY n_fwd, n_rev")
def e16_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cooccurrence(M.site_counts(reads(spark, sf_dir), MOTIF))


@query(f"""WITH {READS}, {cut()}, {HITS}, {PLACED}, {HISTOGRAM}, d AS (SELECT strand, i::INTEGER AS point, sum(n * exp(-((i * 100.0::DOUBLE / 999 - bin) ** 2) / 50.0::DOUBLE) / (5 * sqrt(2 * pi()))) AS y, sum(n) AS hits FROM histogram, unnest(range(0, 1000)) t(i) GROUP BY ALL)
    SELECT strand, point, round(point * 100.0::DOUBLE / 999, 6) AS x, round(hits / sum(hits) OVER (PARTITION BY point) * y / sum(y) OVER (PARTITION BY strand), 6) AS density FROM d""")
def e17_position_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.position_density(histogram(spark, sf_dir)).select("strand", "point", six("x"), six("density"))


BY_ROUND = "rkm AS (SELECT (seq_no % 4 + 1)::INTEGER AS round, * FROM km)"
ROUND_TOTALS = "totals AS (SELECT r.round, r.n_seq, coalesce(q.n, 0) AS n_total_kmer FROM (SELECT (seq_no % 4 + 1)::INTEGER AS round, count(*) AS n_seq FROM reads GROUP BY 1) r LEFT JOIN (SELECT round, count(*) AS n FROM rkm GROUP BY 1) q USING (round))"


@query(f"WITH {READS}, {cut()}, {BY_ROUND}, {ROUND_TOTALS} SELECT * FROM totals")
def e18_round_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.round_totals(rounds(spark, sf_dir), k)


@query(f"""WITH {READS}, {cut()}, {BY_ROUND}, {ROUND_TOTALS}, {UNIQUE}, {PAIRS}, best AS (SELECT canon FROM pairs ORDER BY pair_n DESC, canon LIMIT 20),
    seen AS (SELECT round, least(kmer, {rc('kmer')}) AS canon, count(DISTINCT (seq_no, kmer)) AS pair_n FROM rkm GROUP BY ALL),
    f AS (SELECT canon AS kmer, round, coalesce(pair_n, 0) AS pair_n, coalesce(pair_n, 0) / n_total_kmer::DOUBLE AS frequency FROM best CROSS JOIN totals LEFT JOIN seen USING (canon, round))
    SELECT kmer, round, pair_n, round(frequency, 9) AS frequency, round(log10((frequency + 1e-9) / (1 - frequency + 1e-9)), 6) AS log_odds FROM f""")
def e19_round_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = rounds(spark, sf_dir)
    pairs = C.strand_pairs(unique_counts(spark, sf_dir), k).orderBy(F.desc("pair_n"), "canon").limit(20)
    chosen = pairs.select(F.col("canon").alias("code"), codec.decode(F.col("canon"), k).alias("kmer"))
    found = C.round_frequencies(C.count_kmers(some, k, True, "round"), C.round_totals(some, k), chosen, k)
    return found.select("kmer", "round", "pair_n", F.round("frequency", 9).alias("frequency"), six("log_odds"))


@query(f"WITH {MANIFEST} SELECT round(sum(bytes) / 1e9, 2) AS gigabytes FROM files")
def e20_manifest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.manifest_size(archive.parse_manifest(manifest_lines(spark, sf_dir)))


# --- joins, matching, intervals ------------------------------------------------------------------------------------------------

WANTED = ["TTATAA", "ATTATA", "CCCGGG", "GGGGGG", "TACATT", "ttacat", "AcGtAc", "NNNNNN", "ACGTNA", "ACG", None]


F1 = f"""WITH {READS}, {cut()}, {UNIQUE}, wanted AS (SELECT upper(unnest([{', '.join('NULL' if x is None else repr(x) for x in WANTED)}])) AS kmer),
    good AS (SELECT kmer, kmer IS NOT NULL AND regexp_full_match(kmer, '[ACGT]{{{k}}}') AS good FROM wanted),
    q AS (SELECT kmer, CASE WHEN good THEN coalesce((SELECT n FROM counts c WHERE c.kmer = w.kmer), 0) END AS n, CASE WHEN good THEN {rc('kmer')} END AS rc_kmer, CASE WHEN good THEN coalesce((SELECT n FROM counts c WHERE c.kmer = {rc('w.kmer')}), 0) END AS rc_n FROM good w)
    SELECT coalesce(kmer, 'none') AS kmer, coalesce(n, -1) AS n, coalesce(rc_kmer, '') AS rc_kmer, coalesce(rc_n, -1) AS rc_n, coalesce(CASE WHEN kmer = rc_kmer THEN n ELSE n + rc_n END, -1) AS pair_n, coalesce(kmer = rc_kmer, FALSE) AS is_palindrome FROM q"""


@query(F1)
def f1_query_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds lower case, other letters, a wrong length and a null."""
    found = C.query_kmers(unique_counts(spark, sf_dir), C.kmer_list(spark, WANTED), k, "null")
    return found.fillna({"kmer": "none", "rc_kmer": "", "n": -1, "rc_n": -1, "pair_n": -1, "is_palindrome": False})


@query(F1)
def f1_query_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From saved counts, of which only the row groups that may hold the list's k-mers are read."""
    path = new_path(spark, "counts")
    store.save_counts(unique_counts(spark, sf_dir).unionByName(unique_counts(spark, sf_dir, 7)), path, 16_384)
    found = store.query_saved(spark, path, WANTED, k, "null")
    return found.fillna({"kmer": "none", "rc_kmer": "", "n": -1, "rc_n": -1, "pair_n": -1, "is_palindrome": False})


@query(f'WITH {READS}, {WINDOWS} SELECT event_id, chrom || \'|\' || start || \'|\' || "end" AS header, coalesce(substr(seq, start::INTEGER + 1, 60), \'\') AS seq FROM windows JOIN reads ON seq_no::VARCHAR = chrom')
def f2_extract_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.extract_windows(windows(spark, sf_dir), tiles(spark, sf_dir), TILE, "skip").select("event_id", "header", "seq")


MOTIFS = [MOTIF, OTHER, M.Motif("TTATAA", 1)]
SCAN = " UNION ALL ".join(f"SELECT seq_no, {i} AS motif_id, pos::INTEGER AS pos FROM km{m.k} WHERE {near('kmer', m)}" for i, m in enumerate(MOTIFS, 1))


@query(f"WITH {READS}, {cut(5, 'km5')}, {cut(6, 'km6')} {SCAN}")
def f3_scan_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scan_motifs(reads(spark, sf_dir), MOTIFS)


HUNDREDS = [M.Motif(codec.kmer_of((i * 389_017 + 7_777) % 4**8, 8), 1) for i in range(500)]
BOTH_STRANDS = ", ".join(f"({i}, '{m.consensus}', '{codec.kmer_of(m.rc_code, 8)}')" for i, m in enumerate(HUNDREDS, 1))


@query(f"""WITH {READS}, {cut(8)}, seen AS MATERIALIZED (SELECT DISTINCT kmer FROM km), wanted(motif_id, fwd, rev) AS (VALUES {BOTH_STRANDS}),
    met AS MATERIALIZED (SELECT kmer, motif_id FROM seen, wanted WHERE hamming(kmer, fwd) <= 1 OR hamming(kmer, rev) <= 1)
    SELECT seq_no, motif_id, pos::INTEGER AS pos FROM km JOIN met USING (kmer)""")
def f3_scan_hundreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred motifs of eight bases from a rule."""
    return M.scan_motifs(reads(spark, sf_dir), HUNDREDS)


@query(f"WITH {READS}, {cut()}, {HITS} SELECT seq_no, strand, pos::INTEGER AS pos FROM hits")
def g1_motif_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.motif_match(reads(spark, sf_dir), MOTIF)


@query(f"WITH {READS}, {cut()}, {HITS} SELECT seq_no::VARCHAR AS chrom, strand, pos FROM hits")
def g1_match_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_tiles(S.tiles(reads(spark, sf_dir).select(F.col("seq_id").alias("chrom"), "seq"), TILE, k - 1), MOTIF)


@query(f"WITH {READS}, {cut()} SELECT seq_no, pos::INTEGER AS pos FROM km WHERE {near('kmer', MOTIF)}")
def g2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scan(reads(spark, sf_dir), MOTIF)


@query(f"WITH {READS}, {cut(5, 'km5')}, {cut(6, 'km6')}, s AS ({SCAN}) SELECT seq_no, motif_id, array_to_string(list_sort(list(pos)), ',') AS positions FROM s GROUP BY ALL")
def g3_scan_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scan_lists(M.scan_motifs(reads(spark, sf_dir), MOTIFS)).withColumn("positions", F.array_join("positions", ","))


COVER = "cover AS (SELECT DISTINCT seq_no, strand, unnest(range(pos, pos + 6)) AS spot FROM hits)"
ISLANDS = "islands AS (SELECT seq_no, strand, min(spot) AS start, max(spot) + 1 AS \"end\" FROM (SELECT *, spot - row_number() OVER (PARTITION BY seq_no, strand ORDER BY spot) AS g FROM cover) GROUP BY seq_no, strand, g)"


def strand_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_windows(V.hit_windows(M.motif_match(reads(spark, sf_dir), MOTIF), k, "strand"), "strand")


@query(f"WITH {READS}, {cut()}, {HITS}, {COVER}, {ISLANDS} SELECT * FROM islands")
def h1_merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strand_windows(spark, sf_dir).select("seq_no", "strand", "start", "end")


LABELS = "labels_at AS (SELECT seq_no, spot, sum(CASE strand WHEN '+' THEN 1 ELSE 2 END)::BIGINT AS label FROM cover GROUP BY ALL)"


def run_length(source: str) -> str:
    return f"SELECT seq_no, min(spot) AS start, max(spot) + 1 AS \"end\", label FROM (SELECT *, spot - row_number() OVER (PARTITION BY seq_no, label ORDER BY spot) AS g FROM {source}) GROUP BY seq_no, label, g"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strand_windows(spark, sf_dir).select("seq_no", F.when(F.col("strand") == "+", 1).otherwise(2).alias("label"), "start", "end")


@query(f"WITH {READS}, {cut()}, {HITS}, {COVER}, {LABELS} {run_length('labels_at')}")
def h2_label_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.label_pieces(labelled(spark, sf_dir))


WHOLE = "whole AS (SELECT seq_no, spot, coalesce(label, 0)::BIGINT AS label FROM (SELECT seq_no, unnest(range(0, length(seq))) AS spot FROM reads) LEFT JOIN labels_at USING (seq_no, spot))"


@query(f"WITH {READS}, {cut()}, {HITS}, {COVER}, {LABELS}, {WHOLE} {run_length('whole')}")
def h3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.segments(reads(spark, sf_dir), labelled(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, event_id % 50 AS a, event_id % 50 + 10 AS b, user_id % 60 AS c, user_id % 60 + 5 + event_id % 12 AS d FROM events)
    SELECT event_id, a < d AND c < b AS overlaps, a <= c AND d <= b AS contains, CASE WHEN a < d AND c < b THEN greatest(a, c) ELSE -1 END AS common_start, CASE WHEN a < d AND c < b THEN least(b, d) ELSE -1 END AS common_end, least(a, c) AS span_start, greatest(b, d) AS span_end,
    CASE WHEN a < d AND c < b THEN greatest(least(b, c) - a, 0) + greatest(b - greatest(a, d), 0) ELSE b - a END AS left_over FROM e""")
def h4_interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = I.interval(F.col("event_id") % 50, F.col("event_id") % 50 + 10)
    y = I.interval(F.col("user_id") % 60, F.col("user_id") % 60 + 5 + F.col("event_id") % 12)
    rows = e.select("event_id", x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    common, whole = I.intersection(x, y), I.span(x, y)
    left = F.aggregate(I.difference(x, y), F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    return rows.select("event_id", I.overlaps(x, y).alias("overlaps"), I.contains(x, y).alias("contains"), F.coalesce(common["start"], F.lit(-1)).alias("common_start"), F.coalesce(common["end"], F.lit(-1)).alias("common_end"), whole["start"].alias("span_start"), whole["end"].alias("span_end"), left.alias("left_over"))


@query(f"WITH {READS}, {cut()}, {UNIQUE}, r AS (SELECT kmer, n, row_number() OVER (PARTITION BY least(kmer, {rc('kmer')}) ORDER BY n DESC, kmer) AS turn FROM counts) SELECT kmer, n FROM r WHERE turn = 1")
def h5_one_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = unique_counts(spark, sf_dir).withColumn("rank", F.struct((-F.col("n")).alias("a"), "code"))
    return C.one_strand(ranked, k, F.col("rank")).select("kmer", "n")


# --- top-k, sets -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT kmer, n FROM counts ORDER BY n DESC, kmer LIMIT 6")
def i1_top_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_kmers(unique_counts(spark, sf_dir), k, 6, False).select("kmer", "n")


TOP_PAIRS = f"""shown AS (SELECT canon, pair_n, coalesce(a.n, 0) AS low_n, coalesce(b.n, 0) AS high_n FROM pairs LEFT JOIN counts a ON a.kmer = canon LEFT JOIN counts b ON b.kmer = {rc('canon')} ORDER BY pair_n DESC, canon LIMIT 6)"""


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS}, {TOP_PAIRS} SELECT CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS kmer, greatest(low_n, high_n) AS n, least(low_n, high_n) AS rc_n, pair_n FROM shown")
def i2_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_kmers(unique_counts(spark, sf_dir), k, 6).select("kmer", "n", "rc_n", "pair_n")


def top_twin(size: int) -> str:
    return f"WITH {READS}, {cut(size)}, {UNIQUE}, {PAIRS}, {TOP_PAIRS} SELECT CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS kmer, greatest(low_n, high_n) AS n, least(low_n, high_n) AS rc_n, pair_n FROM shown"


@query(top_twin(k))
def i2_top_pairs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a table of all counts; so few buckets that each holds many k-mers."""
    return T.top_pairs(reads(spark, sf_dir), k, 6, buckets=500).select("kmer", "n", "rc_n", "pair_n")


@query(top_twin(15))
def i2_top_pairs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_pairs(reads(spark, sf_dir), 15).select("kmer", "n", "rc_n", "pair_n")


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS}, {TOP_PAIRS} SELECT CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS consensus FROM shown ORDER BY pair_n DESC, canon LIMIT 1")
def i3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_kmers(unique_counts(spark, sf_dir), k, 1).select(F.col("kmer").alias("consensus"))


SAMPLED = """{p}drawn AS (SELECT kmer, md5('0:' || {code}) AS ord FROM {source} ORDER BY ord, {code} LIMIT 800),
    {p}ahead AS (SELECT kmer, ' ' || lpad((row_number() OVER (ORDER BY pair_n DESC, {code}))::VARCHAR, 9, '0') AS ord FROM {top}),
    {p}chosen AS (SELECT kmer FROM (SELECT *, row_number() OVER (PARTITION BY least(kmer, {rc}) ORDER BY ord) AS turn FROM (SELECT * FROM {p}drawn UNION ALL SELECT * FROM {p}ahead)) WHERE turn = 1)"""
SHOWN = f"CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS kmer, pair_n"


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS}, {TOP_PAIRS}, best AS (SELECT {SHOWN} FROM shown), {SAMPLED.format(p='', code=code('kmer'), source='counts', top='best', rc=rc('kmer'))} SELECT kmer FROM chosen")
def i4_sample_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = unique_counts(spark, sf_dir)
    return C.sample_kmers(counts, k, C.top_kmers(counts, k), 800).select("kmer")


@query("SELECT 'R' || doc_id AS accession, lang AS title FROM documents ORDER BY accession LIMIT 10")
def i5_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("accession"), F.col("lang").alias("title"))
    return archive.first_records(rows, 10)


@query(f"WITH {READS}, {cut(5, 'km5')}, {cut(6, 'km6')}, s AS ({SCAN}) SELECT DISTINCT seq_no, pos FROM s")
def j2_union_of_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = reads(spark, sf_dir)
    out = M.scan(some, MOTIFS[0])
    for motif in MOTIFS[1:]:
        out = out.union(M.scan(some, motif))
    return out.distinct()


@query(f"WITH {READS}, {cut()}, {BY_ROUND}, a AS (SELECT kmer, count(*) AS n FROM rkm WHERE round <= 2 GROUP BY kmer), b AS (SELECT kmer, count(*) AS n FROM rkm WHERE round > 2 GROUP BY kmer) SELECT kmer, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (kmer) WHERE a.n > coalesce(b.n, 0)")
def j3_subtract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = rounds(spark, sf_dir)
    return C.subtract_counts(C.count_kmers(some.where("round <= 2"), k, False), C.count_kmers(some.where("round > 2"), k, False)).select("kmer", "n")


# --- masking -----------------------------------------------------------------------------------------------------------------------


def masked_runs(x: str, unit: str, n: int) -> str:
    run = f"(?:{unit}){{{n},}}"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{run}|.'), lambda t: CASE WHEN regexp_full_match(t, '{run}') THEN repeat('N', length(t)) ELSE t END), '')"


@query(f"WITH {READS} SELECT seq_no, {masked_runs(masked_runs('seq', 'AT', 2), 'AT', 2)} AS seq FROM (SELECT seq_no, {masked_runs(masked_runs('seq', 'A', 3), 'T', 3)} AS seq FROM reads)")
def l1_mask_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mask_chain(reads(spark, sf_dir), [X.RepeatMask("A", 3), X.RepeatMask("AT", 2)]).select("seq_no", "seq")


MASKED = f"hidden AS (SELECT DISTINCT seq_no, unnest(range(pos, pos + {k})) AS spot FROM km WHERE {near('kmer', MOTIF)}), masked AS (SELECT seq_no, string_agg(CASE WHEN h.spot IS NULL THEN b ELSE 'N' END, '' ORDER BY a.spot) AS seq FROM (SELECT seq_no, unnest(range(0, length(seq))) AS spot, unnest(string_split(seq, '')) AS b FROM reads WHERE length(seq) > 0) a LEFT JOIN hidden h USING (seq_no, spot) GROUP BY seq_no)"


@query(f"WITH {READS}, {cut()}, {MASKED} SELECT seq_no, coalesce(m.seq, '') AS seq FROM reads LEFT JOIN masked m USING (seq_no)")
def l2_mask_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("seq_no", X.mask_motif(F.col("seq"), MOTIF).alias("seq"))


@query(f"WITH {READS}, {cut()}, {MASKED}, m AS (SELECT seq_no, coalesce(m.seq, '') AS seq FROM reads LEFT JOIN masked m USING (seq_no)) SELECT seq_no, {masked_runs(masked_runs('seq', 'A', 3), 'T', 3)} AS seq FROM m")
def l3_mask_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mask_chain(reads(spark, sf_dir), [X.MotifMask(MOTIF.consensus, MOTIF.d), X.RepeatMask("A", 3)]).select("seq_no", "seq")


@query(f"""WITH {READS}, {cut()}, {HITS}, {COVER}, {LABELS}, {WHOLE}, seg AS ({run_length('whole')}), p AS (SELECT seq_no, start, CASE label WHEN 1 THEN '<f>' || t || '</f>' WHEN 2 THEN '<r>' || t || '</r>' WHEN 3 THEN '<b>' || t || '</b>' ELSE t END AS t FROM (SELECT seg.*, substr(seq, start::INTEGER + 1, ("end" - start)::INTEGER) AS t FROM seg JOIN reads USING (seq_no)))
    SELECT seq_no, string_agg(t, '' ORDER BY start) AS marked FROM p GROUP BY seq_no""")
def l4_mark_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = reads(spark, sf_dir)
    return X.mark_up(some, V.segments(some, labelled(spark, sf_dir)), {1: "f", 2: "r", 3: "b"})


# --- streaming and jobs --------------------------------------------------------------------------------------------------------------


@query(f"WITH {READS}, {cut()}, {UNIQUE} SELECT kmer, n FROM counts")
def k1_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of four rounds arrive one after the other; the batches' counts are added up."""
    from .streaming.counts import accumulate, stream_fasta

    source, target = new_path(spark, "stream"), new_path(spark, "counts")
    fasta.write_fasta(reads(spark, sf_dir).repartition(4), source)
    stream = accumulate(stream_fasta(spark, source, 2), k, target, new_path(spark, "progress")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return C.merge_counts(spark.read.parquet(target)).select("kmer", "n")


@query(f"WITH {READS}, {cut()}, {EVERY} SELECT kmer, n FROM counts")
def k1_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts as state in RocksDB. Half of the files are there when the stream first runs; it goes on from its checkpoint when the others
    have come."""
    from .streaming.counts import follow, followed, state_in_rocksdb, stream_fasta

    source, target, progress = new_path(spark, "stream"), new_path(spark, "counts"), new_path(spark, "progress")
    some = rounds(spark, sf_dir)
    for half in ("round <= 2", "round > 2"):
        fasta.fasta_lines(some.where(half).repartition(4)).write.mode("append").text(source)
        with state_in_rocksdb(spark):
            stream = follow(stream_fasta(spark, source, 3), k, target, progress, False).trigger(availableNow=True).start()
        stream.awaitTermination()
    return followed(spark, target).select("kmer", "n")


BEST = f"""best AS (SELECT kmer AS consensus, n, rc_n, pair_n FROM (SELECT CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS kmer, greatest(low_n, high_n) AS n, least(low_n, high_n) AS rc_n, pair_n, canon FROM shown) ORDER BY pair_n DESC, canon LIMIT 1)"""
BEST_HITS = f"hits AS (SELECT seq_no, '+' AS strand, pos FROM km, best WHERE hamming(kmer, consensus) <= 1 UNION ALL SELECT seq_no, '-', pos FROM km, best WHERE hamming(kmer, {rc('consensus')}) <= 1 AND consensus <> {rc('consensus')})"


@query(f"WITH {READS}, {cut()}, {UNIQUE}, {PAIRS}, {TOP_PAIRS}, {BEST}, {BEST_HITS}, {SITES}, s AS (SELECT {STATS} FROM sites) SELECT {k} AS k, best.*, s.* FROM best, s")
def m1_chipseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chipseq(reads(spark, sf_dir), k, k).withColumns({"ff": F.round("ff", 6), "fr": F.round("fr", 6)})


R_PAIRS = f"""rc_counts AS (SELECT round, kmer, count(DISTINCT seq_no) AS n FROM rkm GROUP BY ALL), rp AS (SELECT round, least(kmer, {rc('kmer')}) AS canon, sum(n)::BIGINT AS pair_n FROM rc_counts GROUP BY ALL),
    r1 AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY round ORDER BY pair_n DESC, canon) = 1),
    r2 AS (SELECT r1.*, coalesce(a.n, 0) AS low_n, coalesce(b.n, 0) AS high_n FROM r1 LEFT JOIN rc_counts a ON a.kmer = canon AND a.round = r1.round LEFT JOIN rc_counts b ON b.kmer = {rc('canon')} AND b.round = r1.round),
    rbest AS (SELECT round, CASE WHEN high_n > low_n THEN {rc('canon')} ELSE canon END AS consensus, greatest(low_n, high_n) AS n, least(low_n, high_n) AS rc_n, pair_n FROM r2),
    rsites AS (SELECT r.seq_no, (r.seq_no % 4 + 1)::INTEGER AS round, count(kmer) FILTER (hamming(kmer, consensus) <= 1)::INTEGER AS n_fwd, count(kmer) FILTER (consensus <> {rc('consensus')} AND hamming(kmer, {rc('consensus')}) <= 1)::INTEGER AS n_rev FROM reads r LEFT JOIN rkm USING (seq_no) JOIN rbest ON rbest.round = r.seq_no % 4 + 1 GROUP BY ALL),
    rs AS (SELECT round, {STATS} FROM rsites GROUP BY round)"""


@query(f"SELECT {k} AS k, * FROM (WITH {READS}, {cut()}, {BY_ROUND}, {R_PAIRS} SELECT rbest.*, rs.* EXCLUDE (round) FROM rbest JOIN rs USING (round)) UNION ALL SELECT {k + 1} AS k, * FROM (WITH {READS}, {cut(k + 1)}, {BY_ROUND}, {R_PAIRS} SELECT rbest.*, rs.* EXCLUDE (round) FROM rbest JOIN rs USING (round))")
def m2_selex_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selex_range(rounds(spark, sf_dir), k, k + 1).withColumns({"ff": F.round("ff", 6), "fr": F.round("fr", 6)})


@query(f"WITH {READS}, {cut()}, {BY_ROUND}, {R_PAIRS} SELECT rbest.*, rs.* EXCLUDE (round) FROM rbest JOIN rs USING (round)")
def m2_selex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selex(rounds(spark, sf_dir), k).withColumns({"ff": F.round("ff", 6), "fr": F.round("fr", 6)})


def by_round_and_k(sizes: tuple[int, ...], select: str) -> str:
    """A query on each round's best k-mer, for each k."""
    return " UNION ALL ".join(f"SELECT {x} AS k, * FROM (WITH {READS}, {cut(x)}, {BY_ROUND}, {R_PAIRS} {select.replace('[k]', str(x))})" for x in sizes)


@query(by_round_and_k((5, 6), f"SELECT c.round, least(hamming(kmer, consensus), hamming(kmer, {rc('consensus')}))::INTEGER AS dist, count(*) AS n_kmers, sum(c.n)::BIGINT AS n FROM rc_counts c JOIN rbest USING (round) GROUP BY ALL"))
def m2_selex_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles of every round and k."""
    return P.selex_table(P.selex_tables(rounds(spark, sf_dir), 5, 6), "profile")


@query(by_round_and_k((5, 6), f"""SELECT round, strand, least(i + CASE WHEN x >= (i + 1) * 0.01::DOUBLE THEN 1 ELSE 0 END - CASE WHEN x < i * 0.01::DOUBLE THEN 1 ELSE 0 END, 99)::INTEGER AS bin, count(*) AS n FROM (
    SELECT *, floor(x * 100::DOUBLE)::INTEGER AS i FROM (SELECT round, strand, CASE WHEN length(seq) > [k] THEN pos::DOUBLE / (length(seq) - [k])::DOUBLE ELSE 0::DOUBLE END AS x FROM (
        SELECT round, seq_no, '+' AS strand, pos FROM rkm JOIN rbest USING (round) WHERE hamming(kmer, consensus) <= 1
        UNION ALL SELECT round, seq_no, '-', pos FROM rkm JOIN rbest USING (round) WHERE consensus <> {rc('consensus')} AND hamming(kmer, {rc('consensus')}) <= 1) JOIN reads USING (seq_no))) GROUP BY ALL"""))
def m2_selex_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms of sites of every round and k."""
    return P.selex_table(P.selex_tables(rounds(spark, sf_dir), 5, 6), "histogram")


LATE = f"""late AS (SELECT kmer, count(DISTINCT seq_no) AS n FROM rkm WHERE round = 4 GROUP BY kmer), late_pairs AS (SELECT least(kmer, {rc('kmer')}) AS canon, sum(n)::BIGINT AS pair_n FROM late GROUP BY 1),
    late_shown AS (SELECT canon, pair_n, coalesce(a.n, 0) AS low_n, coalesce(b.n, 0) AS high_n FROM late_pairs LEFT JOIN late a ON a.kmer = canon LEFT JOIN late b ON b.kmer = {rc('canon')} ORDER BY pair_n DESC, canon LIMIT 6), late_best AS (SELECT {SHOWN} FROM late_shown)"""


@query(f"""WITH {READS}, {cut()}, {BY_ROUND}, {ROUND_TOTALS}, {LATE}, {SAMPLED.format(p='', code=code('kmer'), source='late', top='late_best', rc=rc('kmer'))},
    seen AS (SELECT round, least(kmer, {rc('kmer')}) AS canon, count(DISTINCT (seq_no, kmer)) AS pair_n FROM rkm GROUP BY ALL),
    f AS (SELECT kmer, totals.round, coalesce(pair_n, 0) AS pair_n, coalesce(coalesce(pair_n, 0) / nullif(n_total_kmer, 0)::DOUBLE, 0) AS frequency FROM chosen CROSS JOIN totals LEFT JOIN seen ON canon = least(kmer, {rc('kmer')}) AND seen.round = totals.round)
    SELECT kmer, round, pair_n, round(frequency, 6) AS frequency, round(log10((frequency + 1e-9) / (1 - frequency + 1e-9)), 6) AS log_odds FROM f""")
def m2_selex_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.selex_trend(rounds(spark, sf_dir), k).select("kmer", "round", "pair_n", six("frequency"), six("log_odds"))


def turn_sql(i: int) -> str:
    """One turn of the discovery: the best k-mer of now{i}, the K-mers left without it, the k-mers' counts from those."""
    motif = f"(hamming(substr(l.kmer, i, {k}), b.kmer) <= 1 OR hamming(substr(l.kmer, i, {k}), {rc('b.kmer')}) <= 1)"
    return f"""best{i} AS MATERIALIZED (SELECT kmer, n FROM now{i} ORDER BY n DESC, kmer LIMIT 1),
    left{i} AS MATERIALIZED (SELECT l.kmer, l.n FROM left{i - 1} l, best{i} b WHERE NOT EXISTS (SELECT 1 FROM unnest(range(1, {LONG - k + 2})) t(i) WHERE {motif})),
    own{i} AS (SELECT kmer, (sum(n) // {LONG - k + 1})::BIGINT AS n FROM (SELECT substr(kmer, i, {k}) AS kmer, n FROM left{i}, unnest(range(1, {LONG - k + 2})) t(i)) GROUP BY kmer),
    now{i + 1} AS MATERIALIZED (SELECT least(kmer, {rc('kmer')}) AS kmer, sum(n)::BIGINT AS n FROM own{i} WHERE n > 0 GROUP BY 1)"""


@query(f"""WITH {READS}, {cut()}, {cut(LONG, 'km9')}, now1 AS MATERIALIZED (SELECT least(kmer, {rc('kmer')}) AS kmer, count(*) AS n FROM km GROUP BY 1),
    left0 AS MATERIALIZED (SELECT least(kmer, {rc('kmer')}) AS kmer, count(*) AS n FROM km9 GROUP BY 1), {', '.join(turn_sql(i) for i in (1, 2, 3))}
    {' UNION ALL '.join(f'SELECT {i} AS turn, kmer, n, (SELECT count(*) FROM left{i}) AS n_left FROM best{i}' for i in (1, 2, 3))}""")
def m3_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k=6 and K=9 with one substitution, three motifs, from counts saved by the count job."""
    path = new_path(spark, "counts")
    D.count_range(reads(spark, sf_dir), k, k, path, LONG - k)
    rows = [(i, *x) for i, x in enumerate(D.discover(spark, path, k, LONG, 3, 1), 1)]
    return spark.createDataFrame(rows, "turn int, kmer string, n long, n_left long")


@query(f"WITH {READS}, {cut(6, 'a')}, {cut(7, 'b')}, u AS (SELECT 6 AS k, kmer FROM a UNION ALL SELECT 7, kmer FROM b) SELECT k, kmer, count(*) AS n FROM u GROUP BY ALL")
def m4_count_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "counts")
    D.count_range(reads(spark, sf_dir), 6, 7, path, 0)
    return store.load_counts(spark, path).select("k", "kmer", "n")


WIDE = (8, 11, 12, 17, 25, 31)


@query(f"WITH {READS}, {', '.join(cut(x, f'km{x}') for x in WIDE)}, u AS ({' UNION ALL '.join(f'SELECT {x} AS k, kmer FROM km{x}' for x in WIDE)}) SELECT k, kmer, count(*) AS n FROM u GROUP BY ALL")
def m4_wide_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large k together, from one pass."""
    return SK.count_ks(reads(spark, sf_dir), list(WIDE)).select("k", "kmer", "n")


@query(f"WITH {READS} SELECT seq_no::VARCHAR AS seq_id, {masked_runs(masked_runs('seq', 'A', 3), 'T', 3)} AS seq FROM reads")
def m5_mask_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = new_path(spark, "fasta"), new_path(spark, "fasta")
    fasta.write_fasta(reads(spark, sf_dir), source)
    J.mask_file(spark, source, target, [X.RepeatMask("A", 3)])
    return fasta.read_fasta(spark, target).select("seq_id", "seq")


TWO = MOTIFS[:2]
TWO_SCAN = " UNION ALL ".join(f"SELECT seq_no, {1 << (i - 1)} AS bit, {m.k} AS size, pos FROM km{m.k} WHERE {near('kmer', m)}" for i, m in enumerate(TWO, 1))


@query(f"""WITH {READS}, {cut(5, 'km5')}, {cut(6, 'km6')}, s AS ({TWO_SCAN}), cover AS (SELECT DISTINCT seq_no, bit, unnest(range(pos, pos + size)) AS spot FROM s), labels_at AS (SELECT seq_no, spot, sum(bit)::BIGINT AS label FROM cover GROUP BY ALL),
    whole AS (SELECT seq_no, spot, coalesce(label, 0)::BIGINT AS label FROM (SELECT seq_no, unnest(range(0, length(seq))) AS spot FROM reads WHERE seq_no IN (SELECT seq_no FROM s)) LEFT JOIN labels_at USING (seq_no, spot)) {run_length('whole')}""")
def m6_scan_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.scan_reads(reads(spark, sf_dir), TWO)["segments"].drop("motifs")


def many_motifs(n: int) -> list[M.Motif]:
    """n motifs of five and six bases from a rule."""
    return [M.Motif(codec.kmer_of((i * 389 + 77) % 4 ** (5 + i % 2), 5 + i % 2), int(i % 3 == 0)) for i in range(n)]


def many_sql(n: int) -> str:
    scan = " UNION ALL ".join(f"SELECT seq_no, {i} AS motif, {m.k} AS size, pos FROM km{m.k} WHERE {near('kmer', m)}" for i, m in enumerate(many_motifs(n), 1))
    return f"""{READS}, {cut(5, 'km5')}, {cut(6, 'km6')}, s AS MATERIALIZED ({scan}), cover AS (SELECT DISTINCT seq_no, motif, unnest(range(pos, pos + size)) AS spot FROM s),
    names AS (SELECT seq_no, spot, string_agg(motif::VARCHAR, '_' ORDER BY motif) AS label FROM cover GROUP BY ALL),
    whole AS (SELECT seq_no, spot, coalesce(label, '') AS label FROM (SELECT seq_no, unnest(range(0, length(seq))) AS spot FROM reads WHERE seq_no IN (SELECT seq_no FROM s)) LEFT JOIN names USING (seq_no, spot)),
    pieces AS ({run_length('whole')})"""


@query(f"WITH {many_sql(40)} SELECT seq_no, start, \"end\", label AS motifs FROM pieces")
def m6_scan_forty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.scan_reads(reads(spark, sf_dir), many_motifs(40))["segments"]
    return found.select("seq_no", "start", "end", F.array_join("motifs", "_").alias("motifs"))


@query(f"""WITH {many_sql(9)}, t AS (SELECT seq_no, start, label, substr(seq, start::INTEGER + 1, ("end" - start)::INTEGER) AS t FROM pieces JOIN reads USING (seq_no))
    SELECT seq_no::VARCHAR AS seq_id, string_agg(CASE WHEN label = '' THEN t ELSE '<motif' || label || '>' || t || '</motif' || label || '>' END, '' ORDER BY start) AS marked FROM t GROUP BY seq_no""")
def m6_scan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine motifs, from a file; the numbers of the file's records lead back to their names."""
    path = new_path(spark, "fasta")
    fasta.write_fasta(reads(spark, sf_dir), path)
    named = fasta.read_fasta(spark, path, numbered=True).select("seq_no", "seq_id")
    return J.scan_file(spark, path, many_motifs(9))["marked"].join(named, "seq_no").select("seq_id", "marked")


@query(f'WITH {READS}, {WINDOWS} SELECT chrom || \'|\' || start || \'|\' || "end" AS seq_id, coalesce(substr(seq, start::INTEGER + 1, 60), \'\') AS seq FROM windows JOIN reads ON seq_no::VARCHAR = chrom')
def m7_window_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    tsv, target = new_path(spark, "tsv"), new_path(spark, "fasta")
    windows(spark, sf_dir).select("chrom", "start", "end").write.csv(tsv, sep="\t", header=True)
    found = G.extract_windows(S.read_windows(spark, tsv), tiles(spark, sf_dir), TILE, "skip")
    fasta.write_fasta(found, target, 50, "header")
    return fasta.read_fasta(spark, target).select("seq_id", "seq")


LAST = "last AS (SELECT 'chr' || (seq_no % 4) AS chrom, max(seq_no) AS seq_no FROM reads GROUP BY 1), chromosomes AS (SELECT chrom, seq FROM last JOIN reads USING (seq_no))"


def chromosome_folder(spark: SparkSession, sf_dir: str) -> str:
    """Four chromosomes, each in a folder chrN.fa with one file, of which the last record counts."""
    folder, rows = new_path(spark, "genome"), reads(spark, sf_dir)
    for r in range(4):
        fasta.write_fasta(rows.where(F.pmod("seq_no", F.lit(4)) == r).orderBy("seq_no").coalesce(1), f"{folder}/chr{r}.fa")
    return folder


@query(f"WITH {READS}, {LAST}, {TILES.replace('seq_no::VARCHAR AS chrom', 'chrom').replace('FROM reads', 'FROM chromosomes')} SELECT * FROM tiles")
def a5_read_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_reference(spark, chromosome_folder(spark, sf_dir), TILE)


CHROM_WINDOWS = "windows AS (SELECT 'chr' || (event_id % 5) AS chrom, (event_id * 37) % 400 AS start, (event_id * 37) % 400 + 60 AS \"end\" FROM events)"


@query(f'WITH {READS}, {LAST}, {CHROM_WINDOWS} SELECT chrom || \'|\' || start || \'|\' || "end" AS seq_id, coalesce(substr(seq, start::INTEGER + 1, 60), \'\') AS seq FROM windows JOIN chromosomes USING (chrom)')
def m7_window_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job from files to a file; the fifth chromosome that windows ask for is missing."""
    tsv, target, start = new_path(spark, "tsv"), new_path(spark, "fasta"), (F.col("event_id") * 37) % 400
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("event_id") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 60).alias("end"))
    rows.write.csv(tsv, sep="\t", header=True)
    J.window_file(spark, tsv, chromosome_folder(spark, sf_dir), target, tile=TILE, on_missing="skip")
    return fasta.read_fasta(spark, target).select("seq_id", "seq")


@query(f'WITH {READS}, {LAST}, {CHROM_WINDOWS} SELECT chrom, start, "end", coalesce(substr(seq, start::INTEGER + 1, 60), \'\') AS seq FROM windows JOIN chromosomes USING (chrom)')
def m7_indexed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an index of the files' offsets: only the windows' bytes are read."""
    index = stored(offsets.index_fasta(spark, chromosome_folder(spark, sf_dir), 50_000), "index")
    start = (F.col("event_id") * 37) % 400
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("event_id") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 60).alias("end"))
    return offsets.fetch_windows(asked, offsets.chromosomes_of(index), "skip").select("chrom", "start", "end", "seq")


@query(f"WITH {READS}, {LAST}, {TILES.replace('seq_no::VARCHAR AS chrom', 'chrom').replace('FROM reads', 'FROM chromosomes')} SELECT * FROM tiles")
def m7_indexed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles read each from its own bytes."""
    index = stored(offsets.index_fasta(spark, chromosome_folder(spark, sf_dir), 50_000), "index")
    return offsets.fetch_tiles(offsets.chromosomes_of(index), TILE)


@query(f"""WITH {MANIFEST}, r AS (SELECT 'R' || doc_id AS accession, lang || ' run' AS title FROM documents)
    SELECT r.accession, title, layout, '{archive.BROWSE}' || r.accession AS url, (SELECT round(sum(bytes) / 1e9, 2) FROM files) AS gigabytes FROM r LEFT JOIN (SELECT accession, max(layout) AS layout FROM files GROUP BY 1) USING (accession)""")
def m8_manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job on a report and an export of records, as files."""
    report, xml = new_path(spark, "manifest"), new_path(spark, "xml")
    manifest_lines(spark, sf_dir).write.text(report)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("<RUN><IDENTIFIERS><PRIMARY_ID>R"), F.col("doc_id").cast("string"), F.lit("</PRIMARY_ID></IDENTIFIERS><TITLE>"), "lang", F.lit(" run</TITLE></RUN>")).alias("value"))
    rows.write.text(xml)
    found = J.manifest(spark, report, xml, "run")
    return found["records"].withColumn("gigabytes", F.lit(found["size"].first().gigabytes))


@query(f"WITH {MANIFEST} SELECT layout, count(*) AS n_files, sum(bytes)::BIGINT AS bytes FROM files GROUP BY layout")
def m8_manifest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive.parse_manifest(manifest_lines(spark, sf_dir))
    return files.groupBy("layout").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
