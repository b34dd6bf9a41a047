"""The queries of the text operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, exact_dedup, fim, license_scan, minhash, mixing, packing, pii, quality, sharding, suffix_dedup, topk, toxicity
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), ids="crc32")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.search(rows, rows.where("id % 20 = 0"), k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, lexicon)
    return found.select("doc_id", (toxicity.split_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("removed")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, model, mixing.WEIGHTS, budget=0.9, most=4.0).drop("h")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.concat(*(pii.listed(k, F.col(k)) for k in pii.BASE_PATTERNS))
    more = F.concat(*(pii.listed(k, pii.of_kind("more", k)) for k in pii.CANDIDATE_PATTERNS))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE_PATTERNS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"), F.size(F.concat(base, more)).cast("long").alias("n_spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = align.align(table(spark, sf_dir, "documents"), with_groups=False)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


ORACLE_SQL = {
    "op12_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
        m AS (SELECT *, len(lines) AS n, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, i * 8 + 1, 8))::BIGINT) AS x FROM d),
        c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM m),
        p AS (SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:n], '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
    "op2_topk": """
        WITH c AS (
            SELECT vec_id AS id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding, lambda x, i:
                CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN (-9223372036854775807 - 1)::BIGINT ELSE (1::BIGINT << (i - 1)::BIGINT) END ELSE 0::BIGINT END)), lambda a, b: xor(a, b)) AS code
            FROM embeddings),
        p AS (
            SELECT q.id AS query_id, c.id AS neighbour_id, bit_count(xor(q.code, c.code))::INTEGER AS distance
            FROM c q JOIN c ON q.id % 20 = 0 AND q.id <> c.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, neighbour_id, distance FROM r WHERE rank <= 10
    """,
    "op8_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
