"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The
stages' outputs are written as Parquet and read back before the next one starts.

1. quality: documents that the ordinal quality model rejects go.
2. exact_dedup: of texts that are equal but for white space, one stays.
3. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8), one stays.
4. mixing: documents stay at rates that bring the expected tokens of the domains to their target shares; the
   clean domain is covered whole, so it is the other that is thinned out.
5. packing: what is left is cut into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import exact_dedup, minhash, mixing, packing, quality
from strandwise.llm.common import stored, table


#: What mixing tells apart: the quality stage has removed the third domain of the labels, and a target for it would ask for what is gone.
WEIGHTS = {domain: mixing.WEIGHTS[domain] for domain in ("toxic", "clean")}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the model accepts, with all their columns.

    A null text counts as empty and is rated as such; a row without a doc_id goes. Long texts are rated whole. Repeated rows, and rows that share a
    doc_id, are rated each by its own text and share their fate if it is the same. An empty table stays empty; further columns, whatever their
    names, are kept and not looked at."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space one: the one with the longest text, then the smallest doc_id.

    Null, empty and blank texts are one group. Repeated rows leave one. Rows without a doc_id go. An empty table stays empty; further columns are
    kept and not looked at."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 of their five-word shingles one: that with the smallest doc_id.

    Texts without words are linked with nothing and stay; shorter texts are one shingle. Repeated rows are copies of one text. Rows without a doc_id
    go. An empty table stays empty; further columns are kept and not looked at."""
    return minhash.deduplicate(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows at rates of at most 1 that bring the expected tokens of toxic and clean documents to 5 to 92, all of the clean ones covered.

    A null or empty text has no tokens and follows the prior. Repeated rows have the same rate and stay or go together. Rows without a doc_id
    go. An empty table stays empty; further columns are kept and not looked at."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domains=tuple(WEIGHTS))
    return mixing.resample(docs, mixing.mix(docs, model, WEIGHTS, cover="clean", most=1.0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 tokens.

    A null or empty text is one piece, its end id. Repeated rows are packed as often as they occur. Rows without a doc_id go. An empty table gives no
    pieces; further columns are not looked at."""
    pieces = packing.pack(docs, ids="crc32")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fitted models can't be expressed in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
