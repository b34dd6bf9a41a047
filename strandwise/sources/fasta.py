"""Sequence files.

FASTA files are read by Spark's text source with the start of a record as separator, so plain files are split and
records of several lines stay whole. Compressed files can't be split; many of them are read side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

READS = T.StructType([T.StructField("seq_no", T.LongType()), T.StructField("seq_id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("seq", T.StringType())])


def header_parts(header: Column) -> list[Column]:
    """seq_id, what comes before the first white space of any kind, and description, what comes after it."""
    return [F.regexp_extract(header, r"^\S*", 0).alias("seq_id"), F.regexp_replace(F.regexp_replace(header, r"^\S*\s*", ""), r"\s+$", "").alias("description")]


def parse_records(raw: DataFrame, *more: Column) -> DataFrame:
    """(value) as cut at "newline, >" -> seq_id, description, seq (upper case), and ``more``."""
    record = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(record, "\n", 1), "\r", ""))  # ends at the line break of either kind
    body = F.regexp_replace(F.when(F.instr(record, "\n") > 0, F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(F.lit("")), r"[\s>]+", "")
    return raw.where(F.length(F.trim("value")) > 0).select(*header_parts(header), F.upper(body).alias("seq"), *more)


def read_fasta(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """seq_no, seq_id, description, seq of plain or .gz files.

    ``seq_no`` tells records apart; with ``numbered`` it counts them in file order (a bare ">" too, though it gives no row), which takes a
    second pass over the input to know how many records each split has; no sequence is shuffled."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    if numbered:
        # The id's lower 33 bits count the records of a split; what is missing is how many came before the split.
        placed = raw.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within"), "value")
        counts = placed.groupBy("part").agg(F.count("*").alias("n"))
        before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each split
        raw = placed.join(F.broadcast(before), "part").select((F.col("before") + F.col("within")).cast("long").alias("seq_no"), "value")
        return parse_records(raw, F.col("seq_no")).select("seq_no", "seq_id", "description", "seq")
    return parse_records(raw, F.monotonically_increasing_id().alias("seq_no")).select("seq_no", "seq_id", "description", "seq")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seq_no (tells records apart), seq_id, description, seq, qual of plain or .gz files with records of four lines.

    Files are split at a line break and "@", so a record stays whole, but for those whose quality begins with "@": they come in two
    parts, of three lines and of what follows the "@". Only these parts are shuffled, to be put together in the order of the file."""
    raw = spark.read.option("lineSep", "\n@").text(path)
    lines = F.split(F.regexp_replace("value", r"\r\z", ""), "\r?\n", -1)  # the separator may have left half a line break
    parts = raw.select(F.monotonically_increasing_id().alias("seq_no"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), lines.alias("x")).where("not (size(x) <= 2 and trim(array_join(x, '')) = '' and block = 0 and seq_no % 8589934592 = 0)")
    whole = parts.where(F.size("x") >= 4).select("seq_no", F.get("x", F.lit(0)).alias("header"), F.get("x", F.lit(1)).alias("seq"), F.get("x", F.lit(3)).alias("qual"))
    next_part = F.lead("x").over(Window.partitionBy("file").orderBy("block", "seq_no"))
    torn = parts.where(F.size("x") < 4).withColumn("rest", next_part).where(F.size("x") == 3)
    mended = torn.select("seq_no", F.get("x", F.lit(0)).alias("header"), F.get("x", F.lit(1)).alias("seq"), F.concat(F.lit("@"), F.coalesce(F.get("rest", F.lit(0)), F.lit(""))).alias("qual"))
    header = F.regexp_replace("header", "^@", "")
    return whole.unionByName(mended).select("seq_no", *header_parts(header), F.upper(F.trim("seq")).alias("seq"), F.trim("qual").alias("qual"))


def read_rounds(spark: SparkSession, paths: list[str], min_round: int, max_round: int) -> DataFrame:
    """Reads of several rounds: the file at place i belongs to round min_round + i; what goes beyond the shorter of files and
    rounds is left out."""
    parts = [read_fasta(spark, p).withColumn("round", F.lit(r)) for p, r in zip(paths, range(min_round, max_round + 1), strict=False)]
    if not parts:
        return spark.createDataFrame([], T.StructType([*READS.fields, T.StructField("round", T.IntegerType())]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fasta_text(header: Column, seq: Column, width: int = 60) -> Column:
    """A record as text, its sequence in lines of ``width``."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def fasta_lines(df: DataFrame, width: int = 60, header: str = "seq_id", seq: str = "seq") -> DataFrame:
    return df.select(fasta_text(F.col(header), F.col(seq), width).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60, header: str = "seq_id", seq: str = "seq") -> None:
    fasta_lines(df, width, header, seq).write.mode("overwrite").text(path)


def reads_of_documents(docs: DataFrame) -> DataFrame:
    """Reads made of any text table (doc_id, text): the letters A, C, G, T, N of the text, in upper case."""
    return docs.select(F.col("doc_id").alias("seq_no"), F.col("doc_id").cast("string").alias("seq_id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]", "")).alias("seq"))
