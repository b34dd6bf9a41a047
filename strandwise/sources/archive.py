"""Manifests and record tables of a read archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROWSE = "https://www.ebi.ac.uk/ena/browser/view/"  # fixed value: where a record can be looked at
#: For each kind of record its row tag and the tag of its title.
KINDS = {"run": ("RUN", "TITLE"), "study": ("STUDY", "STUDY_TITLE"), "experiment": ("EXPERIMENT", "TITLE"), "sample": ("SAMPLE", "TITLE")}


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(value) -> a row for each file: accession, layout, file_no, file_name, link, bytes. Fields are separated by
    white space; the second has the links and the fourth the sizes, both separated by semicolons. Lines whose
    second field doesn't begin like a link are left out. A size that is missing is null."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(fields, F.lit(0)).alias("accession"), F.get(fields, F.lit(1)).alias("links"), F.get(fields, F.lit(3)).alias("sizes")).where(F.col("links").startswith("ftp"))
    rows = rows.select("accession", F.split("links", ";").alias("links"), F.split(F.coalesce("sizes", F.lit("")), ";").alias("sizes"))
    layout = F.when(F.size("links") >= 2, "PAIRED").otherwise("SINGLE")
    each = rows.select("accession", layout.alias("layout"), F.posexplode("links").alias("file_no", "link"), "sizes")
    return each.select("accession", "layout", "file_no", F.substring_index("link", "/", -1).alias("file_name"), F.concat(F.lit("ftp://"), "link").alias("link"), F.expr("try_cast(get(sizes, file_no) AS BIGINT)").alias("bytes"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def manifest_size(files: DataFrame) -> DataFrame:
    """One row: gigabytes (of a thousand millions), to two places."""
    return files.agg(F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1e9), 2).alias("gigabytes"))


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(accession, title) of an archive's XML export. The parser that cuts at row tags can split large files."""
    row_tag, title = KINDS[kind]
    nested = "STRUCT<STUDY_TITLE: STRING>" if kind == "study" else None
    schema = "IDENTIFIERS STRUCT<PRIMARY_ID: STRING>, TITLE STRING" + (f", DESCRIPTOR {nested}, STUDY_TITLE STRING" if nested else "")
    rows = spark.read.format("xml").option("rowTag", row_tag).option("useLegacyXMLParser", True).schema(schema).load(path)
    named = F.coalesce("DESCRIPTOR.STUDY_TITLE", "STUDY_TITLE") if nested else F.col(title)
    return rows.select(F.col("IDENTIFIERS.PRIMARY_ID").alias("accession"), named.alias("title"))


def record_table(records: DataFrame, files: DataFrame, n: int | None = None) -> DataFrame:
    """accession, title, layout, url; joined on the accession. With n: the first n accessions."""
    layouts = files.groupBy("accession").agg(F.max("layout").alias("layout"))
    out = records.join(layouts, "accession", "left").select("accession", "title", "layout", F.concat(F.lit(BROWSE), "accession").alias("url"))
    return out if n is None else first_records(out, n)


def first_records(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("accession").limit(n)
