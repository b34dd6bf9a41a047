"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, stored

#: Rows in a file of links or labels.
FILE_ROWS = 50_000


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), any order, repeats allowed -> (id, component): the smallest id reachable, for every id
    that occurs. Every round takes the smallest label of the neighbours, then the label that this label had before; labels
    are written to the shared folder, so lineage stays short. Rounds: about the logarithm of the longest path."""
    most = 2 * links.count()
    both = stored(few_files(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), most, FILE_ROWS), "links")
    labels = stored(few_files(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), most, FILE_ROWS), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("theirs")), "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("theirs", "component")).alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = stored(few_files(step.join(jump, "component", "left").select("id", "was", F.least("component", F.coalesce("further", "component")).alias("component")), most, FILE_ROWS), "labels")
        if labels.where("was <> component").isEmpty():
            return labels.select("id", "component")
