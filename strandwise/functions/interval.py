"""Half-open intervals as struct<start,end> Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def intersection(a: Column, b: Column) -> Column:
    """Null where they don't overlap."""
    return F.when(overlaps(a, b), interval(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))


def span(a: Column, b: Column) -> Column:
    """The smallest interval that holds both."""
    return interval(F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))


def difference(a: Column, b: Column) -> Column:
    """What is left of a without b: an array of up to two intervals."""
    left = interval(a["start"], F.least(a["end"], b["start"]))
    right = interval(F.greatest(a["start"], b["end"]), a["end"])
    cut = F.filter(F.array(left, right), lambda x: x["start"] < x["end"])
    return F.when(overlaps(a, b), cut).otherwise(F.array(interval(a["start"], a["end"])))
