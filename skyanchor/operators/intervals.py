"""Joins of values with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _c

#: Intervals up to which they are broadcast, and buckets of values beyond.
BROADCAST_ROWS, BUCKETS = 10_000, 1024


def interval_join(left: DataFrame, value: str, intervals: DataFrame, low: str = "h0", high: str = "h1") -> DataFrame:
    """left with the columns of each interval [low, high) that holds its value; a null value or none such has no row.

    Few intervals are broadcast, once counted.  Many are dealt into buckets between
    their ends, in which they meet the values by equality.
    """
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    ends = intervals.agg(F.count("*").alias("n"), F.min(low).alias("lo"), F.max(high).alias("hi")).first()
    if ends["n"] <= BROADCAST_ROWS:
        return left.join(F.broadcast(intervals), inside)
    width = (ends["hi"] - ends["lo"]) / BUCKETS or 1.0
    at = lambda c: F.floor((_c(c) - ends["lo"]) / width).cast("bigint")
    name = "bucket"
    while name in left.columns or name in intervals.columns:
        name += "_"
    spread = intervals.withColumn(name, F.explode(F.sequence(at(low), at(high))))
    return left.withColumn(name, at(value)).join(spread, name).filter(inside).drop(name)


def envelope_sigma(left: DataFrame, height: str, envelope: DataFrame) -> DataFrame:
    """left with sigma_m, linear between s0 and s1 over the interval [h0, h1) of envelope that holds its height."""
    j = interval_join(left, height, envelope)
    s = F.when(F.col("s0") == F.col("s1"), F.col("s0")).otherwise(F.col("s0") + (F.col(height) - F.col("h0")) / (F.col("h1") - F.col("h0")) * (F.col("s1") - F.col("s0")))
    return j.withColumn("sigma_m", s).drop("h0", "h1", "s0", "s1")
