"""Ordered statistics that don't bring a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def running_sums(df: DataFrame, order: str, sums: list[str], keys: list[str] | None = None, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """df with run_<s>, the sum of each s up to and with the row's value of order, within keys.

    Values are dealt by size into equal buckets between a group's ends; a window
    runs within each bucket, and another over the buckets' totals, of which there
    are no more than buckets a group.  Rows of equal order get the same sums.
    """
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    j = df.join(ends, keys) if keys else df.crossJoin(ends)
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(buckets - 1), F.floor((F.col(order) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets).cast("int"))).otherwise(0)
    j = j.withColumn("__b", -at if descending else at).drop("__lo", "__hi")
    part = ", ".join(["__b", *keys])
    way = "desc" if descending else "asc"
    inner = j.selectExpr("*", *(f"sum({s}) over (partition by {part} order by {order} {way}) as __in_{s}" for s in sums))
    of = f"partition by {', '.join(keys)} " if keys else ""
    totals = j.groupBy("__b", *keys).agg(*(F.sum(s).alias(f"__t_{s}") for s in sums))
    before = totals.selectExpr("__b", *keys, *(f"coalesce(sum(__t_{s}) over ({of}order by __b rows between unbounded preceding and 1 preceding), 0) as __before_{s}" for s in sums))
    out = inner.join(before, ["__b", *keys])
    return out.select(*df.columns, *((F.col(f"__in_{s}") + F.col(f"__before_{s}")).alias(f"run_{s}") for s in sums))
