"""Running counts and exact quantiles over sorted values, without a window that one task must hold.

A table of distinct values with counts is cut at approximate quantiles into buckets of each key;
running counts are windows within a bucket behind the bucket's offset. The cuts only balance the
work, so the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def with_bucket(freq: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    grid = [i / buckets for i in range(1, buckets)]
    cuts = freq.groupBy(key).agg(F.percentile_approx(value, grid, 1000).alias("__cuts"))  # a row per key
    joined = freq.join(F.broadcast(cuts), key)
    return joined.withColumn("__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def running(freq: DataFrame, key: str, value: str, count: str, name: str = "cum", buckets: int = BUCKETS) -> DataFrame:
    """freq (distinct values of each key, with counts) with the number of rows up to and including each value."""
    dealt = with_bucket(freq, key, value, buckets)
    total = dealt.groupBy(key, "__bucket").agg(F.sum(count).alias("__t"))
    before = total.withColumn("__before", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    within = F.sum(count).over(Window.partitionBy(key, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__within", within).join(F.broadcast(before), [key, "__bucket"]).withColumn(name, F.col("__within") + F.col("__before")).drop("__within", "__before", "__bucket")


def quantile(q: float, n: Column, value: Column, cum: Column) -> Column:
    """Linear interpolation between order statistics, as an aggregate over running counts."""
    at = F.lit(q) * (n - 1)
    low = F.min(F.when(cum >= F.floor(at) + 1, value))
    high = F.min(F.when(cum >= F.ceil(at) + 1, value))
    first = F.max(at - F.floor(at))
    return low + (high - low) * first
