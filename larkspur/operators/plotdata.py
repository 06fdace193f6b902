"""What plots draw, as small DataFrames; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import dist
from larkspur.operators.describe import as_number, frequencies
from larkspur.operators.ranks import running


def km_steps(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The curve from (0, 1) on."""
    keys = list(keys)
    start = curve.select(*keys).distinct() if keys else curve.limit(1).select()
    one = start.select(*keys, F.lit(0.0).alias("time"), *(F.lit(1.0).alias(c) for c in ("s", "ci_low", "ci_high")))
    return one.unionByName(curve.select(*keys, "time", "s", "ci_low", "ci_high"))


def at_risk(surv: DataFrame, ticks: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, tick, at_risk, events, censored: below a survival plot."""
    rows = surv.withColumn("tick", F.explode(F.array(*(F.lit(float(t)) for t in ticks))))
    before = F.col("time") < F.col("tick")
    return rows.groupBy(*keys, "tick").agg(F.sum((~before).cast("long")).alias("at_risk"), F.sum((before & F.col("event")).cast("long")).alias("events"), F.sum((before & ~F.col("event")).cast("long")).alias("censored"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, count, normal: counts in equal bins (the largest value is in the last), and what a normal curve would put there."""
    v = as_number(df, column)
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).first()
    spark = df.sparkSession
    if not stats.n:
        return spark.createDataFrame([], "bin int, low double, high double, count long, normal double")
    width = (stats.hi - stats.lo) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((v - stats.lo) / width)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))

    def expected(i: int) -> float:
        if not stats.sd:
            return math.nan
        return stats.n * (dist.NORMAL.cdf((stats.lo + (i + 1) * width - stats.mean) / stats.sd) - dist.NORMAL.cdf((stats.lo + i * width - stats.mean) / stats.sd))

    table = spark.createDataFrame([(i, stats.lo + i * width, stats.lo + (i + 1) * width, expected(i)) for i in range(bins)], "bin int, low double, high double, normal double")
    return table.join(F.broadcast(counts), "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"), "normal")


def qq_points(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """theoretical, ordered: order statistics at evenly spaced ranks against normal scores."""
    freq = frequencies(df, [column], lambda c: as_number(df, c)).where("v is not null")
    n = freq.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    spark = df.sparkSession
    count = min(points, n)
    ranks = sorted({max(1, round((i + 0.5) * n / count + 0.5)) for i in range(count)}) if n else []
    wanted = spark.createDataFrame([(r, dist.NORMAL.inv_cdf((r - 0.375) / (n + 0.25))) for r in ranks], "rank long, theoretical double")
    rows = running(freq, "name", "v", "c").join(F.broadcast(wanted), (F.col("rank") <= F.col("cum")) & (F.col("rank") > F.col("cum") - F.col("c")))
    return rows.select("rank", "theoretical", F.col("v").alias("ordered"))


def scan_curves(scanned: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A scan with what its plots show: -log10 of the p-values, width of the limits, significance and imbalance beyond ten to one."""
    def strength(c: str):
        return -F.log10(F.greatest(F.col(c), F.lit(1e-300)))

    out = scanned.where("valid_split").withColumn("log_rank_strength", strength("log_rank_p")).withColumn("cox_strength", strength("cox_p"))
    return out.withColumn("ci_width", F.col("ci_high") - F.col("ci_low")).withColumn("significant", F.col("cox_p") < alpha).withColumn("unbalanced", (F.col("split_ratio") > 10) | (F.col("split_ratio") < 0.1))


def capped_medians(medians: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Medians for drawing: those not reached stand 15% above the largest that is."""
    top = F.max(F.when(F.col("median") < math.inf, F.col("median"))).over(Window.partitionBy(F.lit(0)))
    return medians.withColumn("reached", F.col("median") < math.inf).withColumn("drawn", F.when(F.col("median") < math.inf, F.col("median")).otherwise(1.15 * top))
