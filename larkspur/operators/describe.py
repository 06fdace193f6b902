"""Summaries of columns.

All columns of a table are summarised together: they are unpivoted and counted by distinct value
(map-side partial counts shrink columns of few values before the shuffle), and everything else is
computed from those counts. Null and NaN both count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.ranks import quantile, running

QUANTILES = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
SUMMARY = ("name", "n", "unique_n", "missing_n", "missing_pct", "mean", "std", "q1", "median", "q3", "iqr", "p01", "p05", "p95", "p99", "min", "max")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is not a number becomes null, timestamps seconds, NaN null."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        c = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        c = F.unix_timestamp(c.cast("timestamp")).cast("double")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        c = F.lit(None).cast("double")
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def unpivoted(df: DataFrame, columns: list[str], value) -> DataFrame:
    """name, v: one row per row and column."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), value(c).alias("v")) for c in columns))).alias("x")).select("x.name", "x.v")


def frequencies(df: DataFrame, columns: list[str], value) -> DataFrame:
    """name, v, c: how often each column has each value, nulls included."""
    return unpivoted(df, columns, value).groupBy("name", "v").agg(F.count("*").alias("c"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded to 2 places; 0 of nothing is 0."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 2)


def numerical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SUMMARY, a row per column; statistics of a column without values are null."""
    columns = columns or numeric_columns(df)
    freq = frequencies(df, columns, lambda c: as_number(df, c))
    has = F.col("v").isNotNull()
    basic = freq.groupBy("name").agg(
        F.sum(F.when(has, F.col("c")).otherwise(0)).alias("n"), F.count("v").alias("unique_n"), F.sum(F.when(~has, F.col("c")).otherwise(0)).alias("missing_n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum(F.when(has, F.col("c")))).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    values = running(freq.where(has), "name", "v", "c").join(F.broadcast(basic.select("name", "n", "mean")), "name")
    n = F.col("n")
    spread = values.groupBy("name").agg(
        F.sum(F.col("c") * (F.col("v") - F.col("mean")) ** 2).alias("m2"), *(quantile(q, n, F.col("v"), F.col("cum")).alias(k) for k, q in QUANTILES.items())
    )
    out = basic.join(spread, "name", "left").withColumn("std", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))).withColumn("iqr", F.col("q3") - F.col("q1"))
    return out.withColumn("missing_pct", percent(F.col("missing_n"), n + F.col("missing_n"))).select(*SUMMARY)


def as_category(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c).cast("string") if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.cast("string")


def categorical_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_name, category, count, percentage of the non-null, for all columns together; order by both names for a report."""
    freq = frequencies(df, columns, lambda c: as_category(df, c)).where("v is not null")
    total = freq.groupBy("name").agg(F.sum("c").alias("total"))
    return freq.join(F.broadcast(total), "name").select(F.col("name").alias("col_name"), F.col("v").alias("category"), F.col("c").alias("count"), F.round(100.0 * F.col("c") / F.col("total"), 2).alias("percentage"))


def categorical_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, missing_n, missing_pct, unique_n, mode, mode_count, mode_pct; of equally frequent modes the first by name."""
    freq = frequencies(df, columns, lambda c: as_category(df, c))
    has = F.col("v").isNotNull()
    best = F.min(F.when(has, F.struct((-F.col("c")).alias("k"), F.col("v").alias("v"))))
    out = freq.groupBy("name").agg(F.sum(F.when(has, F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(~has, F.col("c")).otherwise(0)).alias("missing_n"), F.count("v").alias("unique_n"), best.alias("best"))
    out = out.withColumn("mode_count", -F.col("best.k")).withColumn("mode", F.col("best.v"))
    return out.select("name", "n", "missing_n", percent(F.col("missing_n"), F.col("n") + F.col("missing_n")).alias("missing_pct"), "unique_n", "mode", "mode_count", F.round(100.0 * F.col("mode_count") / F.col("n"), 2).alias("mode_pct"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def distinct_sample(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """col_name, values: the first n distinct values of each column, in order."""
    freq = frequencies(df, columns, lambda c: as_category(df, c)).where("v is not null")
    first = freq.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("v"))).where(F.col("k") <= n)
    return first.groupBy("name").agg(F.sort_array(F.collect_list("v")).alias("values")).withColumnRenamed("name", "col_name")
