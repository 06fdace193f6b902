"""Publication tables: cohorts side by side, printed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import labels, naming
from larkspur.operators.describe import duplicates

MISSING = labels.MISSING


class TableError(ValueError):
    """Rows that cannot be told apart."""


def _stacked(cohorts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("cohort"), *columns) for name, df in cohorts.items()))


def fixed(x, places: int):
    return F.format_number(x, places)


def numeric_table(cohorts: dict[str, DataFrame], statistics: tuple[str, ...] = ("n", "mean_sd", "median_iqr", "missing_pct"), places: int = 2, sections: dict[str, list[str]] | None = None) -> DataFrame:
    """section, variable, statistic and a column per cohort of printed values; a cohort without a variable prints a dash.

    cohorts: numerical summaries by name. sections: variables by title, in order; None takes all. A variable that one cohort has twice is an error."""
    if unknown := set(statistics) - set(labels.STATISTICS):
        raise TableError(f"unknown statistics: {sorted(unknown)}")
    rows = _stacked(cohorts, ["name", "n", "mean", "std", "median", "q1", "q3", "min", "max", "missing_n", "missing_pct"])
    if twice := duplicates(rows, ["cohort", "name"]).collect():
        raise TableError(f"variables occur twice: {[(r.cohort, r.name) for r in twice]}")
    title = {"n": fixed(F.col("n"), 0), "mean_sd": F.concat(fixed(F.col("mean"), places), F.lit(" ("), fixed(F.col("std"), places), F.lit(")")),
             "median_iqr": F.concat(fixed(F.col("median"), places), F.lit(" ("), fixed(F.col("q1"), places), F.lit(" - "), fixed(F.col("q3"), places), F.lit(")")),
             "mean": fixed(F.col("mean"), places), "std": fixed(F.col("std"), places), "median": fixed(F.col("median"), places), "q1": fixed(F.col("q1"), places), "q3": fixed(F.col("q3"), places),
             "min_max": F.concat(fixed(F.col("min"), places), F.lit(" - "), fixed(F.col("max"), places)), "missing": fixed(F.col("missing_n"), 0), "missing_pct": F.concat(fixed(F.col("missing_n"), 0), F.lit(" ("), fixed(F.col("missing_pct"), 1), F.lit("%)"))}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(labels.STATISTICS[s][0]).alias("statistic"), F.coalesce(title[s], F.lit(MISSING)).alias("text")) for i, s in enumerate(statistics))))
    long = rows.select("cohort", F.col("name").alias("variable"), each.alias("x")).select("cohort", "variable", "x.*")
    wide = long.groupBy("variable", "k", "statistic").pivot("cohort", list(cohorts)).agg(F.first("text")).na.fill(MISSING, list(cohorts))
    return _sectioned(wide, "variable", sections, ["variable", "statistic", *cohorts], "k")


def _sectioned(wide: DataFrame, key: str, sections: dict[str, list[str]] | None, columns: list[str], order: str) -> DataFrame:
    if sections is None:
        return wide.orderBy(key, order).select(F.lit("").alias("section"), *columns)
    spark = wide.sparkSession
    place = spark.createDataFrame([(s, naming.label(v), i, j) for i, (s, vs) in enumerate(sections.items()) for j, v in enumerate(vs)], "section string, __v string, __i int, __j int")
    return place.join(wide, F.col(key) == F.col("__v")).orderBy("__i", "__j", order).select("section", *columns)


def categorical_table(cohorts: dict[str, DataFrame], places: int = 1, sections: dict[str, list[str]] | None = None) -> DataFrame:
    """section, variable, category and a column per cohort of n (percent%); absent categories print a dash. cohorts: distributions by name."""
    rows = _stacked(cohorts, ["col_name", "category", "count", "percentage"])
    if twice := duplicates(rows, ["cohort", "col_name", "category"]).collect():
        raise TableError(f"categories occur twice: {[(r.cohort, r.col_name, r.category) for r in twice]}")
    text = F.concat(fixed(F.col("count"), 0), F.lit(" ("), fixed(F.col("percentage"), places), F.lit("%)"))
    wide = rows.withColumn("text", text).groupBy(F.col("col_name").alias("variable"), "category").pivot("cohort", list(cohorts)).agg(F.first("text")).na.fill(MISSING, list(cohorts))
    return _sectioned(wide, "variable", sections, ["variable", "category", *cohorts], "category")


def carried_down(df: DataFrame, column: str, order: str) -> DataFrame:
    """Blank cells of a merged column take the last value above. The rows are those of a report, so one task can order them."""
    from pyspark.sql import Window

    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def selected_summaries(config: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries (dataset_name, name, ...) that the config (dataset_name, column_name, uid) asks for, with its uid."""
    asked = config.where(F.trim("column_name") != "").select("uid", F.col("dataset_name").alias("__d"), F.trim("column_name").alias("__c")).distinct()
    return summaries.join(F.broadcast(asked), (F.col("dataset_name") == F.col("__d")) & (F.col("name") == F.col("__c"))).drop("__d", "__c")
