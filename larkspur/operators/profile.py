"""Column profiles: what a column holds and what its name says, and the type that follows.

The counts of all columns come from one frequency table; types are decided on the few resulting rows
by expressions, with what the names say as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import naming
from larkspur.operators.describe import NUMBER, as_category, frequencies, percent

CATEGORY_MOST, NUMBER_LEAST = 4, 95.0
PROFILE = "col_name string, col_type string, missing_n long, missing_pct double, num_conversion_pct double, unique_n long, tokens array<string>, normalized_name string"


def supported(df: DataFrame) -> list[str]:
    """Columns of plain values; arrays, maps and structs have no profile."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def column_profiles(df: DataFrame, columns: list[str] | None = None, category_most: int = CATEGORY_MOST, number_least: float = NUMBER_LEAST, timestamps_are_numbers: bool = True) -> DataFrame:
    """PROFILE, a row per column. A column of nulls has no raw type; timestamps whose name does not say so count as numbers unless told otherwise."""
    columns = columns or supported(df)
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema}

    def reading(c: str) -> tuple:
        r = naming.semantic_type(c)
        moment = isinstance(kinds[c], (T.TimestampType, T.DateType, T.TimestampNTZType))
        number = isinstance(kinds[c], (T.NumericType, T.BooleanType)) or moment and timestamps_are_numbers
        return c, r.type, r.tokens, r.normalized, naming.names_date(c) or moment and not timestamps_are_numbers, naming.names_identifier(c), number

    names = spark.createDataFrame([reading(c) for c in columns], "col_name string, semantic string, tokens array<string>, normalized_name string, dated boolean, identifying boolean, number boolean")
    freq = frequencies(df, columns, lambda c: as_category(df, c))
    converts = F.col("number") | F.col("v").rlike(NUMBER)
    rows = freq.join(F.broadcast(names), F.col("name") == F.col("col_name"))
    has = F.col("v").isNotNull()
    keys = ["col_name", "semantic", "tokens", "normalized_name", "dated", "identifying"]
    counted = rows.groupBy(*keys).agg(
        F.sum(F.when(~has, F.col("c")).otherwise(0)).alias("missing_n"), F.sum(F.when(has, F.col("c")).otherwise(0)).alias("n"), F.count("v").alias("unique_n"), F.sum(F.when(has & converts, F.col("c")).otherwise(0)).alias("numeric")
    )
    n, share = F.col("n"), F.round(100.0 * F.col("numeric") / F.when(F.col("n") > 0, F.col("n")), 2)
    numeric = share >= number_least
    raw = (
        F.when(n == 0, None).when(F.col("dated"), naming.DATETIME).when(numeric & (F.col("unique_n") <= category_most), naming.CATEGORICAL)
        .when((F.col("unique_n") == n) & F.col("identifying"), naming.IDENTIFIER).when(numeric, naming.NUMERICAL).otherwise(naming.CATEGORICAL)
    )
    final = F.when(raw == naming.DATETIME, raw).otherwise(F.coalesce(F.col("semantic"), raw))
    return counted.select("col_name", final.alias("col_type"), "missing_n", percent(F.col("missing_n"), n + F.col("missing_n")).alias("missing_pct"), F.when((n > 0) & ~F.col("dated"), share).alias("num_conversion_pct"), F.when(n > 0, F.col("unique_n")).alias("unique_n"), "tokens", "normalized_name")


def semantic_types(spark, names: list[str]) -> DataFrame:
    """What names alone say: col_name, col_type, score, normalized_name."""
    rows = [(c, r.type, r.score, r.normalized) for c in names for r in [naming.semantic_type(c)]]
    return spark.createDataFrame(rows, "col_name string, col_type string, score double, normalized_name string")


def survival_profiles(spark, names: list[str]) -> DataFrame:
    """Survival roles of columns: col_name, col_type, score, tokens, normalized_name, matched_rules, all_scores."""
    rows = [(c, r.type, r.score, r.tokens, r.normalized, r.matched, r.scores) for c in names for r in [naming.survival_role(c)]]
    return spark.createDataFrame(rows, "col_name string, col_type string, score double, tokens array<string>, normalized_name string, matched_rules array<string>, all_scores map<string,double>")


def datatype_map(profiles: DataFrame) -> DataFrame:
    """col_type, columns: the columns of each type, in order; Unknown for those without."""
    return profiles.groupBy(F.coalesce("col_type", F.lit("Unknown")).alias("col_type")).agg(F.sort_array(F.collect_list("col_name")).alias("columns"))


def catalogue(overview: DataFrame) -> DataFrame:
    """Index, Dataset Name, Datatype, Column Name of (dataset_name, col_type, col_name): trimmed, without empty or repeated rows, numbered in order.

    The rows are column names, so one task can number them."""
    from pyspark.sql import Window

    rows = overview.select(F.trim("dataset_name").alias("Dataset Name"), F.trim("col_type").alias("Datatype"), F.trim("col_name").alias("Column Name"))
    rows = rows.where("`Column Name` is not null and `Column Name` != '' and `Datatype` is not null").distinct()
    at = F.row_number().over(Window.orderBy("Dataset Name", "Datatype", "Column Name"))
    return rows.withColumn("Index", at.cast("long")).select("Index", "Dataset Name", "Datatype", "Column Name")


def catalogue_blocks(rows: DataFrame) -> DataFrame:
    """key, first, last: where each dataset's columns of a type stand in the catalogue."""
    out = rows.groupBy(F.concat_ws("|", "Dataset Name", "Datatype").alias("key")).agg(F.min("Index").alias("first"), F.max("Index").alias("last"), F.count("*").alias("n"))
    return out.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n")).drop("n")
