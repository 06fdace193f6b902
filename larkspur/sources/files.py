"""Reading and writing tables and small records.

Paths may be on any file system that Spark reads; small JSON and YAML records go through Spark's
text reader and writer too, so nothing depends on the driver's disk.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from larkspur.operators.relational import same_rows


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no table at {path}") from e


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Writes a table unless there is one; warns if that differs, and never replaces it. Returns what is stored."""
    spark = df.sparkSession
    if exists(spark, path):
        kept = spark.read.parquet(path)
        if not same_rows(kept, df):
            warnings.warn(f"the table at {path} differs from the one given and is kept", stacklevel=2)
        return kept
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_records(spark: SparkSession, rows: list, schema: T.StructType | str, path: str) -> DataFrame:
    """A list of records, which may be empty, under an explicit schema."""
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV table per sheet, in a folder each."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A spreadsheet on the driver's disk, where openpyxl is installed; meant for reports, which are small."""
    import pandas as pd

    with pd.ExcelWriter(path) as out:
        for name, df in sheets.items():
            df.toPandas().to_excel(out, sheet_name=name[:31], index=False)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return rows[0][0] if rows else ""


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, indent=1, sort_keys=True))


def get_json(spark: SparkSession, path: str):
    return json.loads(get_text(spark, path))


def put_yaml(spark: SparkSession, path: str, value) -> None:
    import yaml

    put_text(spark, path, yaml.safe_dump(value, sort_keys=True))


def get_yaml(spark: SparkSession, path: str):
    import yaml

    return yaml.safe_load(get_text(spark, path))
