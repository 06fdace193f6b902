"""Projects: named datasets, versions of their curation, and the reports made of them.

A project is a folder: ``catalog.json`` lists datasets, each with its source table and
``version<N>/config<M>`` folders whose ``meta.json`` says what they were made with. Each step skips
what exists.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import naming
from larkspur.operators import curate, describe, normality, profile, survival
from larkspur.sources import files


class Folder:
    """A folder with numbered children and a record about itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def meta(self) -> dict:
        at = f"{self.path}/meta.json"
        return files.get_json(self.spark, at) if files.exists(self.spark, at) else {}

    def put_meta(self, meta: dict) -> None:
        files.put_json(self.spark, f"{self.path}/meta.json", meta)

    def numbers(self, kind: str) -> list[int]:
        children = self.meta().get("children", {}).get(kind, [])
        return sorted(children)

    def child(self, kind: str, number: int | None = None, create_new: bool = False, meta: dict | None = None) -> Folder:
        """The numbered child; None: the latest, which is made if there is none. create_new: one more. A number that does not exist is an error, as is one given together with create_new."""
        have = self.numbers(kind)
        if create_new and number is not None:
            raise ValueError("a number and create_new contradict each other")
        if number is not None and number not in have:
            raise FileNotFoundError(f"{self.path} has no {kind}{number}")
        new = create_new or not have
        number = (max(have, default=0) + 1 if new else have[-1]) if number is None else number
        out = Folder(self.spark, f"{self.path}/{kind}{number}")
        if new:
            own = self.meta()
            own.setdefault("children", {}).setdefault(kind, []).append(number)
            out.put_meta(meta or {})
            self.put_meta(own)
        elif meta is not None and {k: v for k, v in out.meta().items() if k != "children"} != meta:
            raise ValueError(f"{out.path} was made with other settings")
        return out


class Dataset:
    """One source table and its curation."""

    def __init__(self, folder: Folder, df: DataFrame | None = None):
        self.folder, self.spark = folder, folder.spark
        at = f"{folder.path}/source_df.parquet"
        if df is None and not files.exists(self.spark, at):
            raise ValueError(f"neither a table nor one stored at {at}")
        self.source = files.write_once(df, at) if df is not None else files.read_parquet(self.spark, at)

    def _kept(self, folder: Folder, name: str, make) -> DataFrame:
        at = f"{folder.path}/{name}.parquet"
        if not files.exists(self.spark, at):
            make().write.parquet(at)
        return files.read_parquet(self.spark, at)

    def profiles(self, version: int | None = None) -> DataFrame:
        return self._kept(self.folder.child("version", version), "col_profiles", lambda: profile.column_profiles(self.source))

    def apply(self, col_edits: DataFrame, cat_edits: DataFrame | None = None, surv_meta: DataFrame | None = None, surv_cat_edits: DataFrame | None = None, version: int | None = None, config: int | None = None) -> Folder:
        """Curated table, profiles and survival pairs of a configuration."""
        v = self.folder.child("version", version)
        c = v.child("config", config)
        edits = curate.column_edits(col_edits)
        self._kept(c, "col_profiles_curated", lambda: curate.curated_profiles(self.profiles(version), edits))
        pairs = curate.survival_pairs(surv_meta) if surv_meta is not None else self.spark.createDataFrame([], "surv_label string, event_col string, time_col string")
        self._kept(c, "surv_pairs", lambda: pairs)
        parsed = [curate.category_edits(e) if e is not None else None for e in (cat_edits, surv_cat_edits)]
        self._kept(c, "df", lambda: curate.curated(self.source, edits, *parsed))
        return c

    def analysis(self, version: int | None = None, config: int | None = None) -> Analysis:
        c = self.folder.child("version", version).child("config", config)
        names = ("df", "col_profiles_curated", "surv_pairs")
        if missing := [n for n in names if not files.exists(self.spark, f"{c.path}/{n}.parquet")]:
            raise RuntimeError(f"{c.path} lacks {missing}; apply edits first")
        return Analysis(*(files.read_parquet(self.spark, f"{c.path}/{n}.parquet") for n in names))


class Analysis:
    """Reports of a curated table."""

    def __init__(self, df: DataFrame, profiles: DataFrame, pairs: DataFrame):
        self.df, self.profiles, self.pairs = df, profiles, pairs

    def columns(self, kind: str) -> list[str]:
        return [r.col_name for r in self.profiles.where(F.col("col_type") == kind).orderBy("col_name").collect()]

    def datatype_map(self) -> DataFrame:
        return profile.datatype_map(self.profiles)

    def summary(self) -> dict[str, DataFrame]:
        """Numerical, normality and categorical frames; of a kind without columns there is none."""
        out, numbers, categories = {}, self.columns(naming.NUMERICAL), self.columns(naming.CATEGORICAL)
        if numbers:
            out |= {"numerical": describe.numerical_summary(self.df, numbers), "normality": normality.diagnostics(self.df, numbers)}
        if categories:
            out["categorical"] = describe.categorical_distribution(self.df, categories)
        return out

    def endpoints(self, times: tuple = survival.TIME_POINTS) -> DataFrame | None:
        frames = {r.surv_label: survival.survival_frame(self.df, r.time_col, r.event_col, lenient=True) for r in self.pairs.orderBy("surv_label").collect()}
        return survival.endpoint_summary(frames, times) if frames else None

    def config_frames(self) -> dict[str, DataFrame]:
        """Empty frames to fill in: which columns to compare for which endpoints."""
        spark = self.df.sparkSession
        return {"binary": spark.createDataFrame([], "`Categorical` string, `Survival Labels` string"), "multi": spark.createDataFrame([], "`Categorical` string, `Survival Labels` string"), "cutpoint": spark.createDataFrame([], "`Numerical` string, `Survival Labels` string")}


class Project:
    """Datasets by name."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.at = f"{self.path}/catalog.json"
        self.catalog = files.get_json(spark, self.at) if files.exists(spark, self.at) else {"project_name": name or re.sub(r".*/", "", self.path), "datasets": {}}
        self.datasets = {n: Dataset(Folder(spark, f"{self.path}/{n}")) for n, done in self.catalog["datasets"].items() if done}

    def add_dataset(self, name: str, df: DataFrame) -> Dataset:
        """A name is used once; what fails half way is not listed and can be added again."""
        if name in self.datasets:
            raise ValueError(f"there is a dataset {name!r}")
        self.catalog["datasets"][name] = False
        files.put_json(self.spark, self.at, self.catalog)
        out = Dataset(Folder(self.spark, f"{self.path}/{name}"), df)
        self.catalog["datasets"][name] = True
        files.put_json(self.spark, self.at, self.catalog)
        self.datasets[name] = out
        return out

    def overview(self) -> DataFrame:
        """dataset_name, col_type, col_name of all datasets."""
        frames = [d.profiles().select(F.lit(n).alias("dataset_name"), F.coalesce("col_type", F.lit("Unknown")).alias("col_type"), "col_name") for n, d in self.datasets.items()]
        if not frames:
            raise ValueError("the project has no dataset")
        return reduce(DataFrame.unionByName, frames)

    def catalogue(self) -> DataFrame:
        return profile.catalogue(self.overview())
