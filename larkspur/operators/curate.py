"""Curation: edits as tables, checked and applied.

Where a person would fill in a workbook, the library takes and gives DataFrames: a report is a
skeleton with blank edit columns, and edits are parsed from it (or from CSV) before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import naming
from larkspur.operators.describe import categorical_distribution

COL_EDITS = "col_name string, remove boolean, change_col_name string, change_datatype string"
CAT_EDITS = "col_name string, category string, rename_to string, remove boolean"


class EditError(ValueError):
    """Edits that contradict themselves or the data."""


def flag(c: Column) -> Column:
    """A filled cell as boolean; text counts as true when it says so."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "y", "x"), F.lit(False))


def filled(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text != "", text)


def column_report(profiles: DataFrame) -> DataFrame:
    """The skeleton for column edits, one block per type."""
    return profiles.select("col_name", F.lit(None).cast("string").alias("change_col_name"), F.coalesce("col_type", F.lit("Unknown")).alias("inferred_datatype"), F.lit(None).cast("string").alias("change_datatype"), F.lit(None).cast("boolean").alias("remove")).orderBy("inferred_datatype", "col_name")


def column_edits(filled_in: DataFrame) -> DataFrame:
    """COL_EDITS, without rows that change nothing. An unknown datatype is an error."""
    out = filled_in.select("col_name", flag(F.col("remove")).alias("remove"), filled(F.col("change_col_name")).alias("change_col_name"), filled(F.col("change_datatype")).alias("change_datatype"))
    out = out.where("remove or change_col_name is not null or change_datatype is not null")
    if odd := [r[0] for r in out.where(F.col("change_datatype").isNotNull() & ~F.col("change_datatype").isin(*naming.TYPES, *naming.SURVIVAL_ROLES)).select("change_datatype").distinct().collect()]:
        raise EditError(f"unknown datatypes: {odd}")
    return out


def renames(edits: DataFrame) -> dict[str, str]:
    """New name to old name, of columns that stay. There are as many rows as edited columns."""
    return {r.change_col_name: r.col_name for r in edits.where("change_col_name is not null and not remove").collect()}


def curated_profiles(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """Profiles after edits: removed columns go, names and types change."""
    e = edits.select(F.col("col_name").alias("__c"), "remove", "change_col_name", "change_datatype")
    out = profiles.join(F.broadcast(e), F.col("col_name") == F.col("__c"), "left").where("not coalesce(remove, false)")
    return out.withColumn("col_type", F.coalesce("change_datatype", "col_type")).withColumn("col_name", F.coalesce("change_col_name", "col_name")).select(*profiles.columns)


def category_report(df: DataFrame, columns: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """col_name, category, count, percentage and blank rename_to, remove. columns: curated names; renamed: new to old."""
    old = {c: (renamed or {}).get(c, c) for c in columns}
    source = df.select(*(F.col(f"`{o}`").alias(c) for c, o in old.items()))
    return categorical_distribution(source, columns).withColumn("rename_to", F.lit(None).cast("string")).withColumn("remove", F.lit(None).cast("boolean")).orderBy("col_name", "category")


def category_edits(filled_in: DataFrame) -> DataFrame:
    """CAT_EDITS, without rows that change nothing."""
    out = filled_in.select("col_name", F.col("category").cast("string").alias("category"), filled(F.col("rename_to")).alias("rename_to"), flag(F.col("remove")).alias("remove"))
    return out.where("remove or rename_to is not null")


def survival_report(roles: DataFrame) -> DataFrame:
    """The skeleton for survival edits: each survival column with the role that its name suggests (Event or Time) and blank change_datatype, survival_label and remove. roles: ``profile.survival_profiles``."""
    blank = F.lit(None).cast("string")
    return roles.select("col_name", F.coalesce("col_type", F.lit("Unknown")).alias("inferred_datatype"), blank.alias("change_datatype"), blank.alias("survival_label"), F.lit(None).cast("boolean").alias("remove")).orderBy("inferred_datatype", "col_name")


def survival_edits(filled_in: DataFrame) -> DataFrame:
    """The filled-in report with clean cells, without rows that change nothing. A change_datatype other than a survival role is an error."""
    out = filled_in.select("col_name", "inferred_datatype", filled(F.col("change_datatype")).alias("change_datatype"), filled(F.col("survival_label")).alias("survival_label"), flag(F.col("remove")).alias("remove"))
    out = out.where("remove or change_datatype is not null or survival_label is not null")
    if odd := [r[0] for r in out.where(F.col("change_datatype").isNotNull() & ~F.col("change_datatype").isin(*naming.SURVIVAL_ROLES)).select("change_datatype").distinct().collect()]:
        raise EditError(f"unknown survival roles: {odd}")
    return out


def survival_pairs(meta: DataFrame) -> DataFrame:
    """surv_label, event_col, time_col. Each label needs two rows, one of type Event and one of type Time (change_datatype overrides what was inferred); rows without a label are ignored."""
    kind = F.coalesce("change_datatype", "inferred_datatype")
    rows = meta.where("survival_label is not null and not coalesce(remove, false)").withColumn("kind", kind)
    out = rows.groupBy(F.col("survival_label").alias("surv_label")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.max(F.when(F.col("kind") == naming.EVENT, F.col("col_name"))).alias("event_col"), F.max(F.when(F.col("kind") == naming.TIME, F.col("col_name"))).alias("time_col"))
    good = (F.col("n") == 2) & (F.col("kinds") == F.array(F.lit(naming.EVENT), F.lit(naming.TIME)))
    if bad := [(r.surv_label, r.n, r.kinds) for r in out.where(~good).collect()]:
        raise EditError(f"a label needs one Event and one Time column: {bad}")
    return out.select("surv_label", "event_col", "time_col")


def mapped(c: Column, changes: dict[str, str | None]) -> Column:
    """Categories replaced (None: by null), in one lookup of a literal map; the map is as long as the edits."""
    if not changes:
        return c
    text = c.cast("string")
    renamed = {k: v for k, v in changes.items() if v is not None}
    gone = [k for k, v in changes.items() if v is None]
    out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv)), text), text) if renamed else text
    return F.when(~text.isin(gone), out) if gone else out


def category_maps(edits: DataFrame) -> dict[str, dict[str, str | None]]:
    """By column; a rename wins over a removal."""
    out: dict[str, dict[str, str | None]] = {}
    for r in edits.collect():  # as many rows as edited categories
        if r.rename_to is None and not r.remove:
            raise EditError(f"{r.col_name}: {r.category} is neither renamed nor removed")
        out.setdefault(r.col_name, {})[r.category] = r.rename_to
    return out


def curated(df: DataFrame, col_edits: DataFrame | None = None, cat_edits: DataFrame | None = None, surv_cat_edits: DataFrame | None = None) -> DataFrame:
    """Columns dropped, then renamed, then categories replaced, those of survival columns last. One projection: nothing shuffles."""
    spark = df.sparkSession
    edits = col_edits if col_edits is not None else spark.createDataFrame([], COL_EDITS)
    rows = edits.collect()
    drop, names = {r.col_name for r in rows if r.remove}, {r.col_name: r.change_col_name for r in rows if r.change_col_name and not r.remove}
    new = [names.get(c, c) for c in df.columns if c not in drop]
    if len(set(new)) < len(new):
        raise EditError(f"renaming makes names clash: {sorted({n for n in new if new.count(n) > 1})}")
    maps = [category_maps(e) for e in (cat_edits, surv_cat_edits) if e is not None]

    def value(old: str, new: str) -> Column:
        c = F.col(f"`{old}`")
        for m in maps:
            c = mapped(c, m.get(new, {}))
        return c.alias(new)

    return df.select(*(value(c, names.get(c, c)) for c in df.columns if c not in drop))
