"""Joins and set operations between cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.describe import duplicates


class DuplicateKeyError(ValueError):
    """A side of a one-to-one join repeats a key."""


def side_by_side(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join, one to one."""
    for df in (left, right):
        if rows := duplicates(df, on).limit(5).collect():
            raise DuplicateKeyError(f"keys occur more than once: {[tuple(r)[:-1] for r in rows]}")
    return left.join(right, on, "full_outer")


def aligned(frames: dict[str, DataFrame], on: str, value: str) -> DataFrame:
    """One column per frame; keys that a frame lacks are null there. A union and a pivot, so one shuffle however many frames."""
    rows = reduce(DataFrame.unionByName, (f.select(on, F.col(value).alias("v"), F.lit(n).alias("frame")) for n, f in frames.items()))
    return rows.groupBy(on).pivot("frame", list(frames)).agg(F.first("v", ignorenulls=True))


def without(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on).where(F.col(on).isNotNull()), on, "left_anti")


def within(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other.select(on), on, "left_semi")


def common_keys(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).intersect(b.select(on))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal columns, types and rows, repeats included, in whatever order; NaN is null."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))

    if a.dtypes != b.dtypes:
        return False
    a, b = plain(a), plain(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def flattened(df: DataFrame) -> DataFrame:
    """Structs as columns with dotted names, at any depth."""
    from pyspark.sql import types as T

    def leaves(fields, path: list[str]):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(".".join((*path, f.name)))

    return df.select(*leaves(df.schema.fields, []))
