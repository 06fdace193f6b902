"""Shards of near-equal bytes by longest-processing-time scheduling.

Equal texts form a group that stays together. Groups, largest first, go to the least-loaded shard,
which a heap gives. Groups of one size are alike, so the schedule needs only how many groups each
size has: sizes below 2**16 bytes are exact classes, larger ones are classes by their leading 16
bits, which bounds the table that the driver schedules (2**16 rows, and 2**15 more for each doubling
beyond) however many documents there are. Ranks within a class, and slots within a shard, come from
counts per bucket, so no class or shard meets in one task.

Defined cases: a null text has no bytes and its group is that of null texts, apart from empty ones;
its CRC is that of no bytes, 0. Rows with equal ids, null ids or equal content each get a slot of
their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import joined, written

SHARDS, OVERHEAD = 24, 8
#: Rows of a bucket, about, within which ranks are counted.
BUCKET_ROWS = 16_384


def size_class(size: Column) -> Column:
    """The size, with all but its leading 16 bits 0."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - 16).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """classes: (class, groups, bytes of them all). Runs (class, first rank, rank after the last, shard), in the order in which a heap deals them out."""
    heap, runs = [(0, s) for s in range(shards)], []
    for cls, groups, total in sorted(classes, reverse=True):
        mean, given = total / groups, [0] * shards
        left = groups
        if groups > 4 * shards:  # fill up to a common level first, leaving a few rounds to the heap
            level = (sum(x for x, _ in heap) + (groups - 2 * shards) * mean) / shards
            fill = {s: max(0, int((level - x) // mean)) for x, s in heap}
            while sum(fill.values()) > left:
                fill = {s: max(0, n - 1) for s, n in fill.items()}
            heap = [(x + fill[s] * mean, s) for x, s in heap]
            heapq.heapify(heap)
            given, left = [fill[s] for s in range(shards)], left - sum(fill.values())
        for _ in range(left):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + mean, s))
            given[s] += 1
        at = 0
        for s, n in enumerate(given):
            if n:
                runs.append((cls, at, at + n, s))
                at += n
    return runs


def ranked(df: DataFrame, key: str, order: list[Column], name: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """df with its bucket and its rank there, and a table of key, bucket and how many rows of the key come before.

    A rank within a key is the sum of the two; no window holds a whole key, and neither table comes to the driver."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inner = df.withColumn(name, F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)).cast("long") - 1)
    before = F.sum("here").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = df.groupBy(key, "bucket").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(before, F.lit(0))).drop("here")
    return inner, offsets


def bounds(runs: list[tuple[int, int, int, int]], spark: SparkSession) -> DataFrame:
    """cls, after, shards: the ends of each class's runs, and their shards."""
    by: dict[int, tuple[list, list]] = {}
    for cls, _, after, shard in runs:
        ends, own = by.setdefault(cls, ([], []))
        ends.append(after)
        own.append(shard)
    table = pa.table({"cls": pa.array(list(by), pa.int64()), "after": pa.array([a for a, _ in by.values()], pa.list_(pa.int64())), "shards": pa.array([s for _, s in by.values()], pa.list_(pa.int32()))})
    return spark.createDataFrame(table)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard and slot for each row."""
    text = F.col(text_col).cast("string")
    binary = F.coalesce(text.cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(binary) + OVERHEAD).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("grp"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "sizes")  # uid is fixed from here on
    groups = rows.groupBy("grp").agg(F.sum("size").alias("total"), F.count("*").alias("n")).withColumn("cls", size_class(F.col("total")))
    groups = written(groups, "groups")
    classes = [(r.cls, r.g, r.b, r.n) for r in groups.groupBy("cls").agg(F.count("*").alias("g"), F.sum("total").alias("b"), F.sum("n").alias("n")).collect()]
    n_groups, n_rows = sum(c[1] for c in classes), sum(c[3] for c in classes)
    table = bounds(schedule([c[:3] for c in classes], shards), docs.sparkSession)
    own, offsets = ranked(groups, "cls", [F.col("grp")], "rank", 1 + n_groups // BUCKET_ROWS)
    rank = F.col("rank") + F.col("before")
    placed = own.join(offsets.join(table, "cls"), ["cls", "bucket"]).select("grp", "n", F.get("shards", F.size(F.filter("after", lambda x: x <= rank))).alias("shard"))
    placed = written(placed, "placed")
    dealt = written(joined(rows, placed, "grp", n_rows).select("id", "size", "text_crc32", "shard", "uid"), "dealt")
    own, offsets = ranked(dealt, "shard", [F.col("uid")], "slot", 1 + n_rows // (BUCKET_ROWS * shards))
    return own.join(offsets, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).alias("slot"))
