"""Things several operators share: the shared folder, written tables and bounded blocks of documents.

Words are runs of bytes other than the six ASCII white-space characters, which is what
``bytes.split()`` gives; lower-casing is ``bytes.lower()``, which touches A-Z alone.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that a Python worker holds at once, unless one text alone is longer.
BLOCK_BYTES = 8 << 20
#: Items of parts that are numbered at once, unless one part alone has more.
ITEMS_AT_ONCE = 1 << 16
#: Characters of a plan's text.
PLAN_TEXT = 100_000
#: Share of all rows from which a key counts as hot; so at most as many keys as its inverse are.
HOT_SHARE, HOT_ROWS = 1 / 1000, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A session on this machine alone may do without and gets one of its own; a cluster may not."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that later plans neither repeat its work nor depend on executors that made it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Sets, for the rest of the session, Arrow batches so small that long texts cannot fill a worker, and a bound on the
    text of plans that the driver keeps for each query (models stand in them as literals).

    They stay set because the operators' results are planned after the operators return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches joined up to about ``most`` bytes of text."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index(text)).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def give_back() -> None:
    """Gives what is free but kept by Arrow and the C library back to the system, if the library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory back before and after. A worker outlives its task, and else keeps about the most that any of its tasks has needed."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def as_bytes(table: pa.Table, text: str) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [t or b"" for t in table.column(text).cast(pa.binary()).to_pylist()]


class Ids(defaultdict):
    """Numbers what it has not seen from 0 on. It does not refer to itself, so it goes as soon as it is let go and not when all objects are next searched for cycles."""

    def __init__(self):
        super().__init__(count().__next__)


def numbered(parts: Iterable[list], ids: Ids | None = None) -> tuple[np.ndarray, np.ndarray, Ids]:
    """All parts' items as one array of numbers, where each part starts (and the end), and the numbering. Few parts are held at once."""
    ids = Ids() if ids is None else ids
    own, sizes, held, n = [np.empty(0, np.int64)], [0], [], 0
    for p in parts:
        held.append(p)
        sizes.append(len(p))
        n += len(p)
        if n >= ITEMS_AT_ONCE:
            own.append(np.fromiter(map(ids.__getitem__, chain.from_iterable(held)), np.int64, n))
            held, n = [], 0
    own.append(np.fromiter(map(ids.__getitem__, chain.from_iterable(held)), np.int64, n))
    return np.concatenate(own), np.cumsum(sizes, dtype=np.int64), ids


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values from each start to the next."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def sampled(keys: DataFrame, texts: DataFrame, n: int, most: int | None = None) -> dict:
    """Of keys (y, h), for each y the n least distinct h, or as many as keep all classes together within ``most``; and of texts (h, t) the text of each: lists of UTF-8 by y.

    The least hashes are chosen without the texts; being of bounded number, they then pick them. As hashes are even, those
    below a cut from the size of their class hold the n least, so ranking sees a few n of each class, however many there are;
    were they not even, and a class short, all are ranked."""
    keys = written(keys.where("y is not null and h is not null").distinct(), "sample")
    sizes = keys.groupBy("y").agg(F.count("*").alias("size"))
    size = {r.y: r["size"] for r in sizes.collect()}  # a row for each class, of which the sample holds a text or more
    if most:
        n = max(1, min(n, most // max(1, len(size))))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))

    def least(among: DataFrame) -> DataFrame:
        return written(among.select("y", "h", place.alias("k")).where(F.col("k") <= n), "sample")

    share = F.least(F.lit(1.0), F.lit(4.0 * n + 100) / F.col("size"))
    chosen = least(keys.join(F.broadcast(sizes), "y").where(F.col("h").cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * share))
    if chosen.count() < sum(min(n, s) for s in size.values()):
        chosen = least(keys)
    text = {r.h: r.t.encode() for r in texts.where("t is not null").join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t")).toLocalIterator()}
    out: dict = {}
    for r in chosen.orderBy("y", "h").collect():
        out.setdefault(r.y, []).append(text[r.h])
    return out


def joined(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows with the columns of table, which has a row for each key and in ``count`` how many rows have it.

    Keys of more than ``HOT_SHARE`` of the ``total`` rows, which are fewer than its inverse, reach the rows by broadcast; the others by a shuffle in which none is large."""
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot, rest = table.where(F.col(count) > limit).drop(count), table.where(F.col(count) <= limit).drop(count)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
