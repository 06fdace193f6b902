"""SimHash near-duplicates, found exactly through vantage-point trees.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its 3-word shingles. Texts
link when their fingerprints differ in at most ``radius`` bits, and a component is what links reach.

Partitioning: a vantage-point tree over a bounded sample of fingerprints deals all distinct
fingerprints into shards. A node asks for the Hamming distance d to its vantage point: d <= mu is
inside. By the triangle inequality a partner of a fingerprint can only be inside if d <= mu + radius
and outside if d > mu - radius, so a fingerprint lives in one shard and visits those whose boundary
its ball crosses. Each shard repeats the division on its own and compares the small rest in full.
A shard returns a spanning forest (a row per linked fingerprint), never pairs; alternating star
contraction joins the forests of all shards.

Defined cases: a null, empty or word-less text has fingerprint 0 and links like any other; fewer
than three words make one shingle of all; copies and repeated rows share a fingerprint and thus a
component; rows with a null id get a component but never name one (a component of null ids only
has a null id). An empty table gives an empty result. Other columns are ignored, and
``deduplicated`` returns them as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, blocks, bounded_batches, fresh_path, joined, written
from larkspur.llm.hashstore import Store, by_shard, put

SEED, WIDTH, RADIUS = 42, 3, 2
#: Distinct fingerprints that a shard is home to, about; and the sample that the top tree is built of.
SHARD_SIZE, SAMPLE_SIZE = 32_768, 65_536
#: Pairs compared in full where the division ends.
LEAF_PAIRS = 1 << 20


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Of one text; the bits' votes are counted over slices, so a long text needs little memory."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, votes = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        own = words[at : min(at + (1 << 16), n) + width - 1]
        count = len(own) - width + 1
        shingles = map(b" ".join, zip(*(own[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
        votes += np.unpackbits(h.view(np.uint8).reshape(count, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, extra: str | None = None) -> DataFrame:
    """id, fp: the fingerprint as a signed long; and a long column of docs as it is."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t"):
            fp = np.array([fingerprint(t, width) for t in as_bytes(block, "t")], np.uint64).view(np.int64)
            more = [block.column(extra).combine_chunks()] if extra else []
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(fp), *more], ["id", "fp", extra][: 2 + len(more)])

    own = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *([F.col(extra)] if extra else [])]
    return docs.select(*own).mapInArrow(run, "id long, fp long" + (f", {extra} long" if extra else ""))


def distances(a: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(a ^ point).astype(np.int16)


def top_tree(sample: np.ndarray, depth: int, radius: int) -> list[tuple[int, int]]:
    """A complete binary tree in heap order: (vantage point, mu) of each inner node. A sample that runs out is split by an arbitrary point."""
    nodes, rng = [], np.random.default_rng(7)
    level = [sample]
    for _ in range(depth):
        below = []
        for own in level:
            if len(own) < 8:
                own = sample
            best = None
            for v in rng.choice(own, min(5, len(own)), replace=False):  # of a few points, the one whose boundary the fewest cross
                d = distances(own, v)
                mu = int(np.median(d))
                inside = (d <= mu).mean()
                crossing = (d <= mu + radius).mean() + (d > mu - radius).mean() + 2 * abs(inside - 0.5)
                if best is None or crossing < best[0]:
                    best = crossing, v, mu, d
            nodes.append((int(best[1]), best[2]))
            below += [own[best[3] <= best[2]], own[best[3] > best[2]]]
        level = below
    return nodes


def routed(fp: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in fp, shards, and whether the shard is home."""
    row, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    points = np.array([v for v, _ in nodes], np.uint64)
    mus = np.array([m for _, m in nodes], np.int16)
    for _ in range(depth):
        d, mu = distances(fp[row], points[node]), mus[node]
        inside, near_in, near_out = d <= mu, d <= mu + radius, d > mu - radius
        row = np.concatenate([row[near_in], row[near_out]])
        node = np.concatenate([2 * node[near_in] + 1, 2 * node[near_out] + 2])
        home = np.concatenate([(home & inside)[near_in], (home & ~inside)[near_out]])
    return row, node - (len(nodes)), home


class Forest:
    """Union-find over positions, for arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def linked(fp: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a shard, the position of its component's root; links with at least one end at home count."""
    forest, rng = Forest(len(fp)), np.random.default_rng(11)
    work = [(np.flatnonzero(home), np.arange(len(fp)))]
    while work:
        a, b = work.pop()
        if not len(a) or not len(b):
            continue
        split = len(a) * len(b) > LEAF_PAIRS
        if split:
            v = fp[a[rng.integers(len(a))]]
            da, db = distances(fp[a], v), distances(fp[b], v)
            if 2 * int(db.max()) <= radius:  # any two are near
                forest.link(a, np.full(len(a), b[0]))
                forest.link(b, np.full(len(b), b[0]))
                continue
            mu = int(np.median(da))
            mu -= int((da <= mu).all())
            parts = [(a[da <= mu], b[db <= mu + radius]), (a[da > mu], b[db > mu - radius])]
            if all(len(x) * len(y) < len(a) * len(b) for x, y in parts) and sum(len(x) * len(y) for x, y in parts) < 0.9 * len(a) * len(b):
                work += parts
                continue
        step = max(1, 4 * LEAF_PAIRS // len(b))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(fp[a[at : at + step], None] ^ fp[b][None, :]) <= radius)
            forest.link(a[at + i], b[j])
    return forest.roots(np.arange(len(fp)))


def contracted(edges: DataFrame) -> DataFrame:
    """node, root: the least node that links reach, by alternating large and small stars. edges: u, v. A node of very many links is joined by broadcast."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total, state = edges.count(), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        large = written(joined(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined(large, least, "u", total)
        edges = written(small.select("u", F.col("m").alias("v")).union(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        total, state = now[0], now


def rooted(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """fp, n, first, root for each distinct fingerprint of prints (id, fp): how many rows have it, the least of their (id, other columns) and a fingerprint that stands for its component."""
    others = [c for c in prints.columns if c not in ("id", "fp")]
    order = F.struct(F.col("id").isNull().alias("none"), "id", *others)
    nodes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("first")), "fingerprints")
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard_size)))))
    tree: list[tuple[int, int]] = []
    if depth:
        sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE_SIZE).select("fp").collect()], np.int64).view(np.uint64)
        tree = top_tree(sample, depth, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, shard, home = routed(fp.view(np.uint64), tree, depth, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fp[row]), pa.array(home)], ["shard", "fp", "home"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], table.column("home").to_numpy(zero_copy_only=False)[order]
        root = linked(fp.view(np.uint64), home, radius)
        own = root != np.arange(len(fp))
        return pa.table({"u": pa.array(fp[own]), "v": pa.array(fp[root[own]])})

    dealt = nodes.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    edges = dealt.groupBy("shard").applyInArrow(search, "u long, v long")
    roots = contracted(edges)
    return written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def components(prints: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """fp, component_id, n for each distinct fingerprint of prints (id, fp). The id is the least of the component, n the number of rows."""
    found = rooted(prints.select("id", "fp"), radius, shard_size)
    least = found.groupBy("root").agg(F.min("first.id").alias("component_id"), F.count("*").alias("fps"))
    return written(joined(found.select("fp", "n", "root"), least, "root", found.count(), "fps").select("fp", "component_id", "n"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id for each row."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    found = components(prints, radius)
    return joined(prints, found, "fp", prints.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: one with the least id, where ids repeat the first as the table is read. A row without an id stays if its component has no other.

    The rows are written with a number; the numbers of those to keep go to sorted arrays by the task that wrote them, so no text is shuffled."""
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    row, per = f"row_{tag}", 1 << 33  # monotonically_increasing_id puts the partition above 33 bits
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    prints = written(fingerprints(rows, id_col, text_col, extra=row), "prints")
    keep, uri = rooted(prints, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{row}").alias("row")), fresh_path(spark, "kept")

    def put_away(table: pa.Table) -> pa.Table:
        own = np.sort(table.column("row").to_numpy())
        put(uri, "row", int(own[0]) // per, own)
        return pa.table({"n": pa.array([len(own)], pa.int64())})

    keep.withColumn("part", F.shiftright("row", 33)).groupBy("part").applyInArrow(put_away, "n long").count()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(uri)
        for b in batches:
            number = b.column(b.schema.get_field_index(row)).to_numpy()
            mask = np.zeros(len(number), bool)
            for part, own in by_shard(number // per):
                mask[own] = np.isin(number[own], store.get("row", part, np.int64))
            yield b.filter(pa.array(mask)).select(docs_columns)

    docs_columns = list(range(len(docs.columns)))
    bounded_batches(spark)
    return rows.mapInArrow(kept, docs.schema)
