"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by the workers that score.

Tokens are a text's lower-cased words and one end. Three passes over the shuffle build the model:
distinct words with counts, sharded by hash; distinct word pairs with counts, sharded by a hash of
both words, so that the followers of a frequent word are spread over all shards; and how many contexts
and followers words have, sharded by word. Tasks exchange sorted, compressed arrays rather than
a row per n-gram, after adding up what their own texts repeat, so a frequent word or pair weighs no
more than any other in the shuffle. The reducing tasks write sorted arrays to a store in the shared
folder: word hashes (a word's id is its rank), counts, context weights, and pair keys (context id
and word id) with counts. Scoring maps these, and looks pairs up by binary search.

P(w|v) = (c(v,w) - D(c)) / c(v) + g(v) P(w), and P(w) = (a(w) - D'(a)) / A + g' / (V + 1), where
a(w) counts the distinct contexts of w and the discounts follow Chen and Goodman.

Order 2 is fixed: trigrams of a corpus of such sparse words are nearly all singular, and their
arrays would be twice the size of the text.

Defined cases: a null or empty text is an end alone; a word or a context that training lacks takes
the back-off weight; without training texts each score is that of the uniform distribution over the
one unknown token, 0. Rows repeat in the result as in the input; other columns are ignored. Words
are told apart by 64-bit hashes. More than 2**32 - 2 distinct words are an error, as pairs of ids fill 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, blocks, bounded_batches, fresh_path, numbered, written
from larkspur.llm.hashstore import Store, by_shard, packed, put, summed, unpacked

#: What stands for a text's end; no word contains white space.
END = b"\n"
#: Text bytes for each shard of the model, about.
SHARD_BYTES = 4 << 20
#: Text that a task counts before it passes its sums on.
COUNT_BYTES = 24 << 20


@dataclass
class Model:
    uri: str
    bounds: np.ndarray  # first word id of each shard; the last item is V
    tokens: int
    discounts: tuple = (0.0, 0.0, 0.0, 0.0)
    low_discounts: tuple = (0.0, 0.0, 0.0, 0.0)
    low_total: int = 0
    low_weight: float = 1.0
    docs: int = 0
    store: Store | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"store": None}

    @property
    def words(self) -> int:
        return int(self.bounds[-1])

    @property
    def shards(self) -> int:
        return len(self.bounds) - 1

    def opened(self) -> Store:
        self.store = self.store or Store(self.uri)
        return self.store

    def shard_of(self, ids: np.ndarray) -> np.ndarray:
        """The start of a text is context V and lives in the last shard."""
        return np.minimum(np.searchsorted(self.bounds, ids, "right") - 1, self.shards - 1)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for an unknown word."""
        out = np.full(len(hashes), -1, np.int64)
        for shard, own in by_shard(hash_shard(hashes, self.shards)):
            known = self.opened().get("hash", shard, np.uint64)
            at = np.searchsorted(known, hashes[own])
            hit = at < len(known)
            hit[hit] = known[at[hit]] == hashes[own][hit]
            out[own[hit]] = self.bounds[shard] + at[hit]
        return out

    def values(self, kind: str, dtype, ids: np.ndarray) -> np.ndarray:
        """A per-word array at ids; 0 for -1."""
        out = np.zeros(len(ids), dtype)
        known = np.flatnonzero(ids >= 0)
        for shard, own in by_shard(self.shard_of(ids[known])):
            own = known[own]
            values = self.opened().get(kind, shard, dtype)
            if len(values):
                out[own] = values[ids[own] - self.bounds[shard]]
        return out

    def pair_counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context), np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        key = pair_key(context[known], word[known])
        for shard, own in by_shard(pair_shard(key, self.shards)):
            keys = self.opened().get("pair", shard, np.uint64)
            pos = np.searchsorted(keys, key[own])
            hit = pos < len(keys)
            hit[hit] = keys[pos[hit]] == key[own][hit]
            out[known[own[hit]]] = self.opened().get("paircount", shard, np.int64)[pos[hit]]
        return out

    def low(self, ids: np.ndarray) -> np.ndarray:
        """P(w), from continuation counts."""
        a = self.values("cont", np.int64, ids)
        seen = (a - np.array(self.low_discounts)[np.minimum(a, 3)]) / max(1, self.low_total)
        return np.where(a > 0, seen, 0.0) + self.low_weight / (self.words + 1)

    def log_probs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word|context), for ids."""
        low = self.low(word)
        total = np.where(context == self.words, self.docs, self.values("count", np.int64, np.where(context == self.words, -1, context)))
        weight = self.values("weight", np.float64, context)
        c = self.pair_counts(context, word)
        seen = np.where(c > 0, c - np.array(self.discounts)[np.minimum(c, 3)], 0.0) / np.maximum(total, 1)
        return np.log10(np.where(total > 0, seen + weight * low, low))


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return hash_shard(keys * np.uint64(0x9E3779B97F4A7C15), shards)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' tokens, where texts start, and each number's hash."""
    ids, starts, seen = numbered([*t.lower().split(), END] for t in texts)
    return ids, starts, np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))


def contexts(ids: np.ndarray, starts: np.ndarray, start_id: int) -> np.ndarray:
    """The token before each token; start_id at a text's start."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[starts[:-1]] = start_id
    return out


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Chen and Goodman's, of how many items occur 1, 2, 3 and 4 times; plain values where a count is lacking."""
    out, (n1, n2, n3, n4) = [0.0], n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and n1 else 0.5 * k
        out.append(min(max(d, 0.1 * k), float(k)))
    return tuple(out)


def tally(low: np.ndarray, n: tuple) -> list[int]:
    return [int((low == k).sum()) for k in n]


PARTS = "shard int, kind int, keys binary, counts binary"


def part(shard: int, keys: np.ndarray, counts: np.ndarray, kind: int = 0) -> dict:
    return {"shard": shard, "kind": kind, "keys": packed(keys), "counts": packed(counts)}


def emitted(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def merged(table: pa.Table, key_type, count_type) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, key_type), *(unpacked(x, key_type) for x in table.column("keys").to_pylist())])
    counts = np.concatenate([np.empty(0, count_type), *(unpacked(x, count_type) for x in table.column("counts").to_pylist())])
    return table.column("shard")[0].as_py() if table.num_rows else -1, *summed(keys, counts)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of all rows of docs. A row per shard comes to the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    docs_n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    shards, uri = int(max(size // SHARD_BYTES, 4)), fresh_path(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t", COUNT_BYTES):
            ids, _, hashes = tokens(as_bytes(block, "t"))
            keys, counts = summed(hashes, np.bincount(ids, minlength=len(hashes)))
            yield emitted([part(s, keys[own], counts[own].astype(np.uint32)) for s, own in by_shard(hash_shard(keys, shards))])

    def keep_words(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table, np.uint64, np.uint32)
        put(uri, "hash", shard, keys)
        put(uri, "count", shard, counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    found = {r.shard: (r.n, r.total) for r in texts.mapInArrow(count_words, PARTS).groupBy("shard").applyInArrow(keep_words, "shard int, n long, total long").collect()}
    bounds = np.concatenate([[0], np.cumsum([found.get(s, (0, 0))[0] for s in range(shards)])]).astype(np.int64)
    model = Model(uri, bounds, sum(t for _, t in found.values()), docs=docs_n)
    if model.words >= 2**32 - 1:
        raise ValueError("too many distinct words for pairs of 32-bit ids")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t", COUNT_BYTES):
            ids, starts, hashes = tokens(as_bytes(block, "t"))
            ids = model.ids_of(hashes)[ids]
            keys = np.sort(pair_key(contexts(ids, starts, model.words), ids))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)
            yield emitted([part(s, keys[own], counts[own]) for s, own in by_shard(pair_shard(keys, shards))])

    pairs = texts.mapInArrow(count_pairs, PARTS)

    def count_of_pairs(table: pa.Table) -> pa.Table:
        """Writes a shard of pairs; returns how many occur 1 to 4 times and, by shard of the word, how many contexts (kind 0) and how many followers that occur once, twice or more often (kinds 1 to 3) words have here."""
        shard, keys, counts = merged(table, np.uint64, np.uint32)
        put(uri, "pair", shard, keys)
        put(uri, "paircount", shard, counts)
        context, follower = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)
        rows = [part(-1, np.arange(1, 5), np.array(tally(counts, (1, 2, 3, 4)), np.int64))]
        for kind, own in enumerate((follower, context[counts == 1], context[counts == 2], context[counts > 2])):
            word, n = np.unique(own, return_counts=True)
            rows += [part(s, word[at], n[at].astype(np.uint32), kind) for s, at in by_shard(model.shard_of(word))]
        return pa.Table.from_batches([emitted(rows)])

    partial = written(pairs.groupBy("shard").applyInArrow(count_of_pairs, PARTS), "lm-neighbours")
    times = [0] * 4
    for r in partial.where("shard = -1").collect():  # a row per shard
        times = [a + int(b) for a, b in zip(times, unpacked(bytes(r.counts), np.int64), strict=True)]
    model.discounts = discounts(times)

    def keep_neighbours(table: pa.Table) -> pa.Table:
        shard, kinds = table.column("shard")[0].as_py(), table.column("kind").to_numpy()
        width = int(model.bounds[shard + 1] - model.bounds[shard])
        for kind in range(4):
            _, word, n = merged(table.filter(pa.array(kinds == kind)), np.int64, np.uint32)
            values = np.zeros(width + (kind > 0 and shard == model.shards - 1), np.int64)
            values[word - model.bounds[shard]] = n
            put(uri, f"followers{kind}" if kind else "cont", shard, values)
            if not kind:
                out = [*tally(n, (1, 2, 3, 4)), int((n > 2).sum()), int(n.sum())]
        return pa.table({"n": pa.array([out], pa.list_(pa.int64()))})

    low = np.zeros(6, np.int64)
    for r in partial.where("shard >= 0").groupBy("shard").applyInArrow(keep_neighbours, "n array<long>").collect():
        low += np.array(r.n)
    model.low_discounts, model.low_total = discounts(list(low[:4])), int(low[5])
    if model.low_total:
        model.low_weight = float(np.dot(model.low_discounts[1:], [low[0], low[1], low[4]]) / model.low_total)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                store, last = model.opened(), shard == model.shards - 1
                total = store.get("count", shard, np.int64)
                total = np.append(total, model.docs) if last else total
                weight = np.zeros(len(total))
                for k in (1, 2, 3):
                    followers = store.get(f"followers{k}", shard, np.int64)
                    weight += model.discounts[k] * followers if len(followers) else 0.0
                put(uri, "weight", shard, weight / np.maximum(total, 1))
            yield b

    if docs_n:
        spark.range(0, shards, 1, min(shards, 64)).mapInArrow(weigh, "id long").count()
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t"):
            ids, starts, hashes = tokens(as_bytes(block, "t"))
            n = np.diff(starts)
            if model.docs:
                word = model.ids_of(hashes)
                c = model.values("count", np.int64, word)
                base = np.log10((c + 1) / (model.tokens + model.words + 1))
                word = word[ids]
                context = contexts(word, starts, model.words)
                key, back = np.unique(pair_key(context + 1, word + 1), return_inverse=True)
                logs = model.log_probs((key >> np.uint64(32)).astype(np.int64) - 1, (key & np.uint64(2**32 - 1)).astype(np.int64) - 1)[back]
                known, base_score, score = (np.add.reduceat(x, starts[:-1]) for x in ((c > 0).astype(np.int64)[ids], base[ids], logs))
            else:
                known, base_score, score = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base_score), pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300))], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_col)


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of those for which training is true."""
    return scored(docs, train(docs.where(training), text_col), id_col, text_col)
