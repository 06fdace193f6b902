"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index is inverted: for each term, the items that hold it with their BM25 impact, in blocks with
the largest impact of each block. Impacts are divided by the item's score against itself, so one
threshold means the same share of any item's weight. Passages are overlapping windows of a text,
wide enough that an item lies whole in one of them.

Retrieval returns every item at or above the threshold, by block-max WAND. Upper bounds come first,
for many passages at a time: for each block of items, the sum of its largest impacts of the passage's
terms (terms of very many blocks count with their largest impact of all). Where no block can reach
the threshold, the passage is left. Otherwise term cursors advance to the pivot, the first item
that could reach it, and skip blocks whose largest impacts cannot. A retrieved item counts when the
text around the passage holds enough of the 5-word shingles of its question (all but the last
sentence) and of its answer (the last sentence; an item of one sentence is both).

The index goes to the tasks through the shared folder, in slices of at most ``INDEX_BYTES`` of item
text; a larger benchmark takes one pass over the documents for each slice. The number of items, their
mean length and the terms' document frequencies are those of the whole benchmark, however it is sliced.

Defined cases: null or empty texts and items, and those without a letter or digit, match nothing; an
item shorter than a shingle is one shingle; items with equal texts are found together; rows with
equal or null ids are each judged, and the result has a row for each distinct id and item. Other
columns are ignored, and ``decontaminated`` returns them as they were.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Ids, as_bytes, blocks, bounded_batches, fresh_path, numbered, tidy
from larkspur.llm.hashstore import Store, put

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER, SHINGLE = 0.7, 0.8, 0.5, 5
WINDOW, BLOCK = 128, 4
#: Blocks beyond which a term counts as common, and bounds held at once.
COMMON, CELLS = 24, 1 << 20
INDEX_BYTES, MEMO = 16 << 20, 400_000
#: Text that a worker searches at once.
TEXT_BYTES = 4 << 20
NOT_WORD, SENTENCE = re.compile(r"[\W_]+"), re.compile(r"(?<=[.!?])\s+|\n+")


def term(word: str) -> str:
    """Lower-case letters and digits of a word."""
    return NOT_WORD.sub("", word.lower())


def spellings(text: str) -> list[str]:
    """Words of an item or a document: runs of characters other than white space, Unicode's too."""
    return text.split()


def terms(text: str) -> list[str]:
    return [t for w in spellings(text) if (t := term(w))]


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if n else set()


def ramp(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


@dataclass
class Index:
    """Of items (id, text); items without a term are left out."""

    items: list[int] = field(default_factory=list)
    questions: list[set] = field(default_factory=list)
    answers: list[set] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[list[int]] = field(default_factory=list)  # positions of items, ascending
    impacts: list[list[float]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(1))
    common: np.ndarray = field(default_factory=lambda: np.zeros(1))  # largest impact of common terms, 0 for others
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))  # of the other terms' blocks
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    longest: int = 0


@dataclass
class Corpus:
    """What BM25 asks of all items together. Items without a term do not count."""

    items: int = 0
    words: int = 0
    df: Counter = field(default_factory=Counter)  # of a term's text

    def add(self, text: str | None) -> None:
        own = terms(text or "")
        if own:
            self.items, self.words = self.items + 1, self.words + len(own)
            self.df.update(set(own))


def build(rows: list[tuple[int, str]], corpus: Corpus | None = None) -> Index:
    """The index of rows, items of the corpus (all there is, unless given)."""
    if corpus is None:
        corpus = Corpus()
        for _, text in rows:
            corpus.add(text)
    index, ids, counts, sizes = Index(), Ids(), [], []
    for item, text in rows:
        sentences = [t for s in SENTENCE.split(text or "") if (t := [ids[w] for w in terms(s)])]
        if not sentences:
            continue
        every = [i for s in sentences for i in s]
        index.items.append(item)
        index.questions.append(shingles([i for s in sentences[:-1] for i in s] or every))
        index.answers.append(shingles(sentences[-1]))
        counts.append(Counter(every))
        sizes.append(len(every))
    n, mean = corpus.items, corpus.words / max(1, corpus.items)
    df = [corpus.df[w] for w in ids]
    found: dict[int, list[tuple[int, float]]] = {}
    for d, (c, size) in enumerate(zip(counts, sizes, strict=True)):
        weight = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
        own = sum(weight.values())
        for t, w in weight.items():
            found.setdefault(t, []).append((d, w / own))
    index.terms, index.longest = dict(ids), max(sizes, default=0)
    for t in range(len(ids)):
        index.postings.append([d for d, _ in found[t]])
        index.impacts.append([w for _, w in found[t]])
        index.block_max.append([max(index.impacts[t][a : a + BLOCK]) for a in range(0, len(found[t]), BLOCK)])
    by_block = [{} for _ in range(len(ids) + 1)]
    for t, own in found.items():
        for d, w in own:
            by_block[t][d // BLOCK] = max(w, by_block[t].get(d // BLOCK, 0.0))
    index.common = np.array([max(x.values()) if len(x) > COMMON else 0.0 for x in by_block])
    rest = [x if len(x) <= COMMON else {} for x in by_block]
    index.offsets = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int64)
    index.blocks = np.array([b for x in rest for b in x], np.int64)
    index.bounds = np.array([w for x in rest for w in x.values()])
    index.most = np.array([*(max(i) for i in index.impacts), 0.0])  # the last is for words that no item has
    return index


def retrieve(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose impacts for the distinct terms of query add up to the threshold: (position, score)."""
    lists = [[index.postings[t], index.impacts[t], index.block_max[t], 0, most] for t, most in zip(query, index.most[query].tolist(), strict=True)]
    found, limit = [], threshold - 1e-9
    while lists:
        lists.sort(key=lambda c: c[0][c[3]])
        bound, pivot = 0.0, None
        for k, c in enumerate(lists):
            bound += c[4]
            if bound >= limit:
                pivot = k
                break
        if pivot is None:
            break
        item = lists[pivot][0][lists[pivot][3]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][3]] == item:
            pivot += 1
        block_bound, skip_to = 0.0, None
        for c in lists[: pivot + 1]:  # the blocks that would hold the pivot item
            at = bisect_left(c[0], item, c[3])
            if at < len(c[0]):
                block_bound += c[2][at // BLOCK]
                end = c[0][min(len(c[0]), (at // BLOCK + 1) * BLOCK) - 1] + 1
                skip_to = end if skip_to is None else min(skip_to, end)
        if block_bound < limit:
            if pivot + 1 < len(lists):
                skip_to = min(skip_to, lists[pivot + 1][0][lists[pivot + 1][3]])
            target = max(skip_to, item + 1)
            for c in lists[: pivot + 1]:
                c[3] = bisect_left(c[0], target, c[3])
        elif lists[0][0][lists[0][3]] == item:
            score = sum(c[1][c[3]] for c in lists[: pivot + 1])
            if score >= limit:
                found.append((item, score))
            for c in lists[: pivot + 1]:
                c[3] += 1
        else:
            for c in lists[: pivot + 1]:
                c[3] = bisect_left(c[0], item, c[3])
        lists = [c for c in lists if c[3] < len(c[0])]
    return found


class Matcher:
    """Finds the items in texts; remembers the term of each spelling."""

    def __init__(self, index: Index, threshold: float, question: float, answer: float):
        self.index, self.threshold, self.question, self.answer = index, threshold, question, answer
        self.window = max(WINDOW, 2 * index.longest)
        self.step = max(1, self.window - index.longest)
        self.forget()

    def forget(self) -> None:
        self.words, self.term_of = Ids(), []

    def bound(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each passage ids[first:last] (both ascending), no less than its best item's score."""
        index, out = self.index, np.zeros(len(first))
        width, words = -(-len(index.items) // BLOCK), len(index.terms) + 1
        n, step = np.diff(index.offsets), max(1, CELLS // -(-len(index.items) // BLOCK))
        for at in range(0, len(first), step):
            a, b = first[at : at + step], last[at : at + step]
            pos = np.arange(a[0], b[-1])
            pos = pos[ids[pos] < words - 1]
            low = np.searchsorted(b, pos, "right")  # the first passage that holds a position, and how many do
            times = np.searchsorted(a, pos, "right") - low
            pair = np.unique((np.repeat(low, times) + ramp(times)) * words + np.repeat(ids[pos], times))
            passage, t = pair // words, pair % words
            entry = np.repeat(index.offsets[t], n[t]) + ramp(n[t])
            cell = np.repeat(passage, n[t]) * width + index.blocks[entry]
            best = np.bincount(cell, weights=index.bounds[entry], minlength=len(a) * width).reshape(len(a), width).max(axis=1)
            out[at : at + step] = best + np.bincount(passage, weights=index.common[t], minlength=len(a))
        return out

    def __call__(self, texts: list[bytes]) -> list[dict[int, tuple[int, float, float, float]]]:
        """For each text: item position to passage, score, question and answer overlap."""
        if len(self.words) > MEMO:
            self.forget()
        out: list[dict] = [{} for _ in texts]
        if not self.index.items:
            return out
        ids, starts, _ = numbered((spellings(t.decode("utf-8", "replace")) for t in texts), self.words)
        unknown = len(self.index.terms)
        for word in list(self.words)[len(self.term_of) :]:
            own = term(word)
            self.term_of.append(self.index.terms.get(own, unknown) if own else -1)
        ids = np.array(self.term_of, np.int64)[ids] if len(ids) else ids
        real = ids >= 0
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        ids = ids[real]
        n = np.diff(starts)
        windows = np.where(n > 0, np.maximum(0, -(-(n - self.window) // self.step)) + 1, 0)
        text = np.repeat(np.arange(len(texts)), windows)
        number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = starts[:-1][text] + number * self.step
        last = np.minimum(first + self.window, starts[1:][text])
        for w in np.flatnonzero(self.bound(ids, first, last) >= self.threshold - 1e-6):
            query = np.unique(ids[first[w] : last[w]])
            query = query[query < unknown]
            for item, score in retrieve(self.index, query.tolist(), self.threshold):
                t = int(text[w])
                near = ids[max(starts[t], first[w] - self.index.longest) : min(starts[t + 1], last[w] + self.index.longest)].tolist()
                here: dict[int, set] = {}

                def share(wanted: set) -> float:
                    size = len(next(iter(wanted)))
                    if size not in here:
                        here[size] = {tuple(near[i : i + size]) for i in range(len(near) - size + 1)}
                    return len(wanted & here[size]) / len(wanted)

                q, a = share(self.index.questions[item]), share(self.index.answers[item])
                if q >= self.question and a >= self.answer and (item not in out[t] or score > out[t][item][1]):
                    out[t][item] = int(number[w]), score, q, a
        return out


def rows_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[int, str]]:
    yield from benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).orderBy(F.col(item_col), F.col(text_col)).toLocalIterator()


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = INDEX_BYTES) -> Iterator[Index]:
    """Of slices of the benchmark, each of bounded size, one at a time. The benchmark is a fixed set of tests; its vocabulary and one slice are on the driver."""
    corpus = Corpus()
    for _, text in rows_of(benchmark, item_col, text_col):
        corpus.add(text)
    own, size = [], 0
    for r in rows_of(benchmark, item_col, text_col):
        if own and size + len(r[1] or "") > most:
            yield build(own, corpus)
            own, size = [], 0
        own.append((r[0], r[1]))
        size += len(r[1] or "")
    yield build(own, corpus)


def stored(benchmark: DataFrame, most: int = INDEX_BYTES) -> list[str]:
    """Where in the shared folder the slices' indexes are."""
    out = []
    for index in indexes(benchmark, most=most):
        out.append(fresh_path(benchmark.sparkSession, "bm25"))
        put(out[-1], "index", 0, np.frombuffer(pickle.dumps(index), np.uint8))
    return out


def loaded(uri: str) -> Index:
    return pickle.loads(Store(uri).get("index", 0, np.uint8).tobytes())


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, id_col: str = "doc_id", text_col: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """id_col, item_id, passage, bm25 (share of the item's own score), question_overlap, answer_overlap, for each document and item that it holds."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = "id long, item_id long, passage long, bm25 double, question_overlap double, answer_overlap double"

    def search(uri: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(loaded(uri), threshold, question, answer)
            for block in blocks(batches, "t", TEXT_BYTES):
                found = match(as_bytes(block, "t"))
                hits = [(i, match.index.items[k], *v) for i, by in zip(block.column("id").to_pylist(), found, strict=True) for k, v in sorted(by.items())]
                columns = [list(c) for c in zip(*hits, strict=True)] or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], ["id", "item_id", "passage", "bm25", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, schema)

    out = None
    for uri in stored(benchmark, most):
        out = search(uri) if out is None else out.union(search(uri))
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("bm25", "question_overlap", "answer_overlap", (-F.col("passage")).alias("p"))).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", (-F.col("m.p")).alias("passage"), "m.bm25", "m.question_overlap", "m.answer_overlap")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, text_col: str = "text", most: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs that hold no item, as they are."""
    for uri in stored(benchmark, most):

        def keep(batches: Iterator[pa.RecordBatch], uri: str = uri) -> Iterator[pa.RecordBatch]:
            match = Matcher(loaded(uri), threshold, question, answer)
            for block in blocks(batches, text_col, TEXT_BYTES):
                clean = pa.array([not by for by in match(as_bytes(block, text_col))], pa.bool_())
                yield from block.filter(clean).to_batches()

        bounded_batches(docs.sparkSession)
        docs = docs.mapInArrow(tidy(keep), docs.schema)
    return docs
