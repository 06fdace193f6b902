"""Toxicity by multiple-instance learning.

Only documents are labelled, yet it is sentences that offend. A sentence's probability is logistic
in its words, p = s(b + sum of w); a document's is the noisy-or of its sentences, 1 - prod(1 - p).
Maximising the labels' likelihood through the noisy-or tells which sentences, and so which words,
explain the toxic documents; the trained sentence scores then locate them.

A word's features are itself and its beginnings of ``STEMS`` characters (inflected forms share
those); a feature counts once in a sentence.

Training uses a bounded, reproducible sample: the ``sample`` labelled texts of each class with the
least hashes, whole, equal texts once. A feature enters the model when it
occurs in at least ``least_docs`` of the sampled texts and in more of the toxic ones than chance
explains, by ``least_z`` standard deviations; all others weigh nothing, and no weight is negative.

Defined cases: a null, empty or word-less text has no sentence and scores 0; without training texts
of both classes all score 0; a null label is no label and of several labels of a document the
largest counts. Rows repeat in the result as in the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Ids, as_bytes, blocks, bounded_batches, numbered, sampled

SAMPLE, LEAST_DOCS, LEAST_Z = 1000, 5, 4.5
STEPS, RATE, L2 = 400, 0.5, 1e-5
STEMS = (4, 5, 6)
THRESHOLD = 0.7
STOPS, TRIM = b".!?", b".,;:!?\"'()[]{}<>#*$%&|-_/\\"
BREAK = b" \x00. "
MEMO = 1_000_000


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float


def words_of(text: bytes) -> list[bytes]:
    """Words of a text; a line end is a word that ends a sentence."""
    return text.replace(b"\n", BREAK).lower().split()


def features(word: bytes) -> list[bytes]:
    """The plain word and its beginnings, which end in a star."""
    own = word.strip(TRIM)
    text = own.decode("utf-8", "replace")
    return [own, *(text[:n].encode() + b"*" for n in STEMS if len(text) >= n)] if own else []


def ends(word: bytes) -> bool:
    return word.rstrip(b"#*$%&|<>\"')]").endswith((b".", b"!", b"?"))


def sentence_starts(stops: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence (texts without words have none), and the text of each."""
    n = len(stops)
    first = np.zeros(n + 1, bool)
    first[1:] = stops
    first[starts[:-1]] = True
    at = np.flatnonzero(first[:n])
    return at, np.searchsorted(starts, at, "right") - 1


def expanded(ids: np.ndarray, own: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the word and the feature, for each feature of each word; those of word i are own[offsets[i]:offsets[i + 1]]."""
    n = np.diff(offsets)[ids]
    at = np.repeat(np.arange(len(ids)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, own[offsets[:-1][ids][at] + within]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def fit(texts: list[bytes], toxic: np.ndarray, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> Model:
    if not len(texts) or toxic.all() or not toxic.any():
        return Model({}, -np.inf)
    ids, starts, seen = numbered(words_of(t) for t in texts)
    vocabulary, plain_ids = list(seen), Ids()
    own, offsets, _ = numbered([features(w) for w in vocabulary], plain_ids)
    stop = np.fromiter(map(ends, vocabulary), bool, len(vocabulary))[ids]
    at, feature = expanded(ids, own, offsets)
    text = np.searchsorted(starts, at, "right") - 1
    # Words that more toxic texts hold than chance explains.
    pair = np.unique(text * len(plain_ids) + feature)
    doc, word = pair // len(plain_ids), pair % len(plain_ids)
    n = np.bincount(word, minlength=len(plain_ids))
    k = np.bincount(word, weights=toxic[doc], minlength=len(plain_ids))
    share = toxic.mean()
    z = (k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    used = np.flatnonzero((n >= least_docs) & (z >= least_z))
    place = np.full(len(plain_ids), -1)
    place[used] = np.arange(len(used))
    first, sentence_text = sentence_starts(stop, starts)
    hit = np.flatnonzero(place[feature] >= 0)
    sentence = np.searchsorted(first, at[hit], "right") - 1
    cell = np.unique(sentence * max(1, len(used)) + place[feature[hit]])
    row, col = cell // max(1, len(used)), cell % max(1, len(used))
    # Sentences without such a word differ by nothing: one per text, with their number.
    marked = np.unique(row)
    compact = np.searchsorted(marked, row)
    rest = np.bincount(sentence_text, minlength=len(texts)) - np.bincount(sentence_text[marked], minlength=len(texts))
    owner = sentence_text[marked]
    weigh = np.where(toxic, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
    w, b = np.zeros(len(used)), -5.0
    m_w, v_w, m_b, v_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        x = b + np.bincount(compact, weights=w[col], minlength=len(marked))
        # -log(1 - P) of a text: the sum of softplus over its sentences.
        hazard = np.bincount(owner, weights=softplus(x), minlength=len(texts)) + rest * softplus(b)
        pull = weigh * np.where(toxic, 1.0 / np.expm1(np.clip(hazard, 1e-9, 700)), -1.0)  # d log-likelihood / d hazard
        p, p0 = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-b))
        g_x = pull[owner] * p
        g_w = np.bincount(col, weights=g_x[compact], minlength=len(used)) / len(texts) - L2 * w
        g_b = (g_x.sum() + (pull * rest).sum() * p0) / len(texts)
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.999 * v_w + 0.001 * g_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.999 * v_b + 0.001 * g_b**2
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = np.maximum(w + RATE * (m_w / fix1) / (np.sqrt(v_w / fix2) + 1e-9) * min(1.0, 150 / step), 0.0)
        b += RATE * (m_b / fix1) / (np.sqrt(v_b / fix2) + 1e-9) * min(1.0, 150 / step)
    names = list(plain_ids)
    return Model({names[used[i]]: float(w[i]) for i in range(len(used)) if w[i] > 0}, float(b))


def trained(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From the sampled texts for whose rows ``training`` is true; ``sample`` of each class come to the driver."""
    own = docs.where(training).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("y"))
    hashed = own.where("t is not null").withColumn("h", F.xxhash64("t"))
    found = sampled(hashed.select("id", "h").join(marked, "id").select("y", "h"), hashed.select("h", "t"), sample)
    clean, toxic = found.get(False, []), found.get(True, [])
    return fit(clean + toxic, np.array([False] * len(clean) + [True] * len(toxic)))


class Known:
    """Numbers words; has each one's weighted features and whether it ends a sentence."""

    def __init__(self, model: Model):
        self.place = {w: i for i, w in enumerate(model.weights)}
        self.weights = np.fromiter(model.weights.values(), float, len(model.weights))
        self.ids, self.stops, self.marked, self.own = Ids(), [], [], {}

    def learn(self) -> None:
        for i, word in enumerate(list(self.ids)[len(self.stops) :], len(self.stops)):
            self.stops.append(ends(word))
            own = [self.place[f] for f in features(word) if f in self.place]
            self.marked.append(bool(own))
            if own:
                self.own[i] = own


def sentence_scores(texts: list[bytes], model: Model, known: Known) -> tuple[np.ndarray, ...]:
    """Text, first word and one past the last word, and log-odds of each sentence."""
    ids, starts, _ = numbered((words_of(t) for t in texts), known.ids)
    known.learn()
    first, text = sentence_starts(np.array(known.stops, bool)[ids], starts)
    if not len(first):
        return text, first, first, np.empty(0)
    last, x = np.append(first[1:], len(ids)), np.full(len(first), model.bias)
    hit = np.flatnonzero(np.array(known.marked, bool)[ids])
    if len(hit):
        own = [known.own[i] for i in ids[hit].tolist()]
        sentence = np.repeat(np.searchsorted(first, hit, "right") - 1, [len(o) for o in own])
        cell = np.unique(sentence * len(known.weights) + np.array([f for o in own for f in o]))
        x += np.bincount(cell // len(known.weights), weights=known.weights[cell % len(known.weights)], minlength=len(first))
    return text, first - starts[text], last - starts[text], x


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, offending: the sentences (first word, words, score) that alone reach half the odds."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model)
        for block in blocks(batches, "t"):
            texts = as_bytes(block, "t")
            if len(known.ids) > MEMO:
                known = Known(model)
            if np.isfinite(model.bias):
                text, first, last, x = sentence_scores(texts, model, known)
                score = -np.expm1(-np.bincount(text, weights=softplus(x), minlength=len(texts)))
            else:
                text = first = last = np.empty(0, np.int64)
                x, score = np.empty(0), np.zeros(len(texts))
            spans: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(x > 0):
                spans[text[i]].append({"first_word": int(first[i]), "words": int(last[i] - first[i]), "score": float(1 / (1 + np.exp(-x[i])))})
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(np.clip(score, 0, 1)), pa.array(spans, pa.list_(span))], ["id", "score", "offending"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double, offending array<struct<first_word:long,words:long,score:double>>")
    return out.withColumnRenamed("id", id_col)
