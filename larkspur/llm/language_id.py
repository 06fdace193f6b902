"""Language identification in two steps: the family, then the language within it.

Features are frequencies of hashed byte trigrams of the lower-cased text, with ASCII characters other
than letters as spaces. One-versus-rest linear support vector machines choose the family; within it
one-versus-one machines for each pair of languages vote (a tie goes to the larger sum of
probabilities, then to the first name). A machine is linear in the frequencies, so its margin is the
mean of one weight per trigram, taken over the whole text. Margins become probabilities by a
logistic curve fitted to the training margins; the score is that of the family times the mean of the
language's against each other one of its family, so a sure language scores 1 in a family of any size.

Training uses a bounded, reproducible sample: for each language the ``sample`` distinct texts with
the least hashes, whole, or fewer where there are so many languages that ``most_texts`` would be passed.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text of any script
gets the language that the machines choose; languages without a known family are families of their
own; without training texts every text is ``und``; a single language has score 1. Rows repeat in the
result as in the input; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import blocks, bounded_batches, sampled

UNDETERMINED = "und"
SAMPLE, MOST_TEXTS = 500, 50_000
DIMS, SCALE, COST, EPOCHS = 1 << 13, 10.0, 10.0, 15
BLOCK = 4 << 20

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
}

FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: ASCII letters as they are, other ASCII as spaces, other bytes as they are.
TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each trigram of all texts, and where texts start. Each text has a space at either end, so it has a trigram unless it is empty."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(TABLE) + b" " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    raw = np.frombuffer(b"".join([*parts, b"  "]), np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - (DIMS.bit_length() - 1))).astype(np.int32), starts


def margins(texts: list[str], weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """A row per text and a column per machine."""
    feature, starts = trigrams(texts)
    n, out = np.diff(starts), np.empty((len(texts), len(biases)))
    for k in range(len(biases)):
        out[:, k] = SCALE * np.add.reduceat(weights[k][feature], starts[:-1], dtype=np.float64) / n + biases[k]
    return out


@dataclass(frozen=True)
class Rows:
    """Sparse vectors: those of vector i are at starts[i] to starts[i + 1]."""

    feature: np.ndarray
    value: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def frequencies(texts: list[bytes]) -> Rows:
    """Trigram frequencies of each text."""
    found = []
    for t in texts:
        feature, _ = trigrams([t.decode("utf-8", "replace")])
        kinds, counts = np.unique(feature, return_counts=True)
        found.append((kinds.astype(np.int32), (counts * (SCALE / len(feature))).astype(np.float32)))
    return stacked([Rows(f, v, np.array([0, len(f)])) for f, v in found])


def stacked(parts: list[Rows]) -> Rows:
    sizes = [np.diff(p.starts) for p in parts]
    return Rows(np.concatenate([p.feature for p in parts]), np.concatenate([p.value for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64))


def machine(x: Rows, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, bias and logistic slope of a linear machine (squared hinge, dual coordinate descent); y: 1 or -1."""
    n, w, b, alpha = len(x), np.zeros(DIMS), 0.0, np.zeros(len(x))
    cost = COST * n / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # both classes weigh the same
    diagonal = 1 / (2 * cost)
    norm = np.add.reduceat(x.value.astype(float) ** 2, x.starts[:-1]) + 1 + diagonal
    starts, rng = x.starts.tolist(), np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(n).tolist():
            own = slice(starts[i], starts[i + 1])
            at, v = x.feature[own], x.value[own]
            step = max(-alpha[i], -(y[i] * (v @ w[at] + b) - 1 + alpha[i] * diagonal[i]) / norm[i])
            if step:
                alpha[i] += step
                w[at] += (step * y[i]) * v
                b += step * y[i]
    z, slope = y * (np.add.reduceat(x.value * w[x.feature], x.starts[:-1]) + b), 1.0
    for _ in range(20):  # the slope that makes the training margins most likely, held back by one error each way
        p = 1 / (1 + np.exp(np.clip(slope * z, -50, 50)))
        slope = float(np.clip(slope + ((z * p).sum() - 0.01 * slope) / ((z * z * p * (1 - p)).sum() + 0.01), 0.1, 20))
    return w, b, slope


@dataclass(frozen=True)
class Model:
    families: tuple[tuple[str, ...], ...]  # languages of each family
    weights: np.ndarray
    biases: np.ndarray
    slopes: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        own = np.array([i for i, t in enumerate(texts) if next(filter(str.isalpha, t), None)], np.int64)
        if not len(own) or not self.families:
            return lang, score
        m = margins([texts[i] for i in own], self.weights, self.biases)
        p = 1 / (1 + np.exp(np.clip(-self.slopes * m, -50, 50)))
        k = len(self.families)
        if k == 1:
            at, family, sure = 0, np.zeros(len(own), np.int64), np.ones(len(own))
        elif k == 2:
            at, family, sure = 1, (m[:, 0] <= 0).astype(np.int64), np.maximum(p[:, 0], 1 - p[:, 0])
        else:
            at, family = k, m[:, :k].argmax(axis=1)
            sure = p[np.arange(len(own)), family] / p[:, :k].sum(axis=1)
        for f, languages in enumerate(self.families):
            mine = np.flatnonzero(family == f)
            votes, odds = np.zeros((len(mine), len(languages))), np.zeros((len(mine), len(languages)))
            for a, b in combinations(range(len(languages)), 2):
                votes[:, a] += m[mine, at] > 0
                votes[:, b] += m[mine, at] <= 0
                odds[:, a] += p[mine, at]
                odds[:, b] += 1 - p[mine, at]
                at += 1
            best = (votes + odds / (len(languages) + 1)).argmax(axis=1)
            share = odds[np.arange(len(mine)), best] / (len(languages) - 1) if len(languages) > 1 else np.ones(len(mine))
            for i, b, s in zip(mine, best, share, strict=True):
                lang[own[i]], score[own[i]] = languages[b], sure[i] * s
        return lang, score


def fit(texts: dict[str, list[bytes]]) -> Model:
    """texts by language."""
    by: dict[str, list[str]] = {}
    for code in sorted(c for c, t in texts.items() if t):
        by.setdefault(FAMILY_OF.get(code.split("-")[0].lower(), code), []).append(code)
    families = tuple(tuple(by[f]) for f in sorted(by))
    x = {c: frequencies(texts[c]) for f in families for c in f}

    def apart(a: list[str], b: list[str]):
        rows = stacked([x[c] for c in (*a, *b)])
        n = sum(len(x[c]) for c in a)
        return machine(rows, np.where(np.arange(len(rows)) < n, 1.0, -1.0))

    found = []
    if len(families) > 1:
        for f in families[: 1 if len(families) == 2 else None]:
            found.append(apart(list(f), [c for g in families if g != f for c in g]))
    for f in families:
        found += [apart([a], [b]) for a, b in combinations(f, 2)]
    return Model(families, np.array([w for w, _, _ in found], np.float32).reshape(len(found), DIMS), np.array([b for _, b, _ in found]), np.array([s for _, _, s in found]))


def trained(docs: DataFrame, training: Column, sample: int = SAMPLE, most_texts: int = MOST_TEXTS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """One pass over the texts for the sample's hashes and one for the sample itself, whatever the number of languages."""
    rows = docs.where(training).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("y")).where("t is not null and y is not null").withColumn("h", F.xxhash64("t"))
    return fit(sampled(rows.select("y", "h"), rows.select("h", "t"), sample, most_texts))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t", BLOCK):
            lang, score = model.predict([t or "" for t in block.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, model: Model, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text has a language at no less than least_score. Without training texts no text has one, and none stays."""
    bounded_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, BLOCK):
            lang, score = model.predict([t or "" for t in block.column(text_col).to_pylist()])
            good = pa.array([a != UNDETERMINED and b >= least_score for a, b in zip(lang, score, strict=True)], pa.bool_())
            yield from block.filter(good).to_batches()

    return docs.mapInArrow(keep, docs.schema)
