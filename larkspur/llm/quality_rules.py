"""Quality rules whose cut-offs carry a guarantee.

Each rule rejects a text whose statistic exceeds a cut-off. In every stratum (a band of text lengths)
a path leads from no rule at all to ever stricter ones: each step lowers the cut-off of one rule, the
one that rejects the most labelled bad texts for each unlabelled text that it costs. The path knows
nothing of the good labelled texts. These then test it, step by step: the exact (Clopper-Pearson)
upper bound on the rate at which all rules together reject a good text must stay within ``risk``; the
first step that fails ends the path (a fixed sequence needs no correction), and the error probability
``delta`` is divided by the number of strata (Bonferroni), so all bounds hold at once. The cut-offs are
those of the last step that passed.

Trials must be independent, so labelled texts count once, however many documents repeat them; a text
counts as good if any of its labels does.

Defined cases: a null or empty text has no words and fails the base rule; texts that fail it take no
part in the choice; a null label or a label without a document counts for nothing; a stratum without
good or without bad labelled texts has no rules. Rows repeat in the result as they do in the input, and
columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, blocks, bounded_batches, numbered, sums, written

SYMBOLS, SPACES, WINDOW = "#*$%&|<>", " \t\n\v\f\r", 8
RISK, DELTA = 0.02, 0.05
#: Least number of words of each stratum.
STRATA = (0, 200)
BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: Rules: SQL of the statistic (0 where there is nothing to divide by) and the grid of its cut-offs, lowest first.
GRID = tuple(round(0.02 * i, 2) for i in range(1, 51))
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", tuple(round(0.05 * i, 2) for i in range(1, 61))),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", GRID),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", GRID),
    "long_words": ("word_chars / greatest(n_words, 1)", tuple(6 + 0.25 * i for i in range(57))),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def pair_ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each distinct pair."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def repeat_words(ids: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of so many words (a power of two) that the text has twice or more; exact, without hashing."""
    ranks, own = ids, np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size = 1
    while size < window:
        ranks = pair_ranks(ranks[: max(0, len(ranks) - size)], ranks[size:])
        size *= 2
    inside = np.zeros(len(ids), bool)
    inside[: len(ranks)] = own[: len(ranks)] == own[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(len(starts) - 1, np.int64)
    key = pair_ranks(own[at], ranks[at])
    again = at[np.bincount(key)[key] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[again] += 1
    np.subtract.at(cover, again + window, 1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), starts)


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    ids, starts, _ = numbered(t.split() for t in texts)
    out = {"n_words": np.diff(starts), "n_repeat_words": repeat_words(ids, starts)}
    rest = {k: np.zeros(len(texts), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_lines")}
    for i, t in enumerate(texts):
        s = t.decode("utf-8", "replace")
        rest["word_chars"][i] = len(s) - sum(map(s.count, SPACES))
        rest["n_symbols"][i] = sum(map(s.count, SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip()]
        rest["n_lines"][i], rest["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    return out | rest


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, STATS and a hash of the text for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "t"):
            found = text_stats(as_bytes(block, "t"))
            yield pa.RecordBatch.from_arrays([block.column("id").combine_chunks(), *(pa.array(found[k]) for k in STATS), block.column("h").combine_chunks()], ["id", *STATS, "h"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    return own.mapInArrow(run, "id long, " + ", ".join(f"{k} long" for k in STATS) + ", h long")


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p for which k or fewer of n have at least probability delta."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) if 0 < p < 1 else -math.inf for i, c in enumerate(logs)]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms) if top > -math.inf else 0.0
        low, high = (p, high) if tail > delta else (low, p)
    return high


def allowed(n: int, risk: float, delta: float) -> int:
    """Most good texts among n that a cut-off may reject; -1 if none may. Found by halving, as the bound grows with k."""
    low, high = -1, n
    while high - low > 1:
        k = (low + high) // 2
        if k <= risk * n and upper_bound(k, n, delta) <= risk:
            low = k
        else:
            high = k
    return low


def stratum():
    out = F.lit(0)
    for i, least in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= least, i).otherwise(out)
    return out


def step(value, grid: tuple):
    """How many steps down the grid, from its highest cut-off, it takes to reject a value; one more than there are if none does."""
    return F.lit(len(grid) + 1) - F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c < value))


def path(bad: np.ndarray, weight: np.ndarray, cost: list[np.ndarray]) -> list[tuple[int, int]]:
    """(rule, step) in order: each next one rejects the most bad texts for each unlabelled text that the rule did not cost before.

    bad: ``step`` of each kind of text by each rule, weight: how many there are; cost: by rule, how many unlabelled texts each step rejects, 0 the first."""
    out, at = [], [0] * len(cost)
    while len(bad):
        best = None
        for rule, spent in enumerate(cost):
            gains = np.cumsum(np.bincount(np.minimum(bad[:, rule], len(spent)), weights=weight, minlength=len(spent) + 1)[: len(spent)])
            rate = gains / (1.0 + np.maximum(spent - spent[at[rule]], 0))
            k = int(np.argmax(rate))  # of equals the highest cut-off
            if gains[k] > 0 and (best is None or rate[k] > best[0]):
                best = rate[k], rule, k
        if best is None:
            break
        _, rule, k = best
        at[rule] = k
        out.append((rule, k))
        bad, weight = bad[bad[:, rule] > k], weight[bad[:, rule] > k]
    return out


def certified(good: np.ndarray, weight: np.ndarray, moves: list[tuple[int, int]], most: int) -> dict[int, int]:
    """Rule to step at the end of the longest beginning of the path that rejects at most ``most`` of good."""
    out: dict[int, int] = {}
    left = np.ones(len(good), bool)
    for rule, k in moves:
        left &= good[:, rule] > k
        if int(weight[~left].sum()) > most:
            break
        out[rule] = k
    return out


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, label_id: str = "doc_id", label_col: str = "quality") -> dict[str, dict[int, float]]:
    """Cut-off by rule and stratum. Spark counts the labelled texts of each combination of steps and the unlabelled ones of each step; these counts, which the grids bound, come to the driver."""
    names, grids = list(RULES), [grid for _, grid in RULES.values()]
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(label_col).alias("good"))
    base = stats.where(f"not ({BASE})").select("id", "h", stratum().alias("s"), *(step(F.expr(sql), grid).alias(rule) for rule, (sql, grid) in RULES.items()))
    texts = base.join(marked, "id").groupBy("s", "h", *names).agg(F.max("good").alias("good"))
    kinds = texts.groupBy("s", "good", *names).agg(F.count("*").alias("n")).collect()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("step")) for n in names))).alias("x")
    others = base.join(marked, "id", "left_anti").select("s", each).groupBy("s", "x.rule", "x.step").agg(F.count("*").alias("n")).collect()
    out: dict[str, dict[int, float]] = {n: {} for n in names}
    for s in range(len(STRATA)):
        own = {y: [r for r in kinds if r.s == s and r.good == y] for y in (0, 1)}
        if not own[0] or not own[1]:
            continue
        (bad, bad_n), (good, good_n) = ((np.array([[r[n] for n in names] for r in own[y]], np.int64), np.array([r.n for r in own[y]], np.int64)) for y in (0, 1))
        cost = []
        for n, grid in zip(names, grids, strict=True):
            count = np.zeros(len(grid) + 2)
            for r in others:
                if r.s == s and r.rule == n:
                    count[r.step] += r.n
            cost.append(np.cumsum(count[:-1]))
        most = allowed(int(good_n.sum()), risk, delta / len(STRATA))
        for rule, k in certified(good, good_n, path(bad, bad_n, cost), most).items():
            out[names[rule]][s] = grids[rule][-k]
    return out


def judged(stats: DataFrame, cuts: dict[str, dict[int, float]]) -> DataFrame:
    """stats with base_failed, failed_rules and kept."""
    base = F.expr(BASE)
    failed = [F.when((F.expr(RULES[r][0]) > c) & (stratum() == s), F.lit(r)) for r, by in cuts.items() for s, c in by.items()]
    failed_rules = F.array_distinct(F.array_compact(F.array(*failed))) if failed else F.array().cast("array<string>")
    return stats.withColumn("base_failed", base).withColumn("failed_rules", failed_rules).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, STATS, base_failed, failed_rules, kept for each row of docs."""
    stats = written(measured(docs, id_col, text_col), "stats")
    return judged(stats, thresholds(stats, labels, risk, delta)).drop("h").withColumnRenamed("id", id_col)
