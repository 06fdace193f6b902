"""Cut-point search: a survival comparison at every threshold of a numeric covariate.

Subjects are counted by (threshold interval, time) in Spark. The low side of a threshold is the sum of
the intervals up to it. A scan cuts the sorted thresholds into blocks of ``BLOCK``; a window over the
blocks gives each the counts before it, and one task for each block adds its own intervals and makes
all comparisons of the block. A task holds a block's counts and the distinct times, whatever the number
of subjects; the driver holds one number for each block. Successive thresholds share most of their work
(``_Steps``); where they differ at too many times, or a side is small, each is compared over all times.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import dist, labels
from larkspur.operators.ranks import quantile, running
from larkspur.operators.survival import cox_cells, cox_many, event_table, km_curve

BLOCK = 2048
TASKS = 10000
CELLS = 1 << 17  # thresholds x times compared at once
STEP, LEAST, FEW = 96, 8, 256  # thresholds whose states share nodes, at most and at least, and times below which all are compared at all times
NODES, NODES_COX, KEEP, REACH = 6, 4, 20, 0.05  # of the interpolation; how many times the joined subjects a side keeps at risk; log hazard ratios about the middle
SCAN = (
    "threshold double, group0_label string, group1_label string, valid_split boolean, reason string, group0_n long, group1_n long, split_ratio double, chi2 double, log_rank_p double, hr double, ci_low double, ci_high double, "
    "cox_p double, p_label string, group0_median double, group1_median double, group0_follow_up double, group1_follow_up double"
)


def fenced(values: np.ndarray, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> np.ndarray:
    """Sorted candidates inside the quartile fence, which is skipped where it leaves none, and without a share of either end."""
    if iqr_multiplier and len(values):
        q1, q3 = np.percentile(values, [25, 75])
        reach = iqr_multiplier * (q3 - q1)
        inside = values[(values >= q1 - reach) & (values <= q3 + reach)]
        values = inside if len(inside) else values
    cut = min(math.floor(len(values) * trim_percent / 100), max(0, (len(values) - 1) // 2))
    return values[cut : len(values) - cut]


def _known(df: DataFrame, covariate: str) -> DataFrame:
    x = F.col(covariate).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).select(F.lit("x").alias("k"), x.alias("x")).groupBy("k", "x").agg(F.count("*").alias("c"))


def observed_range(df: DataFrame, covariate: str, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> tuple[float, float] | None:
    """The least and largest of the observed candidates: all distinct values but the largest, fenced and trimmed as by ``fenced``; every distinct value between them is a candidate. None without a value."""
    return _range(_known(df, covariate), iqr_multiplier, trim_percent)


def _range(freq: DataFrame, iqr_multiplier: float | None, trim_percent: float) -> tuple[float, float] | None:
    ranked = running(freq.withColumn("one", F.lit(1)), "k", "x", "one", "rank").persist()
    n = ranked.count()
    if not n:
        return None
    some = ranked.where(F.col("rank") < max(n, 2))
    size = F.lit(max(n - 1, 1))
    inside = F.lit(True)
    if iqr_multiplier:
        q1, q3 = some.agg(quantile(0.25, size, F.col("x"), F.col("rank")), quantile(0.75, size, F.col("x"), F.col("rank"))).first()
        reach = iqr_multiplier * (q3 - q1)
        inside = F.col("x").between(q1 - reach, q3 + reach)
    low, high = some.where(inside).agg(F.min("rank"), F.max("rank")).first()
    if low is None:
        low, high = 1, max(n - 1, 1)
    cut = min(math.floor((high - low + 1) * trim_percent / 100), max(0, (high - low) // 2))
    ends = some.where(F.col("rank").isin(low + cut, high - cut)).agg(F.min("x"), F.max("x")).first()
    ranked.unpersist()
    return ends[0], ends[1]


def observed_thresholds(df: DataFrame, covariate: str, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> DataFrame:
    """threshold: every observed candidate."""
    found = observed_range(df, covariate, iqr_multiplier, trim_percent)
    values = _known(df, covariate).select(F.col("x").alias("threshold"))
    return values.where(F.col("threshold").between(*found) if found else F.lit(False))


def thresholds(df: DataFrame, covariate: str, resolution: float | None = None, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> np.ndarray:
    """On the driver: a grid from the least to the largest value, or (resolution None) the observed candidates."""
    if resolution is None:
        return np.sort([r.threshold for r in observed_thresholds(df, covariate, iqr_multiplier, trim_percent).collect()])
    if resolution <= 0:
        raise ValueError("the resolution must be above 0")
    x = F.col(covariate).cast("double")
    low, high = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.min(x), F.max(x)).first()
    if low is None:
        return np.empty(0)
    grid = low + resolution * np.arange(math.floor((high - low) / resolution + 1e-9) + 1)
    return fenced(grid[grid <= high + 1e-9], iqr_multiplier, trim_percent)


def median(df: DataFrame, covariate: str) -> float | None:
    """Exact, over running counts."""
    return _middle(_known(df, covariate))


def _middle(freq: DataFrame) -> float | None:
    n = freq.agg(F.sum("c")).first()[0]
    return running(freq, "k", "x", "c").agg(quantile(0.5, F.lit(n), F.col("x"), F.col("cum"))).first()[0] if n else None


def interval_table(df: DataFrame, covariate: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct times, and events and subjects by (interval, time); interval i holds values above cut i - 1 up to cut i. A missing value is in the last."""
    def place(batches):
        for b in batches:
            x = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            at = np.where(np.isnan(x), len(cuts), np.searchsorted(cuts, x, "left"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], ["time", "event", "interval"])

    rows = df.select(F.col("time").cast("double"), F.col("event").cast("boolean"), F.col(covariate).cast("double").alias("x")).mapInArrow(place, "time double, event boolean, interval int")
    counts = rows.groupBy("interval", "time").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count("*").alias("m")).collect()
    times = np.unique([r.time for r in counts])
    d, m = np.zeros((len(cuts) + 1, len(times))), np.zeros((len(cuts) + 1, len(times)))
    for r in counts:
        at = np.searchsorted(times, r.time)
        d[r.interval, at], m[r.interval, at] = r.d, r.m
    return times, d, m


def logrank_scan(d: np.ndarray, m: np.ndarray) -> np.ndarray:
    """chi2 at each cut, by prefix sums."""
    low_d, low_n = np.cumsum(d, axis=0)[:-1], np.cumsum(np.cumsum(m, axis=0)[:-1, ::-1], axis=1)[:, ::-1]
    dt, nt = d.sum(axis=0), np.cumsum(m.sum(axis=0)[::-1])[::-1]
    share = low_n / nt
    u = (low_d - dt * share).sum(axis=1)
    v = (np.where(nt > 1, dt * (nt - dt) / np.maximum(nt - 1, 1), 0.0) * share * (1 - share)).sum(axis=1)
    return np.divide(u * u, v, out=np.full(len(u), np.nan), where=v > 0)


def _least_cut(x: Column, low: float, high: float, middle: float) -> Column:
    """The least of the cuts (every value between low and high, and middle) that is not below x; null beyond all of them."""
    return F.when((x <= middle) & ((x > high) | (F.lit(middle) < low)), F.lit(middle)).when(x <= low, F.lit(low)).when(x <= high, x)


def _placed(surv: DataFrame, column: str, cuts: np.ndarray, name: str) -> DataFrame:
    """surv with name: the number of cuts below the column's value."""
    def place(batches):
        for b in batches:
            x = b.column(column).to_numpy(zero_copy_only=False).astype(float)
            at = np.where(np.isnan(x), len(cuts), np.searchsorted(cuts, x, "left"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], [*b.schema.names, name])

    return surv.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in surv.dtypes) + f", {name} long")


def scan(df: DataFrame, covariate: str, cuts: np.ndarray | list | None = None, alpha: float = 0.05, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> DataFrame:
    """SCAN, a row per threshold; df has time, event and the covariate. Without cuts: all observed candidates (``observed_range``) and the median.

    A subject without a covariate is on the high side. A threshold that leaves a side unfit keeps its row, with the reason and without a test. A median that is never reached is infinite."""
    return _scanned(df, covariate, cuts, alpha, iqr_multiplier, trim_percent)[0]


def scan_and_median(df: DataFrame, covariate: str, alpha: float = 0.05, iqr_multiplier: float | None = 1.5, trim_percent: float = 0.0) -> tuple[DataFrame, float | None]:
    """``scan`` of all observed candidates, and the median, which it has among its thresholds; df is read once."""
    return _scanned(df, covariate, None, alpha, iqr_multiplier, trim_percent)


def _scanned(df: DataFrame, covariate: str, cuts: np.ndarray | list | None, alpha: float, iqr_multiplier: float | None, trim_percent: float) -> tuple[DataFrame, float | None]:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    spark = df.sparkSession
    extra = None if cuts is None else [float(c) for c in np.unique(np.asarray(cuts, float))]
    if extra == []:
        return spark.createDataFrame([], SCAN), None
    x = F.col(covariate).cast("double")
    surv = df.select(F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), F.when(~F.isnan(x), x).alias("x"))
    rows = surv.groupBy("x", "time").agg(F.coalesce(F.sum(F.col("event").cast("long")), F.lit(0)).alias("d"), F.count("*").alias("m")).localCheckpoint()  # read by all that follows; freed with the result
    middle = None
    if extra is None:
        freq = rows.where("x is not null").groupBy(F.lit("x").alias("k"), "x").agg(F.sum("m").alias("c"))
        found = _range(freq, iqr_multiplier, trim_percent)
        if not found:
            return spark.createDataFrame([], SCAN), None
        middle = _middle(freq)
        extra = [middle]
        rows = rows.withColumn("cut", _least_cut(F.col("x"), *found, middle))
    else:
        rows = _placed(rows, "x", np.array(extra), "at").withColumn("cut", F.get(F.lit(extra), F.col("at").cast("int")))
    counts = rows.groupBy("cut", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    empty = spark.createDataFrame([(c, None, 0, 0) for c in extra], "cut double, time double, d long, m long")  # cuts at which no subject need be
    points = counts.unionByName(empty).where("cut is not null")
    ranked = running(points.select(F.lit("x").alias("k"), "cut").distinct().withColumn("one", F.lit(1)), "k", "cut", "one", "rank")
    edges = np.sort([r.cut for r in ranked.where(F.col("rank") % BLOCK == 0).collect()])
    points = _placed(points, "cut", edges, "block")
    totals = counts.groupBy("time").agg(F.sum("d").alias("all_d"), F.sum("m").alias("all_m"))
    own = points.where("time is not null").groupBy("block", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    every = totals.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(edges))))).withColumn("block", F.col("block").cast("long"))
    before = Window.partitionBy("time").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = every.join(own, ["block", "time"], "left").select("block", "time", "all_d", "all_m", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("d", "m")))
    tasks = min(len(edges) + 1, TASKS)  # by number, as few bytes would be put into one task, and the work is thresholds x times
    return points.repartition(tasks, "block").groupBy("block").cogroup(base.repartition(tasks, "block").groupBy("block")).applyInPandas(_comparisons(dist.NORMAL.inv_cdf(1 - alpha / 2)), SCAN), middle


def _crossing(time: np.ndarray, d: np.ndarray, risk: np.ndarray) -> np.ndarray:
    """The first time at which each row's survival is 0.5 or less."""
    s = np.cumprod(1 - np.divide(d, risk, out=np.zeros(d.shape), where=risk > 0), axis=1)
    due = s <= 0.5
    return np.where(due.any(axis=1), time[due.argmax(axis=1)], math.inf)


def _comparisons(z: float):
    def run(points: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in SCAN.split(", ")]
        base = base.sort_values("time")
        if not len(points) or not len(base):
            return pd.DataFrame(columns=names)
        cuts, at = np.unique(points["cut"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        order = order[points["time"].notna().to_numpy()[order]]
        subjects = _Subjects(base["time"].to_numpy(), base["all_d"].to_numpy(float), base["all_m"].to_numpy(float))
        column = np.searchsorted(subjects.time, points["time"].to_numpy()[order])
        at, own_d, own_m = at[order], points["d"].to_numpy(float)[order], points["m"].to_numpy(float)[order]
        d0, m0, beta, out = base["d"].to_numpy(float), base["m"].to_numpy(float), None, []
        width, few = max(1, CELLS // len(base)), len(base) < FEW
        first, step = 0, STEP
        while first < len(cuts):
            size = min(width if few or step < LEAST else step, len(cuts) - first)
            mine = slice(*np.searchsorted(at, [first, first + size]))
            new = at[mine] - first, column[mine], own_d[mine], own_m[mine]
            if few or step < LEAST:
                found, beta = _dense(subjects, size, *new, d0, m0), None
            else:
                found, beta = _stepped(subjects, size, *new, d0, m0, beta)
                if found is None:
                    step //= 2
                    continue
            out.append(found)
            d0, m0 = d0 + np.bincount(new[1], new[2], len(d0)), m0 + np.bincount(new[1], new[3], len(m0))
            first, step = first + size, min(STEP, 2 * max(step, LEAST))
        return _labelled(cuts, {k: np.concatenate([found[k] for found in out]) for k in out[0]}, z)[names]

    return run


class _Subjects:
    """Events and subjects of all by time, and what the comparisons of any threshold take from them."""

    def __init__(self, time: np.ndarray, d: np.ndarray, m: np.ndarray):
        self.time, self.d, self.m, self.n = time, d, m, _at_risk(m)
        self.factor = np.where(self.n > 1, d * (self.n - d) / np.maximum(self.n - 1, 1), 0.0)
        self.hazard, self.first, self.second = d / self.n, self.factor / self.n, self.factor / self.n**2


def _at_risk(m: np.ndarray) -> np.ndarray:
    return np.cumsum(m[..., ::-1], axis=-1)[..., ::-1]


def _validity(sizes: list[np.ndarray], events: list[np.ndarray]) -> np.ndarray:
    """The reason against each split, or None."""
    reason = np.full(len(sizes[0]), None, object)
    for e, n in reversed(list(zip(events, sizes, strict=True))):
        reason = np.where(n <= 1, "group_size_1", np.where(e == 0, "no_events", np.where(e == n, "no_censoring", reason)))
    return np.where((sizes[0] == 0) | (sizes[1] == 0), "one_side_empty", reason)


def _chi2(u: np.ndarray, v: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.divide(u * u, v, out=np.full(len(u), np.nan), where=(v > 0) & ok)


def _dense(w: _Subjects, size: int, at, column, own_d, own_m, d0, m0) -> dict:
    """The comparisons of size thresholds, each over all times. Subjects own_d, own_m of column join the low side, d0 and m0 before, at threshold at."""
    low_d, low_m = np.zeros((size, len(w.time))), np.zeros((size, len(w.time)))
    np.add.at(low_d, (at, column), own_d)
    np.add.at(low_m, (at, column), own_m)
    low_d, low_m = np.cumsum(low_d, axis=0) + d0, np.cumsum(low_m, axis=0) + m0
    sides = [(low_d, low_m), (w.d - low_d, w.m - low_m)]
    sizes = [y.sum(axis=1) for _, y in sides]
    reason = _validity(sizes, [e.sum(axis=1) for e, _ in sides])
    ok = np.equal(reason, None)
    risk = [_at_risk(y) for _, y in sides]
    share = risk[0] / w.n
    u, v = (low_d - w.d * share).sum(axis=1), (w.factor * share * (1 - share)).sum(axis=1)
    beta, se = np.full(size, np.nan), np.full(size, np.nan)
    if ok.any():
        beta[ok], se[ok] = cox_many(sides[1][0][ok], risk[1][ok], w.d, w.n)
    out = {"reason": reason, "n0": sizes[0], "n1": sizes[1], "chi2": _chi2(u, v, ok), "beta": beta, "se": se}
    for i, (e, y) in enumerate(sides):
        out[f"group{i}_median"], out[f"group{i}_follow_up"] = _crossing(w.time, e, risk[i]), _crossing(w.time, y - e, risk[i])
    return out


class _Steps:
    """The states of successive thresholds, whose subjects join the low side.

    Between the times of those subjects (columns ``exact``) the sides differ from threshold to threshold only in a number that is the same for a
    whole stretch of times: the joined subjects still at risk. A sum over such a stretch is a smooth function of it, so it is interpolated between
    a few values, and the exact columns are added one by one. Up to as many joined subjects as nodes, the interpolation has no error."""

    def __init__(self, w: _Subjects, size: int, at, column, own_d, own_m, d0, m0):
        n0 = _at_risk(m0)
        self.joined = _at_risk(np.bincount(column, own_m, len(w.time)))
        self.n, self.e = (n0, w.n - n0), (d0, w.d - d0)
        self.censored = m0 - d0, w.m - m0 - self.e[1]
        after = np.minimum(n0 - m0, self.n[1] - self.joined - (w.m - m0))
        weak = (self.joined >= NODES_COX) & (after < KEEP * self.joined)
        self.exact = np.union1d(column, np.flatnonzero(weak))
        self.fit = len(self.exact) * 4 <= len(w.time)
        if not self.fit:
            return
        cum_d, cum_m = np.zeros((size, len(self.exact))), np.zeros((size, len(self.exact)))
        place = at, np.searchsorted(self.exact, column)
        np.add.at(cum_d, place, own_d)
        np.add.at(cum_m, place, own_m)
        self.cum_d, self.cum_m = np.cumsum(cum_d, axis=0), np.cumsum(cum_m, axis=0)
        self.at_risk = np.hstack([_at_risk(self.cum_m), np.zeros((size, 1))])  # by stretch, which ends with its exact column
        self.stretch = np.searchsorted(self.exact, np.arange(len(w.time)))
        plain = np.ones(len(w.time), bool)
        plain[self.exact] = False
        self.plain = np.flatnonzero(plain)

    def nodes(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of joined subjects, node x stretch, and the nodes' weights, node x threshold x stretch."""
        most = self.at_risk[-1]
        top = np.maximum(most, count - 1)
        v, places = self.at_risk * ((count - 1) / top), np.arange(count)
        weights = np.ones((count, *v.shape))
        for i in places:
            for j in places[places != i]:
                weights[i] *= (v - j) / (i - j)
        return np.minimum(places[:, None] * (top / (count - 1)), most), weights

    def summed(self, cells: np.ndarray, weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Sums of cells (... x node x column) over plain columns, at each threshold."""
        found, starts = np.unique(self.stretch[columns], return_index=True)
        if not len(found):
            return np.zeros((*cells.shape[:-2], weights.shape[1]))
        stretches = np.add.reduceat(cells, starts, axis=-1)
        return sum(stretches[..., i, :] @ weights[i][:, found].T for i in range(len(weights)))

    def states(self, e: np.ndarray, n: np.ndarray, moved: np.ndarray, sign: int, rows, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Events and subjects at risk at all thresholds (rows) and the columns."""
        j = self.stretch[columns]
        here = np.zeros(len(columns), bool) if not len(self.exact) else self.exact[np.minimum(j, len(self.exact) - 1)] == columns
        risk = n[columns] + sign * self.at_risk[rows][:, j]
        events = np.repeat(e[columns][None], len(risk), axis=0)
        events[:, here] += sign * moved[rows][:, j[here]]
        return events, risk


def _stepped(w: _Subjects, size: int, at, column, own_d, own_m, d0, m0, beta: float | None) -> tuple[dict | None, float | None]:
    """As ``_dense``, by ``_Steps``, and the last log hazard ratio, near which the next fit starts; None where too many times differ, a side is too small, unfit or its fit too far from its neighbours'."""
    s = _Steps(w, size, at, column, own_d, own_m, d0, m0)
    if not s.fit:
        return None, beta
    sizes, events = [m0.sum() + s.cum_m.sum(axis=1)], [d0.sum() + s.cum_d.sum(axis=1)]
    sizes.append(w.m.sum() - sizes[0])
    events.append(w.d.sum() - events[0])
    reason = _validity(sizes, events)
    if not np.equal(reason, None).all():
        return None, beta
    fit = _stepped_cox(w, s, events[1], beta)
    if fit is None:
        return None, beta
    n0, joined = s.n[0], s.at_risk[:, :-1]
    ends = np.concatenate([[-1], s.exact])
    second = np.diff(np.concatenate([[0.0], np.cumsum(w.second)])[ends + 1])
    linear = [np.cumsum(c)[s.exact] for c in (w.hazard, w.first - 2 * w.second * n0)]
    u = events[0] - w.hazard @ n0 - s.cum_m @ linear[0]
    v = (w.first * n0 - w.second * n0**2).sum() + s.cum_m @ linear[1] - joined**2 @ second
    out = {"reason": reason, "n0": sizes[0], "n1": sizes[1], "chi2": _chi2(u, v, np.ones(size, bool)), "beta": fit[0], "se": fit[1]}
    count, weights = s.nodes(NODES)
    for i, sign in enumerate((1, -1)):
        for name, e, moved in (("median", s.e[i], s.cum_d), ("follow_up", s.censored[i], s.cum_m - s.cum_d)):
            out[f"group{i}_{name}"] = _stepped_crossing(w, s, e, s.n[i], moved, sign, count, weights)
    return out, fit[0][-1]


def _stepped_crossing(w: _Subjects, s: _Steps, e, n, moved, sign: int, count, weights) -> np.ndarray:
    """``_crossing``: bounds of all thresholds' curves leave a few times, up to which the logarithms are summed; a curve within 1e-9 of a half there is computed in full."""
    size, last = len(s.at_risk), len(w.time) - 1
    change = np.zeros(last + 1)
    change[s.exact] = sign * moved[-1]
    ends_e, ends_n = (e, e + change), (n, n + sign * s.joined)
    (e_low, e_top), (n_low, n_top) = (ends_e, ends_n) if sign > 0 else (ends_e[::-1], ends_n[::-1])
    lower = np.cumprod(1 - np.minimum(np.divide(e_top, n_low, out=(e_top > 0).astype(float), where=n_low > 0), 1.0))
    upper = np.cumprod(1 - np.divide(e_low, n_top, out=np.zeros(last + 1), where=n_top > 0))
    if lower[-1] > 0.5 + 1e-9:
        return np.full(size, math.inf)
    begin = int(np.argmax(lower <= 0.5 + 1e-9))
    end = int(np.argmax(upper <= 0.5 - 1e-9)) if upper[-1] <= 0.5 - 1e-9 else last
    columns, exact = s.plain[: np.searchsorted(s.plain, begin)], s.exact[: np.searchsorted(s.exact, begin)]
    logs = s.summed(np.log1p(-e[columns] / (n[columns] + sign * count[:, s.stretch[columns]])), weights, columns)
    own_e, own_n = s.states(e, n, moved, sign, slice(None), exact)
    logs = logs + np.log1p(-own_e / own_n).sum(axis=1)
    columns = np.arange(begin, end + 1)
    own_e, own_n = s.states(e, n, moved, sign, slice(None), columns)
    curve = np.exp(logs)[:, None] * np.cumprod(1 - np.divide(own_e, own_n, out=np.zeros(own_e.shape), where=own_n > 0), axis=1)
    due = curve <= 0.5
    found = np.where(due.any(axis=1), w.time[columns[due.argmax(axis=1)]], math.inf)
    doubt = np.flatnonzero((np.abs(curve - 0.5) <= 1e-9).any(axis=1))
    if len(doubt):
        found[doubt] = _crossing(w.time, *s.states(e, n, moved, sign, doubt, np.arange(last + 1)))
    return found


def _stepped_cox(w: _Subjects, s: _Steps, own: np.ndarray, beta: float | None) -> tuple[np.ndarray, np.ndarray] | None:
    """``cox_many``: gradient and information at three ratios, and between them a polynomial of the fifth degree."""
    due = w.d > 0
    plain, exact = s.plain[due[s.plain]], s.exact[due[s.exact]]
    d, n, d1 = w.d, w.n, s.e[1]
    count, weights = s.nodes(NODES_COX)
    n1 = s.n[1][plain] - count[:, s.stretch[plain]]
    own_d, own_n = s.states(d1, s.n[1], s.cum_d, -1, slice(None), exact)

    def at(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(b)[:, None, None]
        p, squares = (s.summed(c, weights, plain) for c in cox_cells(e, d1[plain], n1, d[plain], n[plain]))
        more, more_squares = (c.sum(axis=-1) for c in cox_cells(e, own_d, own_n, d[exact], n[exact]))
        return own - p - more, p + more - squares - more_squares

    if beta is None:
        every = np.arange(len(d))
        beta = cox_many(*s.states(d1, s.n[1], s.cum_d, -1, [-1], every), d, n)[0][0]
    for _ in range(3):
        gradient, information = at(np.array([beta]))
        if not (np.isfinite(gradient).all() and (information > 0).all()):
            return None
        step = (gradient / information)[0]
        reach = 1.2 * np.abs(step).max() + 1e-6
        if reach <= REACH:
            break
        beta += (step.min() + step.max()) / 2
    else:
        return None
    ratio, joined = math.exp(beta), s.joined[plain]
    least = s.n[0][plain] - s.e[0][plain] + ratio * (s.n[1][plain] - joined - d1[plain])
    far = joined >= NODES_COX  # with fewer the nodes hold every value
    error = 0.1 * (d[plain] * (joined * abs(1 - ratio)) ** 3 * joined * n[plain] * ratio / np.maximum(least, 1e-9) ** 5)[far].sum()
    if not error <= 1e-10 * information.min():
        return None
    (before, after), (less, more) = at(beta + np.array([-reach, reach]))
    f, g = (before, gradient[0], after), tuple(-reach * i for i in (less, information[0], more))
    even, slope = (f[2] + f[0]) / 2 - f[1], (g[2] - g[0]) / 2
    odd, bend = (f[2] - f[0]) / 2 - g[1], (g[2] + g[0]) / 2 - g[1]
    a4, a5 = (slope - 2 * even) / 2, (bend - 3 * odd) / 2
    a2, a3 = even - a4, odd - a5
    t = step / reach
    for _ in range(6):
        value = f[1] + t * (g[1] + t * (a2 + t * (a3 + t * (a4 + t * a5))))
        gain = g[1] + t * (2 * a2 + t * (3 * a3 + t * (4 * a4 + t * 5 * a5)))
        t = t - value / gain
    gain = g[1] + t * (2 * a2 + t * (3 * a3 + t * (4 * a4 + t * 5 * a5)))
    if not ((np.abs(t) <= 1).all() and (gain < 0).all()):
        return None
    return beta + t * reach, 1 / np.sqrt(-gain / reach)


def _labelled(cuts: np.ndarray, found: dict, z: float) -> pd.DataFrame:
    """Rows of SCAN."""
    sizes, reason, chi2, beta, se = (found["n0"], found["n1"]), found["reason"], found["chi2"], found["beta"], found["se"]
    ok = np.equal(reason, None)
    out = pd.DataFrame({"threshold": cuts, "group0_label": [f"<={c:.2f}" for c in cuts], "group1_label": [f">{c:.2f}" for c in cuts], "valid_split": ok, "reason": reason})
    out["group0_n"], out["group1_n"] = sizes[0].astype(np.int64), sizes[1].astype(np.int64)
    out["split_ratio"] = np.divide(sizes[0], sizes[1], out=np.full(len(cuts), np.nan), where=sizes[1] > 0)
    p = [dist.normal_tail(b / s) if s > 0 else math.nan for b, s in zip(beta, se, strict=True)]
    out["chi2"], out["log_rank_p"] = chi2, [dist.chi2_tail(float(c), 1) if c == c else math.nan for c in chi2]
    out["hr"], out["ci_low"], out["ci_high"] = np.exp(beta), np.exp(beta - z * se), np.exp(beta + z * se)
    out["cox_p"], out["p_label"] = p, [labels.p_label(q) if fit else None for q, fit in zip(p, ok, strict=True)]
    for c in ("group0_median", "group1_median", "group0_follow_up", "group1_follow_up"):
        out[c] = found[c]
    return out


def markers(scanned: DataFrame, median: float, alpha: float = 0.05) -> DataFrame:
    """label, threshold: the one nearest the median, that of the least Cox p, and the nearest to the median of those below alpha (null where none is)."""
    labels, found = list(MARKS), _marked(scanned, median, alpha, F.col("threshold"))
    return found.unpivot([], labels, "label", "threshold")


MARKS = ("Median", "Min P-Val", "Closest to Median")


def _marked(scanned: DataFrame, median: float, alpha: float, what: Column) -> DataFrame:
    """what of the marked thresholds, a column per mark."""
    gap = F.struct(F.abs(F.col("threshold") - median), F.col("threshold"))
    sure = (F.col("cox_p") < alpha) & F.col("valid_split")
    orders = gap, F.when(F.col("valid_split"), F.struct("cox_p", "threshold")), F.when(sure, gap)
    return scanned.agg(*(F.min_by(what, order).alias(label) for label, order in zip(MARKS, orders, strict=True)))


def marked_rows(scanned: DataFrame, median: float, alpha: float = 0.05) -> DataFrame:
    """``marked_tests`` of the ``markers``, in one pass over the scan."""
    rows = _marked(scanned, median, alpha, F.struct(*scanned.columns)).select(F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("row")) for label in MARKS))).alias("mark"))
    return rows.where("mark.row is not null").select("mark.row.*", "mark.label")


def marked_tests(scanned: DataFrame, marks: DataFrame) -> DataFrame:
    """label and the scan's row of each marked threshold."""
    return scanned.join(F.broadcast(marks.where("threshold is not null")), "threshold")  # three marks


def marked_curves(df: DataFrame, covariate: str, marks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """label, group and ``km_curve`` of both sides of each marked threshold, in one plan."""
    found = sorted((r.label, r.threshold) for r in marks.where("threshold is not null").collect())
    if not found:
        raise ValueError("no threshold is marked")
    sides = [at_cutoff(df, covariate, cut).withColumn("label", F.lit(label)) for label, cut in found]
    every = sides[0]
    for one in sides[1:]:
        every = every.unionByName(one)
    keys = ["label", "group"]
    return km_curve(event_table(every, keys), keys, alpha)


def best_threshold(scanned: DataFrame) -> DataFrame:
    """The row of the least log-rank p. A least p is not a p-value: correct it for the number of thresholds."""
    return scanned.where("valid_split").orderBy("log_rank_p", "threshold").limit(1)


def at_cutoff(df: DataFrame, covariate: str, cut: float) -> DataFrame:
    """time, event, group: the sides of one threshold; a missing value is on the high side."""
    low = F.coalesce(F.col(covariate).cast("double") <= cut, F.lit(False))
    return df.select("time", "event", F.when(low, f"<={cut:.2f}").otherwise(f">{cut:.2f}").alias("group"))


CORRECTION = "method string, raw_p_value double, adjusted_p_value double, threshold double, n_thresholds_tested long, details map<string,double>"


def _valid(scanned: DataFrame) -> list:
    rows = scanned.where("valid_split").select("threshold", "log_rank_p", "group0_n", "group1_n").orderBy("threshold").collect()
    if not rows:
        raise ValueError("no valid threshold")
    return rows


def _least(scanned: DataFrame):
    """k thresholds, the best (log_rank_p, threshold), n subjects, and the least and largest share of the smaller side: one aggregate of the scan."""
    share = F.col("group0_n") / (F.col("group0_n") + F.col("group1_n"))
    folded = F.least(share, 1 - share)
    best = F.min(F.when(F.col("log_rank_p").isNotNull(), F.struct("log_rank_p", "threshold")))
    r = scanned.where("valid_split").agg(F.count("*").alias("k"), best.alias("best"), F.max(F.col("group0_n") + F.col("group1_n")).alias("n"), F.min(folded).alias("low"), F.max(folded).alias("high")).first()
    if r.best is None:
        raise ValueError("no valid threshold")
    return r


def bonferroni(scanned: DataFrame) -> tuple:
    r = _least(scanned)
    return "bonferroni", r.best.log_rank_p, min(1.0, r.best.log_rank_p * r.k), r.best.threshold, r.k, {}


def lausen_schumacher(scanned: DataFrame, least_fraction: float = 0.1) -> tuple:
    """Davies' bound on the largest standardised statistic between two group fractions, folded to the smaller side. A least p of 0 stays 0, as the bound has no value there. Without a threshold between the fractions it is an error."""
    share = F.col("group0_n") / (F.col("group0_n") + F.col("group1_n"))
    r = _least(scanned.where(share.between(least_fraction, 1 - least_fraction)))
    low, high, best = max(r.low, 1 / r.n), r.high, r.best
    p = best.log_rank_p
    b = -dist.NORMAL.inv_cdf(p / 2) if 0 < p < 1 else (0.0 if p >= 1 else math.inf)  # from the lower tail, where a small p keeps its digits
    if not math.isfinite(b):
        adjusted = p
    elif b <= 0:
        adjusted = 1.0
    else:
        density = dist.NORMAL.pdf(b)
        tail = density * b * ((1 / low - 1 / high) - (1 / (1 - high) - 1 / (1 - low))) / 2
        adjusted = max(p, min(1.0, 4 * density / b + max(0.0, tail)))
    return "lausen_schumacher", p, adjusted, best.threshold, r.k, {"b": b, "eps1": low, "eps2": high}


def permutation(df: DataFrame, covariate: str, scanned: DataFrame, replicates: int = 1000, seed: int = 42) -> tuple:
    """Share of shuffled covariates whose least log-rank p is as small. A shuffle deals the intervals' sizes to the subjects anew: a draw without replacement over the (event, time) counts. Spark deals out the replicates."""
    rows = _valid(scanned)
    cuts = np.array([r.threshold for r in rows])
    best = min(rows, key=lambda r: r.log_rank_p)
    _, d, m = interval_table(df, covariate, cuts)
    sizes, pool = m.sum(axis=1).astype(np.int64), np.concatenate([d.sum(axis=0), (m - d).sum(axis=0)]).astype(np.int64)
    observed, width = float(np.nanmax(logrank_scan(d, m))), d.shape[1]

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for i in b["id"]:
                rng, left = np.random.default_rng(seed + int(i)), pool.copy()
                drawn = np.zeros((len(sizes), len(pool)))
                for k, size in enumerate(sizes):
                    drawn[k] = left if k == len(sizes) - 1 else rng.multivariate_hypergeometric(left, size, method="marginals")
                    left = left - drawn[k].astype(np.int64)
                out.append(float(np.nanmax(logrank_scan(drawn[:, :width], drawn[:, :width] + drawn[:, width:]))))
            yield pd.DataFrame({"chi2": out})

    spark = df.sparkSession
    as_large = spark.range(replicates).repartition(min(replicates, 64)).mapInPandas(run, "chi2 double").where(F.col("chi2") >= observed - 1e-12).count()
    return "permutation", best.log_rank_p, (as_large + 1) / (replicates + 1), best.threshold, len(rows), {"replicates": float(replicates), "as_large": float(as_large)}


def compared_corrections(df: DataFrame, covariate: str, scanned: DataFrame, replicates: int = 1000, seed: int = 42, least_fraction: float = 0.1) -> DataFrame:
    """CORRECTION, a row per method."""
    return df.sparkSession.createDataFrame([bonferroni(scanned), lausen_schumacher(scanned, least_fraction), permutation(df, covariate, scanned, replicates, seed)], CORRECTION)
