"""Survival estimators, from counts by time.

Subjects enter one aggregation, to events and subjects by (group, time); its rows are bounded by the
distinct times, not by the subjects, and every window below runs over those. The result frames of
several endpoints can be computed in one plan by making the endpoint a group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import dist, labels

Z95 = dist.NORMAL.inv_cdf(0.975)
TIME_POINTS = (12.0, 24.0, 36.0, 48.0, 60.0)


class SurvivalInputError(ValueError):
    """The input is not a survival frame."""


def event_flag(c: Column) -> Column:
    """Number or text, cut to a whole number, to true for 1 and false for 0; anything else is null."""
    whole = c.cast("string").try_cast("double").try_cast("int")
    return F.when(whole == 1, True).when(whole == 0, False)


def survival_frame(df: DataFrame, time: str, event: str, group: str | None = None, lenient: bool = False) -> DataFrame:
    """time double, event boolean and, if asked, group, without rows that lack time or event.

    Unless lenient (then ``event_flag``), an event other than boolean or 0 and 1 is an error, as are negative or non-numeric times; rows that lack time or event are not looked at."""
    kinds = {f.name: f.dataType for f in df.schema}
    if missing := [c for c in (time, event, group) if c and c not in kinds]:
        raise SurvivalInputError(f"missing columns: {missing}")
    if not isinstance(kinds[time], T.NumericType):
        raise SurvivalInputError(f"{time} is not numeric")
    flag = event_flag(F.col(event)) if lenient else F.col(event).cast("boolean") if isinstance(kinds[event], (T.BooleanType, T.NumericType)) else None
    if flag is None:
        raise SurvivalInputError(f"{event} is neither boolean nor 0 and 1")
    t = F.col(time).cast("double")
    odd = F.lit(False) if lenient or isinstance(kinds[event], T.BooleanType) else ~F.col(event).isin(0, 1)
    whole = t.isNotNull() & ~F.isnan(t) & (flag.isNotNull() if lenient else F.col(event).isNotNull())
    bad = df.where(whole).agg(F.max((t < 0).cast("int")), F.max(odd.cast("int"))).first()
    if bad[0]:
        raise SurvivalInputError("negative durations")
    if bad[1]:
        raise SurvivalInputError(f"{event} has values other than 0 and 1")
    own = [F.when(~F.isnan(t), t).alias("time"), flag.alias("event")] + ([F.col(group).alias("group")] if group else [])
    return df.select(*own).where("time is not null and event is not null")


def event_table(surv: DataFrame, keys: list[str] = (), reverse: bool = False) -> DataFrame:
    """keys, time, d events, m subjects. reverse: censorings count as events."""
    event = ~F.col("event") if reverse else F.col("event")
    return surv.groupBy(*keys, "time").agg(F.sum(event.cast("long")).alias("d"), F.count("*").alias("m"))


def _over(keys, start, end, order: str = "time") -> Window:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(order).rowsBetween(start, end)


def km_curve(table: DataFrame, keys: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """keys, time, d, m, at_risk, s, variance term, ci_low, ci_high. Limits are of log(-log s); where s is 1 they are 1, where it is 0 they are 0."""
    keys = list(keys)
    z = dist.NORMAL.inv_cdf(1 - alpha / 2)
    before, after = _over(keys, Window.unboundedPreceding, 0), _over(keys, 0, Window.unboundedFollowing)
    out = table.withColumn("at_risk", F.sum("m").over(after))
    n, d = F.col("at_risk"), F.col("d")
    out = out.withColumn("s", F.product(1 - d / n).over(before)).withColumn("v", F.sum(F.when(n > d, d / (n * (n - d))).otherwise(0.0)).over(before))
    inner = F.col("s") > 0
    width = F.when(inner & (F.col("s") < 1), z * F.sqrt("v") / F.abs(F.log("s")))
    return (
        out.withColumn("ci_low", F.when(F.col("s") >= 1, 1.0).when(~inner, 0.0).otherwise(F.pow("s", F.exp(width))))
        .withColumn("ci_high", F.when(F.col("s") >= 1, 1.0).when(~inner, 0.0).otherwise(F.pow("s", F.exp(-width))))
    )


def medians(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, median, ci_low, ci_high: the first times at which s and its limits are 0.5 or less; infinite where they never are."""

    def first(c: str) -> Column:
        return F.coalesce(F.min(F.when(F.col(c) <= 0.5, F.col("time"))), F.lit(math.inf))

    return curve.groupBy(*keys).agg(first("s").alias("median"), first("ci_low").alias("ci_low"), first("ci_high").alias("ci_high"))


def survival_at(curve: DataFrame, times: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, t, s, ci_low, ci_high: the curve's last step at or before each t, 1 before the first; NaN beyond the last time."""
    at = curve.withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in times))))
    due = F.col("time") <= F.col("t")

    def last(c: str) -> Column:
        return F.when(F.max("time") < F.first("t"), F.lit(math.nan)).otherwise(F.coalesce(F.max_by(c, F.when(due, F.col("time"))), F.lit(1.0))).alias(c)

    return at.groupBy(*keys, "t").agg(last("s"), last("ci_low"), last("ci_high"))


def rmst(curve: DataFrame, taus: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, tau, rmst: the area under the curve up to tau; the last step extends beyond the last time."""
    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("time")
    steps = curve.select(*keys, "time", "s", F.lead("time").over(w).alias("next"), F.row_number().over(w).alias("k"))
    steps = steps.withColumn("tau", F.explode(F.array(*(F.lit(float(t)) for t in taus))))
    tau = F.col("tau")
    width = F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("next"), tau), tau) - F.col("time"))
    head = F.when(F.col("k") == 1, F.least(F.col("time"), tau)).otherwise(0.0)
    return steps.groupBy(*keys, "tau").agg(F.sum(F.col("s") * width + head).alias("rmst"))


def rmst_bootstrap(surv: DataFrame, tau: float, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> dict[str, float]:
    """Mean and percentile limits of the area over resamples. Resampling subjects is a multinomial draw over the (time, event) counts, made from seed + i; Spark deals out the replicates."""
    rows = surv.groupBy("time", "event").agg(F.count("*").alias("n")).orderBy("time", "event").collect()  # distinct times, twice at most
    time, event, n = np.array([r.time for r in rows]), np.array([r.event for r in rows]), np.array([r.n for r in rows])
    total = int(n.sum())

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"rmst": [_resampled_area(np.random.default_rng(seed + int(i)).multinomial(total, n / total), time, event, tau) for i in b["id"]]})

    spark = surv.sparkSession
    areas = spark.range(replicates).repartition(min(replicates, 64)).mapInPandas(run, "rmst double")
    tail = (1 - level) / 2
    r = areas.agg(F.avg("rmst"), F.percentile("rmst", F.array(F.lit(tail), F.lit(1 - tail)))).first()
    return {"mean": r[0], "ci_low": r[1][0], "ci_high": r[1][1]}


def _resampled_area(counts: np.ndarray, time: np.ndarray, event: np.ndarray, tau: float) -> float:
    times, at = np.unique(time, return_inverse=True)
    m, d = np.bincount(at, weights=counts), np.bincount(at, weights=counts * event)
    risk = np.cumsum(m[::-1])[::-1]
    s = np.cumprod(1 - np.divide(d, risk, out=np.zeros(len(d)), where=risk > 0))
    edges = np.minimum(np.concatenate([[0.0], times, [max(tau, times[-1])]]), tau)
    return float(np.dot(np.concatenate([[1.0], s]), np.diff(edges)))


def group_counts(surv: DataFrame, keys: list[str] = ("group",)) -> DataFrame:
    """keys, n, events, censored, max_time."""
    e = F.sum(F.col("event").cast("long"))
    return surv.groupBy(*keys).agg(F.count("*").alias("n"), e.alias("events"), (F.count("*") - e).alias("censored"), F.max("time").alias("max_time"))


def split_validity(surv: DataFrame) -> DataFrame:
    """group, n, events, censored, reason: null for a group fit to compare."""
    reason = F.when(F.col("n") <= 1, "group_size_1").when(F.col("events") == 0, "no_events").when(F.col("censored") == 0, "no_censoring")
    return group_counts(surv).withColumn("reason", reason)


def baseline(counts: dict[str, int], which: str = "largest") -> list[str]:
    """Labels, the baseline first. counts in the order in which groups count as first seen (ours: by label).

    Of equal groups, largest takes the first; smallest the second of two, and the first of more. A group called like a rule has to be chosen by the rule."""
    names = list(counts)
    if which == "largest":
        chosen = max(names, key=counts.get)
    elif which == "smallest":
        chosen = min(reversed(names) if len(names) == 2 else names, key=counts.get)
    elif which in ("first", "second") and len(names) == 2:
        chosen = names[which == "second"]
    elif which in names:
        chosen = which
    else:
        raise ValueError(f"no baseline {which!r} among {names}")
    return [chosen, *(n for n in names if n != chosen)]


def risk_table(surv: DataFrame, groups: list, keys: list[str] = ()) -> DataFrame:
    """keys, time, d, n and for group i its d<i>, n<i>: events at each event time, and subjects at risk."""
    own = [c for i, g in enumerate(groups) for c in (F.sum(F.when((F.col("group") == g) & F.col("event"), 1).otherwise(0)).alias(f"d{i}"), F.sum(F.when(F.col("group") == g, 1).otherwise(0)).alias(f"m{i}"))]
    table = surv.where(F.col("group").isin(list(groups))).groupBy(*keys, "time").agg(F.sum(F.col("event").cast("int")).alias("d"), F.count("*").alias("m"), *own)
    after = _over(list(keys), 0, Window.unboundedFollowing)
    out = table.withColumn("n", F.sum("m").over(after))
    for i in range(len(groups)):
        out = out.withColumn(f"n{i}", F.sum(f"m{i}").over(after))
    return out.where("d > 0")


def logrank_pair(surv: DataFrame, a, b) -> DataFrame:
    """observed, expected, variance and chi2 of group a against group b, all in one plan."""
    t = risk_table(surv, [a, b])
    d, n, n1 = F.col("d"), F.col("n"), F.col("n0")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = t.agg(F.sum("d0").cast("double").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    return out.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))


def logrank_pairwise(surv: DataFrame, first, others: list) -> DataFrame:
    """group, observed, expected, variance, chi2 of each other group against the first, in one pass: subjects of the first count once for each pair."""
    pairs = F.when(F.col("group") == first, F.array(*map(F.lit, others))).otherwise(F.array(F.col("group")))
    rows = surv.where(F.col("group").isin([first, *others])).groupBy("group", "time").agg(F.sum(F.col("event").cast("long")).alias("d"), F.count("*").alias("m"))
    rows = rows.withColumn("pair", F.explode(pairs)).withColumn("own", (F.col("group") != first).cast("long"))
    t = rows.groupBy("pair", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"), F.sum(F.col("d") * F.col("own")).alias("d1"), F.sum(F.col("m") * F.col("own")).alias("m1"))
    after = _over(["pair"], 0, Window.unboundedFollowing)
    t = t.withColumn("n", F.sum("m").over(after)).withColumn("n1", F.sum("m1").over(after)).where("d > 0")
    d, n, n1 = F.col("d"), F.col("n"), F.col("n1")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    out = t.groupBy(F.col("pair").alias("group")).agg(F.sum("d1").cast("double").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    return out.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))


TESTS = (
    "group string, baseline string, n long, baseline_n long, split_ratio double, chi2 double, p_value double, p_label string, median double, median_ci_low double, median_ci_high double, "
    "baseline_median double, baseline_median_ci_low double, baseline_median_ci_high double, follow_up double, baseline_follow_up double, split_valid boolean, invalid_reason string"
)


def logrank_tests(surv: DataFrame, first, others: list) -> DataFrame:
    """TESTS, a row for each other group against the first: sizes, log-rank test, medians with limits and median follow-up of both. A group that is unfit to compare (``split_validity``) keeps its row, without a test."""
    own = surv.where(F.col("group").isin([first, *others]))
    valid = {r.group: r for r in split_validity(own).collect()}  # a row per group, as below
    median = {r.group: r for r in medians(km_curve(event_table(own, ["group"]), ["group"]), ["group"]).collect()}
    follow = {r.group: r.median for r in medians(km_curve(event_table(own, ["group"], reverse=True), ["group"]), ["group"]).collect()}
    chi2 = {r.group: r.chi2 for r in logrank_pairwise(own, first, others).collect()}
    rows = []
    for g in others:
        reason = next((valid[x].reason if x in valid else "group_size_1" for x in (first, g) if x not in valid or valid[x].reason), None)
        size, base = (valid[x].n if x in valid else 0 for x in (g, first))
        x = chi2.get(g) if reason is None else None
        p = dist.chi2_tail(x, 1) if x is not None else None
        limits = [median[k][c] if k in median else None for k in (g, first) for c in ("median", "ci_low", "ci_high")]
        rows.append((str(g), str(first), size, base, base / size if size else None, x, p, labels.p_label(p) if p is not None else None, *limits, follow.get(g), follow.get(first), reason is None, reason))
    return surv.sparkSession.createDataFrame(rows, TESTS)


def combined_tests(surv: DataFrame, groups: list) -> DataFrame:
    """For each group but the first (the baseline): ``logrank_tests``, hazard ratio with limits and p (cox_ prefix), and the test of all groups together (omnibus_ prefix)."""
    cox = cox_hazards(surv, groups).select("group", F.col("hr"), "ci_low", "ci_high", F.col("p_value").alias("cox_p"), F.col("p_label").alias("cox_p_label"), "interpretation")
    every = logrank_omnibus(surv, groups)
    out = logrank_tests(surv, groups[0], groups[1:]).join(cox, "group")
    return out.withColumns({f"omnibus_{k}": F.lit(v) for k, v in every.items()})


def _matrices(surv: DataFrame, groups: list) -> tuple[np.ndarray, np.ndarray]:
    """Events and risk sets of each group at each event time; the rows are bounded by the distinct times."""
    rows = risk_table(surv, groups).orderBy("time").collect()
    k = range(len(groups))
    return np.array([[r[f"d{i}"] for i in k] for r in rows], float).reshape(-1, len(groups)), np.array([[r[f"n{i}"] for i in k] for r in rows], float).reshape(-1, len(groups))


def logrank_omnibus(surv: DataFrame, groups: list) -> dict[str, float]:
    """chi2, df and p of all groups together."""
    d, n = _matrices(surv, groups)
    dt, nt = d.sum(axis=1), n.sum(axis=1)
    share = n / nt[:, None]
    z = (d - dt[:, None] * share).sum(axis=0)
    factor = np.where(nt > 1, dt * (nt - dt) / np.maximum(nt - 1, 1), 0.0)
    v = np.diag((factor[:, None] * share).sum(axis=0)) - (share * factor[:, None]).T @ share
    chi2 = float(z[1:] @ np.linalg.pinv(v[1:, 1:]) @ z[1:])
    return {"chi2": chi2, "df": len(groups) - 1, "p_value": dist.chi2_tail(chi2, len(groups) - 1)}


NEAR = 16


def tied_sums(x: np.ndarray, d: np.ndarray, logs: bool = True) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Sums of log(x + j) (if asked), 1 / (x + j) and 1 / (x + j)**2 over j = 0 .. d - 1, elementwise, for x >= 1.

    By the asymptotic series of log-gamma and its derivatives about half-integers, so time and memory do not depend on d. Where x is small its first terms are added one by one and the series starts behind them."""
    near = (x < NEAR) & (d > 0)
    low, short = x[near], d[near]
    start = np.where(near, x + np.minimum(NEAR, d), x) - 0.5
    more = np.where(near, np.maximum(d - NEAR, 0.0), d)
    end = start + more
    i, k = 1 / (start * start), 1 / (end * end)
    grown = np.log1p(more / start)

    def first_tail(i):
        return i * (1 / 24 - i * (7 / 960 - i * (31 / 8064 - i * (127 / 30720))))

    def second_tail(z, i):
        return i / z * (1 / 12 - i * (7 / 240 - i * (31 / 1344 - i * (127 / 3840))))

    def log_tail(z, i):
        return (-1 / 24 + i * (7 / 2880 - i * (31 / 40320 - i * (127 / 215040)))) / z

    first = grown + first_tail(k) - first_tail(i)
    second = more / (start * end) - second_tail(start, i) + second_tail(end, k)
    total = start * grown + more * np.log(end) - more + log_tail(end, k) - log_tail(start, i) if logs else None
    if len(low):
        sums = np.zeros((3, len(low)))
        for j in range(int(min(NEAR, short.max()))):
            term, due = low + j, j < short
            sums[1] += np.where(due, 1 / term, 0.0)
            sums[2] += np.where(due, 1 / (term * term), 0.0)
            if logs:
                sums[0] += np.where(due, np.log(term), 0.0)
        first[near] += sums[1]
        second[near] += sums[2]
        if logs:
            total[near] += sums[0]
    return total, first, second


def cox_fit(d: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Log hazard ratios of groups 1.. against group 0, their covariance, the log-likelihood and whether it converged. Efron's treatment of ties, in closed form: a row per distinct event time, however many events share it."""
    d, n = np.asarray(d, float), np.asarray(n, float)
    ties = d.sum(axis=1)
    d, n, ties = d[ties > 0], n[ties > 0], ties[ties > 0]
    k = d.shape[1] - 1

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        e = np.exp(np.concatenate([[0.0], beta]))
        a, b = n @ e, d @ e  # all at risk, and those with events; the l-th tied event sees a - b * l / ties
        logs, first, second = tied_sums(np.maximum(ties * a / b - ties + 1, 1.0), ties)
        scale = ties / b
        fixed = d[:, 1:] * e[1:] / b[:, None]
        moved = n[:, 1:] * e[1:] - fixed * a[:, None]
        p = ties[:, None] * fixed + moved * (scale * first)[:, None]
        cross = (fixed * (scale * first)[:, None]).T @ moved
        pp = (fixed * ties[:, None]).T @ fixed + cross + cross.T + (moved * (scale * scale * second)[:, None]).T @ moved
        value = float(d[:, 1:].sum(axis=0) @ beta - (logs - ties * np.log(scale)).sum())
        return value, d[:, 1:].sum(axis=0) - p.sum(axis=0), np.diag(p.sum(axis=0)) - pp

    beta = np.zeros(k)
    value, gradient, information = at(beta)
    for _ in range(steps):
        step, slack = np.linalg.pinv(information) @ gradient, 1e-12 * max(1.0, abs(value))
        while True:
            new = at(beta + step)
            if new[0] >= value - slack or np.abs(step).max() < 1e-12:
                break
            step /= 2
        beta, gain = beta + step, new[0] - value
        value, gradient, information = new
        if abs(gain) < max(1e-10, slack) and np.abs(step).max() < 1e-8:
            return beta, np.linalg.pinv(information), value, True
        if np.abs(beta).max() > 30:
            break
    return beta, np.linalg.pinv(information), value, False


def cox_cells(e: np.ndarray, d1: np.ndarray, n1: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums over a time's tied events of the second side's share of the risk, and of its square, at the hazard ratio e; elementwise, for times with events."""
    risk, events = n + n1 * (e - 1), d + d1 * (e - 1)
    scale = d / events
    _, first, second = tied_sums(np.maximum(scale * risk - d + 1, 1.0), np.broadcast_to(d, risk.shape), logs=False)
    fixed = d1 * e / events
    moved = (n1 * e - fixed * risk) * scale
    kept, shifted = d * fixed, moved * first
    return kept + shifted, fixed * (kept + 2 * shifted) + moved * moved * second


def cox_many(d1: np.ndarray, n1: np.ndarray, d: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """``cox_fit`` of many splits of the same subjects at once: log hazard ratio of the second side against the first, and its standard error.

    d, n: events and subjects at risk by event time, of all subjects; d1, n1: of the second side, a row per split. Time and memory are splits x event times for each step."""
    due = d > 0
    d1, n1, d, n = d1[:, due], n1[:, due], d[due], n[due]
    own, beta, open_ = d1.sum(axis=1), np.zeros(len(d1)), np.arange(len(d1))

    def at(b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and information."""
        some_d, some_n = (d1, n1) if len(rows) == len(d1) else (d1[rows], n1[rows])
        p, squares = (c.sum(axis=1) for c in cox_cells(np.exp(b)[:, None], some_d, some_n, d, n))
        return own[rows] - p, p - squares

    gradient, information = at(beta, open_)
    spread = information.copy()
    for _ in range(steps):
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(information > 0, gradient / information, 0.0)
        tried = at(beta[open_] + step, open_)
        for _ in range(60):  # the likelihood is concave, so a shorter step always lessens the gradient
            worse = np.flatnonzero((np.abs(tried[0]) > np.abs(gradient) + 1e-10 * own[open_]) & (np.abs(step) >= 1e-8))
            if not len(worse):
                break
            step[worse] /= 2
            for new, old in zip(at(beta[open_[worse]] + step[worse], open_[worse]), tried, strict=True):
                old[worse] = new
        beta[open_] += step
        spread[open_] = tried[1]
        go = (np.abs(step) >= 1e-8) & (np.abs(beta[open_]) <= 30)
        if not go.any():
            break
        open_, gradient, information = open_[go], tried[0][go], tried[1][go]
    with np.errstate(divide="ignore", invalid="ignore"):
        return beta, np.where(spread > 0, 1 / np.sqrt(spread), 0.0)


def cox_hazards(surv: DataFrame, groups: list, alpha: float = 0.05) -> DataFrame:
    """group, baseline, hr, ci_low, ci_high, p_value, p_label, interpretation, split_valid, invalid_reason, a row for each group but the first (the baseline); no estimates where a group is unfit."""
    spark = surv.sparkSession
    reasons = {r.group: r.reason for r in split_validity(surv.where(F.col("group").isin(list(groups)))).collect()}
    schema = "group string, baseline string, hr double, ci_low double, ci_high double, p_value double, p_label string, interpretation string, split_valid boolean, invalid_reason string"
    unfit = next((reasons.get(g, "group_size_1") for g in groups if reasons.get(g, "group_size_1")), None)
    if unfit:
        return spark.createDataFrame([(str(g), str(groups[0]), None, None, None, None, None, None, False, unfit) for g in groups[1:]], schema)
    beta, cov, _, _ = cox_fit(*_matrices(surv, groups))
    z, rows = dist.NORMAL.inv_cdf(1 - alpha / 2), []
    for g, b, se in zip(groups[1:], beta, np.sqrt(np.diag(cov)), strict=True):
        p = dist.normal_tail(b / se) if se > 0 else math.nan
        hr = float(np.exp(b))
        rows.append((str(g), str(groups[0]), hr, float(np.exp(b - z * se)), float(np.exp(b + z * se)), p, labels.p_label(p), labels.hazard_text(hr, str(groups[0]), str(g)), True, None))
    return spark.createDataFrame(rows, schema)


def endpoint_summary(frames: dict[str, DataFrame], times: tuple = TIME_POINTS) -> DataFrame:
    """A row per endpoint: size, medians, follow-up, survival and area at the time points, with dotted names. All endpoints share one plan."""
    surv = None
    for name, frame in frames.items():
        own = frame.select(F.lit(name).alias("surv_label"), "time", "event")
        surv = own if surv is None else surv.unionByName(own)
    key = ["surv_label"]
    curve = km_curve(event_table(surv, key), key)
    follow = medians(km_curve(event_table(surv, key, reverse=True), key), key)
    out = group_counts(surv, key)
    for df, prefix in ((medians(curve, key), "median_survival"), (follow, "median_follow_up")):
        out = out.join(df.select("surv_label", *(F.col(c).alias(f"{prefix}.{c}") for c in ("median", "ci_low", "ci_high"))), "surv_label")
    for df, t, value, prefix in ((survival_at(curve, list(times), key), "t", "s", "survival"), (rmst(curve, list(times), key), "tau", "rmst", "rmst")):
        out = out.join(df.groupBy("surv_label").agg(*(F.max(F.when(F.col(t) == x, F.col(value))).alias(f"{prefix}.{x:g}") for x in times)), "surv_label")
    return out
