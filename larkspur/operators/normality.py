"""Normality tests and diagnostics, for any number of columns at once.

Moments, ties and outlier counts are aggregates; the statistics that compare ranks with a normal
curve come from distinct values with running counts. Only a few numbers per column reach the driver,
where p-values are computed, except for Shapiro-Wilk: it needs the ordered values, which are read as
distinct values with counts; beyond ``SHAPIRO_MOST`` observations its sums over all ranks are made in
Spark instead, with the same result (its p-value is flagged as unreliable beyond 5000).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import dist
from larkspur.operators.describe import as_number, frequencies, numeric_columns
from larkspur.operators.ranks import quantile, running

TESTS = ("shapiro", "ks", "anderson", "dagostino", "jb", "lilliefors")
TITLES = {"shapiro": "Shapiro-Wilk", "ks": "Kolmogorov-Smirnov", "anderson": "Anderson-Darling", "dagostino": "D'Agostino-Pearson", "jb": "Jarque-Bera", "lilliefors": "Lilliefors"}
SIZES = {"shapiro": "<=50", "ks": ">50 (prefer 'lilliefors' instead)", "anderson": ">20", "dagostino": ">50", "jb": "large n (asymptotic test)", "lilliefors": ">50"}
PURPOSES = {
    "general": "A strong test against most departures; beyond 5000 values its p-value is not accurate and Lilliefors takes its place.",
    "tails": "It gives the tails the most weight.",
    "parametric_test": "The usual check before a t-test or an analysis of variance, which tolerate mild departures in large samples.",
    "symmetry_only": "It is made of skewness and kurtosis and so speaks of asymmetry directly.",
}
SHAPIRO_RELIABLE, SHAPIRO_MOST, RANKS, TIES_MOST = 5000, 50_000, 4096, 0.10
REPORT = "name string, test string, test_type string, stat double, p double, normal boolean, recommended_sample_size string, p_value_reliable boolean"


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, n, n_unique, mean, std, skewness, kurtosis_excess (population), tie_fraction, ks_family_reliable."""
    freq = frequencies(df, columns or numeric_columns(df), lambda c: as_number(df, c)).where("v is not null")
    base = freq.groupBy("name").agg(F.sum("c").alias("n"), F.count("*").alias("n_unique"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("mean"))
    d = F.col("v") - F.col("mean")
    power = freq.join(F.broadcast(base.select("name", "mean")), "name").groupBy("name").agg(*(F.sum(F.col("c") * d**k).alias(f"m{k}") for k in (2, 3, 4)))
    n = F.col("n")
    out = base.join(power, "name").withColumn("std", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))))
    some = F.col("m2") > 0
    out = out.withColumn("skewness", F.when(some, F.col("m3") / n / F.pow(F.col("m2") / n, 1.5))).withColumn("kurtosis_excess", F.when(some, F.col("m4") / n / F.pow(F.col("m2") / n, 2) - 3))
    ties = 1 - F.col("n_unique") / n
    return out.withColumn("tie_fraction", ties).withColumn("ks_family_reliable", ties <= TIES_MOST).select("name", "n", "n_unique", "mean", "std", "skewness", "kurtosis_excess", "tie_fraction", "ks_family_reliable")


def jarque_bera() -> Column:
    return F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis_excess") ** 2 / 4)


def normal_cdf(x: Column) -> Column:
    """Of a standard normal, by a continued fraction in the tails and a power series within; both to double precision."""
    z = F.abs(x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")), lambda a: a["s"])
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(40))), z, lambda a, k: z + k / a)
    upper = F.when(z < 3, 0.5 - density * series).otherwise(density / fraction)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def rank_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, n, ks (distance to the normal curve of the sample's mean and standard deviation, which Lilliefors shares) and a2 (Anderson-Darling)."""
    columns = columns or numeric_columns(df)
    stats = moments(df, columns).select("name", "n", "mean", "std")
    freq = frequencies(df, columns, lambda c: as_number(df, c)).where("v is not null")
    rows = running(freq, "name", "v", "c").join(F.broadcast(stats), "name").where("std > 0")
    rows = rows.withColumn("f", normal_cdf((F.col("v") - F.col("mean")) / F.col("std"))).withColumn("g", normal_cdf((F.col("mean") - F.col("v")) / F.col("std")))
    n, c, cum, f = F.col("n"), F.col("c"), F.col("cum"), F.col("f")
    # Of c equal values at ranks cum - c + 1 to cum: the sums of (2 i - 1) and of (2 (n + 1 - i) - 1).
    up, down = cum**2 - (cum - c) ** 2, (n - cum + c) ** 2 - (n - cum) ** 2
    tiny = F.lit(1e-300)
    a2 = -n.cast("double") - F.col("w") / n
    out = rows.withColumn("term", up * F.log(F.greatest(f, tiny)) + down * F.log(F.greatest(F.col("g"), tiny)))
    out = out.groupBy("name", "n").agg(F.max(F.greatest(cum / n - f, f - (cum - c) / n)).alias("ks"), F.sum("term").alias("w"))
    return out.select("name", "n", "ks", a2.alias("a2"))


def ordered_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, values, counts: each column's order statistics. A row per column, for columns of few values."""
    freq = frequencies(df, columns, lambda c: as_number(df, c)).where("v is not null")
    return freq.groupBy("name").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("x")).select("name", "n", F.col("x.v").alias("values"), F.col("x.c").alias("counts"))


def shapiro_sums(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """name, n, squares, cross, spread, x1, x2, y2, y1: what Shapiro-Wilk needs of all values, as deviations from the mean; x1, x2 are the least and y2, y1 the largest. Ties are cut into at most ``RANKS`` ranks and dealt anew."""
    freq = frequencies(df, columns, lambda c: as_number(df, c)).where("v is not null")
    rows = running(freq, "name", "v", "c").join(F.broadcast(stats.select("name", "n", "mean")), "name")
    rows = rows.select("name", "n", (F.col("v") - F.col("mean")).alias("d"), "cum", F.explode(F.sequence(F.col("cum") - F.col("c"), F.col("cum") - 1, F.lit(RANKS).cast("long"))).alias("first"))
    rows = rows.select("name", "n", "d", "first", F.least(F.col("first") + RANKS, F.col("cum")).alias("last")).repartition("name", "first")

    def scored(batches):
        for b in batches:
            sums = []
            for n, first, last in zip(*(b.column(k).to_pylist() for k in (1, 3, 4)), strict=True):
                m = [dist.NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(first + 1, last + 1)]
                sums.append((math.fsum(m), math.fsum(x * x for x in m)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in sums], pa.float64()), pa.array([x for _, x in sums], pa.float64())], [*b.schema.names, "m", "mm"])

    rows = rows.mapInArrow(scored, "name string, n long, d double, first long, last long, m double, mm double")
    n, d, first, last = F.col("n"), F.col("d"), F.col("first"), F.col("last")
    at = lambda k: F.max(F.when((first < k) & (last >= k), d))
    return rows.groupBy("name", "n").agg(F.sum("mm").alias("squares"), F.sum(F.col("m") * d).alias("cross"), F.sum((last - first) * d * d).alias("spread"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n - 1).alias("y2"), at(n).alias("y1"))


def report(df: DataFrame, columns: list[str] | None = None, tests: tuple = TESTS, alpha: float = 0.05) -> DataFrame:
    """REPORT, a row per column and test; columns of fewer than 3 values or without spread have null results."""
    if unknown := set(tests) - set(TESTS):
        raise ValueError(f"unknown tests: {sorted(unknown)}")
    columns = columns or numeric_columns(df)
    known = moments(df, columns)
    stats = {r.name: r for r in known.collect()}  # a row per column, here and below
    ranks = {r.name: r for r in rank_statistics(df, columns).collect()} if {"ks", "anderson", "lilliefors"} & set(tests) else {}
    large = [c for c in columns if c in stats and stats[c].n > SHAPIRO_MOST]
    few = [c for c in columns if c not in large]
    values = {r.name: r for r in ordered_values(df, few).collect()} if "shapiro" in tests and few else {}
    summed = {r.name: r for r in shapiro_sums(df, large, known).collect()} if "shapiro" in tests and large else {}
    rows = []
    for c in columns:
        s = stats.get(c)
        fit = s is not None and s.n >= 3 and s.std
        for test in tests:
            stat = p = None
            if fit and test == "shapiro" and c in summed:
                x = summed[c]
                stat, p = dist.shapiro_wilk_of_sums(x.n, x.squares, x.cross, (x.x1, x.x2, x.y2, x.y1), x.spread)
            elif fit and test == "shapiro":
                stat, p = dist.shapiro_wilk(np.array(values[c]["values"]), np.array(values[c]["counts"]))
            elif fit and test in ("ks", "lilliefors"):
                stat = ranks[c].ks
                p = dist.kolmogorov_tail(stat, s.n) if test == "ks" else dist.lilliefors_tail(stat, s.n)
            elif fit and test == "anderson":
                stat = ranks[c].a2
                p = dist.anderson_tail(stat, s.n)
            elif fit and test == "dagostino" and s.n >= 8:
                stat = dist.skew_z(s.skewness, s.n) ** 2 + dist.kurtosis_z(s.kurtosis_excess, s.n) ** 2
                p = math.exp(-stat / 2)
            elif fit and test == "jb":
                stat = s.n / 6 * (s.skewness**2 + s.kurtosis_excess**2 / 4)
                p = math.exp(-stat / 2)
            rows.append((c, test, TITLES[test], None if stat is None else float(stat), None if p is None else float(p), None if p is None else p > alpha, SIZES[test], test != "shapiro" or s is None or s.n <= SHAPIRO_RELIABLE))
    return df.sparkSession.createDataFrame(rows, REPORT)


def default_test(n: int, ks_family_reliable: bool) -> str:
    return "shapiro" if n <= SHAPIRO_RELIABLE else "lilliefors" if ks_family_reliable else "anderson"


def recommended_tests(n: int) -> list[str]:
    out = ["shapiro"] if n <= 50 else []
    out += ["anderson"] if n > 20 else []
    out += ["dagostino", "lilliefors"] if n > 50 else []
    return [*(out or ["shapiro"]), "jb"]


def recommendation(purpose: str, n: int, tie_fraction: float = 0.0) -> tuple[str, str]:
    """Test and reason for a purpose."""
    if purpose not in PURPOSES:
        raise ValueError(f"purpose must be one of {sorted(PURPOSES)}")
    test = {"general": "shapiro" if n <= SHAPIRO_RELIABLE else "lilliefors", "tails": "anderson", "parametric_test": "shapiro", "symmetry_only": "dagostino"}[purpose]
    caution = f" Caution: {tie_fraction:.1%} of the values are ties, which this test does not bear." if test == "lilliefors" and tie_fraction > TIES_MOST else ""
    return test, PURPOSES[purpose] + caution


def power_regime(n: Column) -> Column:
    return F.when(n < 20, "low power").when(n <= 300, "moderate power").otherwise("high power / oversensitive")


def skew_text(s: Column) -> Column:
    size = F.when(F.abs(s) < 0.5, "approximately symmetric").when(F.abs(s) < 1, "moderately skewed").otherwise("highly skewed")
    return F.concat(size, F.when(s > 0, " (right/positive)").when(s < 0, " (left/negative)").otherwise(""))


def kurtosis_text(k: Column) -> Column:
    return F.when(F.abs(k) < 0.5, "approximately normal tail weight (mesokurtic)").when(k > 0, "heavier tails than normal (leptokurtic)").otherwise("lighter tails than normal (platykurtic)")


def shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return moments(df, columns).select("name", "n", "skewness", "kurtosis_excess", skew_text(F.col("skewness")).alias("skew_interpretation"), kurtosis_text(F.col("kurtosis_excess")).alias("kurtosis_interpretation"), power_regime(F.col("n")).alias("power_regime"))


def consensus(reported: DataFrame, alpha: float | None = None) -> DataFrame:
    """name, votes_normal, votes_total, consensus_normal, unanimous."""
    vote = F.col("normal") if alpha is None else F.col("p") > alpha
    votes, total = F.sum(F.coalesce(vote, F.lit(False)).cast("long")), F.count("*")
    return reported.groupBy("name").agg(votes.alias("votes_normal"), total.alias("votes_total")).withColumn("consensus_normal", F.col("votes_normal") > F.col("votes_total") / 2).withColumn("unanimous", F.col("votes_normal").isin(0) | (F.col("votes_normal") == F.col("votes_total")))


def sensitivity(reported: DataFrame, alphas: tuple = (0.01, 0.05, 0.10)) -> DataFrame:
    """Whether each test calls a column normal at each alpha."""
    return reported.select("name", "test", *((F.col("p") > a).alias(f"normal_at_alpha={a}") for a in alphas))


def effect_size(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, one_minus_w and texts, with the shape: how far from normal, whatever the sample size."""
    w = report(df, columns, ("shapiro",)).select("name", (1 - F.col("stat")).alias("one_minus_w"))
    x = F.col("one_minus_w")
    text = F.when(x < 0.02, "negligible deviation from normal").when(x < 0.05, "small deviation from normal").when(x < 0.15, "moderate deviation from normal").otherwise("large deviation from normal")
    hidden = (x >= 0.15) & (F.abs("skewness") < 0.5) & (F.abs("kurtosis_excess") < 0.5)
    out = w.join(shape(df, columns), "name").withColumn("one_minus_w_interpretation", text)
    overall = F.when(hidden, F.concat(text, F.lit("; neither skewed nor heavy-tailed, so the overall shape departs (several modes?)"))).otherwise(F.concat(text, F.format_string(" (1-W=%.3f); ", x), F.col("skew_interpretation"), F.lit("; "), F.col("kurtosis_interpretation"), F.lit(".")))
    return out.withColumn("overall_interpretation", overall)


def outliers(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """name, method, low, high, n_outliers, outlier_fraction, computable: values beyond the quartile fences (1.5), 3 standard deviations, or a modified z-score of 3.5. The values themselves: ``outlier_values``."""
    fences = outlier_fences(df, columns, method, threshold)
    freq = frequencies(df, columns or numeric_columns(df), lambda c: as_number(df, c)).where("v is not null").join(F.broadcast(fences), "name")
    beyond = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    out = freq.groupBy("name", "low", "high", "computable").agg(F.sum(F.when(beyond & F.col("computable"), F.col("c")).otherwise(0)).alias("n_outliers"), F.sum("c").alias("n"))
    return out.select("name", F.lit(method).alias("method"), "low", "high", "n_outliers", (F.col("n_outliers") / F.col("n")).alias("outlier_fraction"), "computable")


def outlier_fences(df: DataFrame, columns: list[str] | None, method: str, threshold: float | None) -> DataFrame:
    """name, low, high, computable; without spread there is nothing to measure by."""
    columns = columns or numeric_columns(df)
    freq = frequencies(df, columns, lambda c: as_number(df, c)).where("v is not null")

    def quantiles(freq: DataFrame, *qs: float) -> DataFrame:
        n = freq.groupBy("name").agg(F.sum("c").alias("n"))
        return running(freq, "name", "v", "c").join(F.broadcast(n), "name").groupBy("name").agg(*(quantile(q, F.col("n"), F.col("v"), F.col("cum")).alias(f"q{i}") for i, q in enumerate(qs)))

    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        reach = k * (F.col("q1") - F.col("q0"))
        return quantiles(freq, 0.25, 0.75).select("name", (F.col("q0") - reach).alias("low"), (F.col("q1") + reach).alias("high"), F.lit(True).alias("computable"))
    if method == "zscore":
        k, m = 3.0 if threshold is None else threshold, moments(df, columns)
        return m.select("name", (F.col("mean") - k * F.col("std")).alias("low"), (F.col("mean") + k * F.col("std")).alias("high"), F.coalesce(F.col("std") > 0, F.lit(False)).alias("computable"))
    if method == "modified_zscore":
        k = 3.5 if threshold is None else threshold
        mid = quantiles(freq, 0.5).withColumnRenamed("q0", "median")
        gaps = freq.join(F.broadcast(mid), "name").groupBy("name", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("c").alias("c"))
        reach = k * F.col("q0") / 0.6745
        return mid.join(quantiles(gaps, 0.5), "name").select("name", (F.col("median") - reach).alias("low"), (F.col("median") + reach).alias("high"), (F.col("q0") > 0).alias("computable"))
    raise ValueError("method must be iqr, zscore or modified_zscore")


def outlier_values(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """name, v, c: the outlying values with their counts."""
    fences = outlier_fences(df, columns, method, threshold).where("computable")
    freq = frequencies(df, columns or numeric_columns(df), lambda c: as_number(df, c)).where("v is not null")
    return freq.join(F.broadcast(fences), "name").where("v < low or v > high").select("name", "v", "c")


def diagnostics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per numerical column: sizes, ties, outliers, shape, the recommended test before a parametric one, and its result."""
    columns = columns or numeric_columns(df)
    base = moments(df, columns).withColumn("power.regime", power_regime(F.col("n")))
    out = outliers(df, columns).select("name", F.col("n_outliers").alias("outliers.n_outliers"), F.col("outlier_fraction").alias("outliers.outlier_fraction"))
    test = report(df, columns, ("shapiro",)).select("name", F.col("test").alias("recommended_test"), F.col("stat").alias("test.stat"), F.col("p").alias("test.p"), F.col("normal").alias("test.normal"), F.col("p_value_reliable").alias("test.p_value_reliable"))
    text = base.withColumn("shape.skew_interpretation", skew_text(F.col("skewness"))).withColumn("shape.kurtosis_interpretation", kurtosis_text(F.col("kurtosis_excess")))
    return text.join(out, "name", "left").join(test, "name", "left")
