import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur import queries
from larkspur.operators import curate, cutpoint, describe, normality, plotdata, profile, ranks, relational, survival, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_numerical_summary_of_few_values(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, 16.0, None, math.nan)], "x double")
    r = describe.numerical_summary(df).first()
    assert (r.n, r.unique_n, r.missing_n, r.missing_pct) == (5, 5, 2, 28.57)
    assert (r.q1, r.median, r.q3, r.p01, r.p95) == (2, 4, 8, pytest.approx(1.04), pytest.approx(14.4))
    assert r["std"] == pytest.approx(6.0991802728)
    m = normality.moments(df).first()
    assert m.skewness == pytest.approx(0.8890481348) and m.kurtosis_excess == pytest.approx(-0.6740591398)


def test_summary_of_nothing(spark):
    empty = describe.numerical_summary(spark.createDataFrame([(None,), (None,)], "x double")).first()
    assert (empty.n, empty.unique_n, empty.missing_n, empty["mean"], empty["median"]) == (0, 0, 2, None, None)
    one = describe.numerical_summary(spark.createDataFrame([(3.0,)], "x double")).first()
    assert one["std"] is None and one["median"] == 3
    c = describe.categorical_summary(spark.createDataFrame([(None,)], "c string"), ["c"]).first()
    assert (c.n, c.mode, c.mode_pct) == (0, None, None)


def test_text_numbers(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("1.0d",), ("NaN",), ("x",), ("1_000",)], "s string")
    assert describe.numerical_summary(df, ["s"]).first().n == 2


def test_running_counts_match_a_plain_window(spark):
    values = np.random.default_rng(1).integers(0, 500, 4000)
    freq = spark.createDataFrame([("k", float(v)) for v in values], "name string, v double").groupBy("name", "v").agg(F.count("*").alias("c"))
    got = {r.v: r.cum for r in ranks.running(freq, "name", "v", "c").collect()}
    assert got == {float(v): int((values <= v).sum()) for v in np.unique(values)}


def test_profiles(spark):
    df = spark.createDataFrame([(i, i % 3, "a" * i, None, "2020-01-01", float(i)) for i in range(1, 9)], "user_id long, flag int, note string, nothing string, visit_date string, amount double")
    kinds = {r.col_name: r.col_type for r in profile.column_profiles(df).collect()}
    assert kinds == {"user_id": "Identifier", "flag": "Categorical", "note": "Free Text", "nothing": None, "visit_date": "DateTime", "amount": "Numerical"}
    got = rows(profile.datatype_map(profile.column_profiles(df)))
    assert ("Unknown", ["nothing"]) in got


def test_outliers_without_spread(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(100.0,)], "x double")
    assert not normality.outliers(df, ["x"], "modified_zscore").first().computable
    assert normality.outliers(df, ["x"], "iqr").first().n_outliers == 1
    same = spark.createDataFrame([(1.0,)] * 5, "x double")
    r = normality.outliers(same, ["x"], "zscore").first()
    assert not r.computable and r.n_outliers == 0
    with pytest.raises(ValueError):
        normality.outliers(df, ["x"], "other")


def test_normality_statistics_against_numpy(spark):
    from larkspur.functions import dist

    x = np.round(np.random.default_rng(2).normal(5, 2, 300), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = normality.rank_statistics(df).first()
    s, n = np.sort(x), len(x)
    f = np.array([dist.NORMAL.cdf((v - x.mean()) / x.std(ddof=1)) for v in s])
    i = np.arange(1, n + 1)
    assert r.ks == pytest.approx(max((i / n - f).max(), (f - (i - 1) / n).max()), abs=1e-9)
    assert r.a2 == pytest.approx(-n - ((2 * i - 1) * (np.log(f) + np.log1p(-f[::-1]))).sum() / n, abs=1e-7)
    report = {q.test: q for q in normality.report(df).collect()}
    assert report["shapiro"].normal and report["jb"].normal and set(report) == set(normality.TESTS)
    votes = normality.consensus(normality.report(df)).first()
    assert votes.votes_total == 6 and votes.consensus_normal
    assert normality.report(spark.createDataFrame([(1.0,), (2.0,)], "x double")).first().p is None


def test_shapiro_of_large_columns_uses_all_values(spark):
    from larkspur.functions import dist

    x = np.round(np.random.default_rng(4).normal(0, 1, 100_000), 3)
    x[:9000] = 0.5
    for outlier in (60.0, -60.0):
        x[-1] = outlier
        w, p = dist.shapiro_wilk(np.sort(x))
        got = normality.report(spark.createDataFrame([(float(v),) for v in x], "x double"), tests=("shapiro",)).first()
        assert got.stat == pytest.approx(w, abs=1e-9) and got.p == pytest.approx(p, abs=1e-9)


def test_recommendations():
    assert normality.recommended_tests(10) == ["shapiro", "jb"]
    assert normality.recommended_tests(100) == ["anderson", "dagostino", "lilliefors", "jb"]
    assert normality.default_test(6000, False) == "anderson" and normality.default_test(6000, True) == "lilliefors"
    assert "ties" in normality.recommendation("general", 6000, 0.5)[1]
    with pytest.raises(ValueError):
        normality.recommendation("nothing", 5)


SURV = [(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1), (6.0, 1)]


def frame(spark, data=SURV):
    return survival.survival_frame(spark.createDataFrame(data, "t double, e int"), "t", "e")


def test_kaplan_meier_by_hand(spark):
    curve = survival.km_curve(survival.event_table(frame(spark)))
    s = {r.time: r.s for r in curve.collect()}
    assert s == pytest.approx({1.0: 5 / 6, 2.0: 5 / 6 * 4 / 5, 3.0: 2 / 3, 4.0: 1 / 3, 6.0: 0.0})
    assert survival.medians(curve).first()["median"] == 4
    at = {r.t: r.s for r in survival.survival_at(curve, [0.5, 2.5, 9.0]).collect()}
    assert at[0.5] == 1 and at[2.5] == pytest.approx(2 / 3) and math.isnan(at[9.0])
    area = {r.tau: r.rmst for r in survival.rmst(curve, [0.5, 3.0, 8.0]).collect()}
    assert area == pytest.approx({0.5: 0.5, 3.0: 1 + 5 / 6 + 2 / 3, 8.0: 1 + 5 / 6 + 2 * 2 / 3 + 2 / 3})


def test_median_not_reached(spark):
    m = survival.medians(survival.km_curve(survival.event_table(frame(spark, [(1.0, 1), (2.0, 0), (3.0, 0), (4.0, 0)])))).first()
    assert m["median"] == math.inf


def test_survival_input(spark):
    bad = spark.createDataFrame([(-1.0, 1)], "t double, e int")
    with pytest.raises(survival.SurvivalInputError):
        survival.survival_frame(bad, "t", "e")
    with pytest.raises(survival.SurvivalInputError):
        survival.survival_frame(spark.createDataFrame([(1.0, 2)], "t double, e int"), "t", "e")
    with pytest.raises(survival.SurvivalInputError):
        survival.survival_frame(bad, "t", "none")
    lenient = survival.survival_frame(spark.createDataFrame([(1.0, "1.0"), (2.0, "0"), (3.0, "x"), (None, "1")], "t double, e string"), "t", "e", lenient=True)
    assert sorted(rows(lenient)) == [(1.0, True), (2.0, False)]


def cohort(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = np.ceil(rng.exponential(np.exp(-0.8 * (x > 0.2))) * 20)
    return spark.createDataFrame([(float(a), bool(e), "hi" if v > 0.2 else "lo", float(v)) for a, e, v in zip(t, rng.random(n) < 0.8, x, strict=True)], "time double, event boolean, `group` string, x double")


def test_logrank_and_cox_agree(spark):
    surv = cohort(spark)
    pair = survival.logrank_pair(surv, "lo", "hi").first()
    assert survival.logrank_omnibus(surv, ["lo", "hi"])["chi2"] == pytest.approx(pair.chi2)
    assert survival.logrank_pair(surv, "hi", "lo").first().chi2 == pytest.approx(pair.chi2)
    assert survival.logrank_pairwise(surv, "lo", ["hi"]).first().chi2 == pytest.approx(pair.chi2)
    a, b = survival.cox_hazards(surv, ["lo", "hi"]).first(), survival.cox_hazards(surv, ["hi", "lo"]).first()
    assert a.hr * b.hr == pytest.approx(1) and a.hr > 1.5 and a.ci_low < a.hr < a.ci_high and a.split_valid


def test_cox_gradient_vanishes(spark):
    d, n = survival._matrices(cohort(spark), ["lo", "hi"])
    beta, _, value, converged = survival.cox_fit(d, n)
    assert converged

    def likelihood(b):
        total = 0.0
        for dd, nn in zip(d, n, strict=True):
            k = int(dd.sum())
            total += dd[1] * b - sum(math.log(nn[0] + nn[1] * math.exp(b) - i / k * (dd[0] + dd[1] * math.exp(b))) for i in range(k))
        return total

    assert likelihood(beta[0]) == pytest.approx(value) and likelihood(beta[0]) >= max(likelihood(beta[0] + 0.01), likelihood(beta[0] - 0.01))


def test_unfit_groups(spark):
    df = spark.createDataFrame([(1.0, True, "a"), (2.0, False, "a"), (1.0, True, "b"), (2.0, True, "b"), (3.0, False, "c")], "time double, event boolean, `group` string")
    assert {r.group: r.reason for r in survival.split_validity(df).collect()} == {"a": None, "b": "no_censoring", "c": "group_size_1"}
    r = survival.cox_hazards(df, ["a", "b"]).first()
    assert not r.split_valid and r.invalid_reason == "no_censoring" and r.hr is None


def test_baselines():
    assert survival.baseline({"a": 2, "b": 2}, "largest")[0] == "a" and survival.baseline({"a": 2, "b": 2}, "smallest")[0] == "b"
    assert survival.baseline({"a": 2, "b": 2, "c": 3}, "smallest")[0] == "a" and survival.baseline({"a": 1, "b": 2}, "second") == ["b", "a"]
    with pytest.raises(ValueError):
        survival.baseline({"a": 1}, "z")


def test_bootstrap_covers_the_estimate(spark):
    surv = cohort(spark).select("time", "event")
    curve = survival.km_curve(survival.event_table(surv))
    area = survival.rmst(curve, [20.0]).first().rmst
    b = survival.rmst_bootstrap(surv, 20.0, 60)
    assert b["ci_low"] < area < b["ci_high"] and b["mean"] == pytest.approx(area, abs=1.0)


def test_scan_matches_single_comparisons(spark):
    surv = cohort(spark)
    cuts = cutpoint.thresholds(surv, "x", resolution=0.4)
    scanned = cutpoint.scan(surv, "x", [*cuts, 99.0])
    got = {r.threshold: r for r in scanned.collect()}
    assert not got[99.0].valid_split and got[99.0].reason == "one_side_empty"
    cut = float(cuts[len(cuts) // 2])
    two = cutpoint.at_cutoff(surv, "x", cut)
    low, high = f"<={cut:.2f}", f">{cut:.2f}"
    assert got[cut].chi2 == pytest.approx(survival.logrank_pair(two, low, high).first().chi2)
    assert got[cut].hr == pytest.approx(survival.cox_hazards(two, [low, high]).first().hr)
    best = cutpoint.best_threshold(scanned).first()
    marks = {r.label: r.threshold for r in cutpoint.markers(scanned, 0.0).collect()}
    assert abs(marks["Median"]) <= 0.4 and best.log_rank_p == min(r.log_rank_p for r in got.values() if r.valid_split)
    for r in cutpoint.compared_corrections(surv, "x", scanned, replicates=40).collect():
        assert r.adjusted_p_value >= r.raw_p_value - 1e-12


def test_scan_of_all_observed_values(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(1, 15)), bool(rng.random() < 0.6), None if i % 11 == 0 else float(rng.integers(0, 40))) for i in range(200)]
    rows += [(1.0, True, 1e6)] * 3
    df = spark.createDataFrame(rows, "time double, event boolean, x double")
    x = np.array([r[2] for r in rows if r[2] is not None])
    want = sorted({*cutpoint.fenced(np.unique(x)[:-1]).tolist(), float(np.median(x))})
    monkeypatch.setattr(cutpoint, "BLOCK", 7)
    monkeypatch.setattr(cutpoint, "CELLS", 30)
    scanned = cutpoint.scan(df, "x").orderBy("threshold").collect()
    assert [r.threshold for r in scanned] == want and cutpoint.median(df, "x") == np.median(x)
    for r in scanned[:: len(scanned) // 4]:
        low, high = r.group0_label, r.group1_label
        t = survival.logrank_tests(cutpoint.at_cutoff(df, "x", r.threshold), low, [high]).first()
        assert (r.group0_n, r.group1_n, r.valid_split, r.reason) == (t.baseline_n, t.n, t.split_valid, t.invalid_reason)
        assert (r.group0_median, r.group1_median, r.group0_follow_up, r.group1_follow_up) == (t.baseline_median, t.median, t.baseline_follow_up, t.follow_up)
        if r.valid_split:
            c = survival.cox_hazards(cutpoint.at_cutoff(df, "x", r.threshold), [low, high]).first()
            assert (r.chi2, r.hr, r.ci_low, r.cox_p) == pytest.approx((t.chi2, c.hr, c.ci_low, c.p_value))
    assert cutpoint.scan(df.where("x < 0"), "x").count() == 0
    marks = spark.createDataFrame([("Median", want[3]), ("Min P-Val", None)], "label string, threshold double")
    assert cutpoint.marked_tests(cutpoint.scan(df, "x", [want[3], 5.5]), marks).first().group0_n == scanned[3].group0_n
    assert cutpoint.marked_curves(df, "x", marks).select("label", "group").distinct().count() == 2


def scanned_blocks(effect, seed=5, size=4000, weight=1.0):
    """Rows of a scan of one block over many times, and the number of splits fitted over all times."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 1, size), 5)
    time = np.ceil(rng.exponential(300 * np.exp(effect * x)))
    event = (rng.random(size) < 0.4).astype(float)
    rows = pd.DataFrame({"cut": x, "time": time, "d": event * weight, "m": weight}).groupby(["cut", "time"], as_index=False).sum()
    base = rows.groupby("time", as_index=False)[["d", "m"]].sum().rename(columns={"d": "all_d", "m": "all_m"}).assign(d=0.0, m=0.0)
    fitted, fit = [], cutpoint.cox_many
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cutpoint, "cox_many", lambda d1, *rest: (fitted.append(len(d1)), fit(d1, *rest))[1])
        return cutpoint._comparisons(1.96)(rows, base), sum(fitted)


@pytest.mark.parametrize("effect,weight", [(0.0, 1.0), (1.5, 1.0), (-1.5, 1.0), (0.3, 60.0)])
def test_successive_thresholds_share_their_work_and_keep_their_results(monkeypatch, effect, weight):
    got, fitted = scanned_blocks(effect, weight=weight)
    assert fitted < len(got) / 2
    monkeypatch.setattr(cutpoint, "FEW", 1 << 60)
    want, whole = scanned_blocks(effect, weight=weight)
    assert whole > len(want) * 0.9
    exact = [c for c in want if c not in ("chi2", "log_rank_p", "hr", "ci_low", "ci_high", "cox_p")]
    pd.testing.assert_frame_equal(got[exact], want[exact], check_exact=True)
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-8, atol=1e-9)


def test_marked_rows_are_those_of_the_markers(spark):
    schema = "threshold double, valid_split boolean, cox_p double, chi2 double"
    for p in (0.01, 0.2):
        scanned = spark.createDataFrame([(1.0, True, p, 5.0), (2.0, True, 0.6, 1.0), (3.0, False, None, None), (5.0, True, 0.3, 2.0)], schema)
        want = cutpoint.marked_tests(scanned, cutpoint.markers(scanned, 2.9))
        got = cutpoint.marked_rows(scanned, 2.9)
        assert got.columns == want.columns and sorted(rows(got), key=str) == sorted(rows(want), key=str) and got.count() == (3 if p < 0.05 else 2)


@pytest.mark.parametrize("name", ["cutpoint_marked_tests", "cutpoint_markers", "cutpoint_best", "cutpoint_scan_observed", "scan_curves"])
def test_a_query_scans_once_and_reads_no_table_again(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "FileScan" not in plan


def test_a_median_between_values_is_a_threshold(spark):
    df = spark.createDataFrame([(float(i + 1), i % 2 == 0, float(x)) for i, x in enumerate((1, 1, 2, 4, 9, 9))], "time double, event boolean, x double")
    assert [(r.threshold, r.group0_n) for r in cutpoint.scan(df, "x").orderBy("threshold").collect()] == [(1.0, 2), (2.0, 3), (3.0, 3), (4.0, 4)]


def test_tied_sums():
    rng = np.random.default_rng(0)
    x, d = np.concatenate([rng.uniform(1, 40, 60), [1.0, 1e9]]), np.concatenate([rng.integers(0, 300, 60), [1, 3]]).astype(float)
    got = survival.tied_sums(x, d)
    for i in range(len(x)):
        j = x[i] + np.arange(int(d[i]))
        assert [g[i] for g in got] == pytest.approx([np.log(j).sum(), (1 / j).sum(), (1 / j**2).sum()], rel=1e-11)


def test_missing_covariate_is_high(spark):
    df = spark.createDataFrame([(1.0, True, None), (2.0, False, 1.0), (3.0, True, 1.0), (4.0, False, 2.0)], "time double, event boolean, x double")
    assert sorted(r.group for r in cutpoint.at_cutoff(df, "x", 1.0).collect()) == ["<=1.00", "<=1.00", ">1.00", ">1.00"]
    _, d, m = cutpoint.interval_table(df, "x", np.array([1.0]))
    assert m.sum(axis=1).tolist() == [2, 2]


def test_thresholds(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 4)], "x double")
    assert cutpoint.thresholds(df, "x").tolist() == [1, 2, 3]
    assert cutpoint.fenced(np.arange(10.0), None, 20).tolist() == list(range(2, 8))
    assert cutpoint.fenced(np.array([0.0, 0, 0, 0, 50])).tolist() == [0, 0, 0, 0]


def test_curation(spark):
    df = spark.createDataFrame([("F", 1, "x"), ("M", 2, "y"), (None, 3, "z")], "sex string, n int, gone string")
    edits = curate.column_edits(spark.createDataFrame([("gone", "True", None, None), ("sex", "False", " gender ", None), ("n", None, None, None)], "col_name string, remove string, change_col_name string, change_datatype string"))
    cats = curate.category_edits(spark.createDataFrame([("gender", "F", "female", "True"), ("gender", "M", None, "true"), ("gender", "U", " ", None)], "col_name string, category string, rename_to string, remove string"))
    assert curate.renames(edits) == {"gender": "sex"}
    out = curate.curated(df, edits, cats)
    assert out.columns == ["gender", "n"] and sorted(rows(out), key=str) == [("female", 1), (None, 2), (None, 3)]
    with pytest.raises(curate.EditError):
        curate.curated(df, curate.column_edits(spark.createDataFrame([("sex", None, "n", None)], "col_name string, remove string, change_col_name string, change_datatype string")))
    with pytest.raises(curate.EditError):
        curate.column_edits(spark.createDataFrame([("sex", None, None, "Strange")], "col_name string, remove string, change_col_name string, change_datatype string"))
    kept = curate.curated_profiles(profile.column_profiles(df), edits)
    assert sorted(r.col_name for r in kept.collect()) == ["gender", "n"]


def test_survival_pairs(spark):
    schema = "col_name string, inferred_datatype string, change_datatype string, survival_label string, remove boolean"
    good = [("e", "Event", None, "os", None), ("t", "Event", "Time", "os", None), ("x", "Time", None, None, None)]
    assert rows(curate.survival_pairs(spark.createDataFrame(good, schema))) == [("os", "e", "t")]
    for bad in (good[:1], [("a", "Time", None, "os", None), ("b", "Time", None, "os", None)], [*good, ("y", "Time", None, "os", None)]):
        with pytest.raises(curate.EditError):
            curate.survival_pairs(spark.createDataFrame(bad, schema))


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, r string")
    assert sorted(rows(relational.side_by_side(a, b, ["k"]))) == [(1, "x", None), (2, "y", "z"), (3, None, "w")]
    with pytest.raises(relational.DuplicateKeyError):
        relational.side_by_side(a.union(a), b, ["k"])
    assert rows(relational.without(a, b, "k")) == [(1, "x")] and rows(relational.within(a, b, "k")) == [(2, "y")] and rows(relational.common_keys(a, b, "k")) == [(2,)]
    wide = relational.aligned({"a": a.withColumnRenamed("l", "v"), "b": b.withColumnRenamed("r", "v")}, "k", "v")
    assert sorted(rows(wide)) == [(1, "x", None), (2, "y", "z"), (3, None, "w")]
    assert relational.same_rows(a, a) and not relational.same_rows(a, a.union(a)) and not relational.same_rows(a, b)
    nested = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2)) s, 3 t")
    assert relational.flattened(nested).columns == ["s.a", "s.b.c", "t"]


def test_tables(spark):
    df = spark.createDataFrame([(float(x), "a" if x % 2 else "b") for x in range(10)], "age double, arm string")
    summary = describe.numerical_summary(df)
    out = tables.numeric_table({"one": summary, "two": summary.where("false")}, ("n", "mean_sd"), 1, {"Clinic": ["age"]})
    assert rows(out) == [("Clinic", "age", "N", "10", tables.MISSING), ("Clinic", "age", "Mean (SD)", "4.5 (3.0)", tables.MISSING)]
    with pytest.raises(tables.TableError):
        tables.numeric_table({"one": summary.union(summary)})
    cats = tables.categorical_table({"all": describe.categorical_distribution(df, ["arm"])})
    assert rows(cats) == [("", "arm", "a", "5 (50.0%)"), ("", "arm", "b", "5 (50.0%)")]
    filled = tables.carried_down(spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, v string"), "v", "i")
    assert [r.v for r in filled.orderBy("i").collect()] == ["x", "x", "y"]


def test_plot_data(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = plotdata.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]
    q = plotdata.qq_points(df, "x").orderBy("rank").collect()
    assert [r.ordered for r in q] == [float(x) for x in range(11)] and q[5].theoretical == pytest.approx(0, abs=1e-12)
    curve = survival.km_curve(survival.event_table(frame(spark)))
    assert plotdata.km_steps(curve).orderBy("time").first().s == 1
    assert plotdata.histogram(df.where("false"), "x").count() == 0


def test_small_p_keeps_its_digits(spark):
    schema = "threshold double, log_rank_p double, valid_split boolean, group0_n long, group1_n long"
    for p in (1e-18, 1e-300):
        scanned = spark.createDataFrame([(1.0, 0.5, True, 30, 70), (2.0, p, True, 50, 50), (3.0, 0.2, True, 70, 30)], schema)
        _, raw, adjusted, cut, n, _ = cutpoint.lausen_schumacher(scanned)
        assert raw == p and p <= adjusted < 1e3 * p and (cut, n) == (2.0, 3)
    assert cutpoint.lausen_schumacher(spark.createDataFrame([(1.0, 0.5, True, 30, 70), (2.0, 0.0, True, 50, 50)], schema))[2] == 0


def test_checks_skip_rows_without_time_or_event(spark):
    rows = spark.createDataFrame([(1.0, 1), (-2.0, None), (None, 7), (3.0, 0)], "t double, e int")
    assert survival.survival_frame(rows, "t", "e").count() == 2


def test_keywords_go_before_labels():
    assert survival.baseline({"largest": 1, "b": 5}, "largest")[0] == "b" and survival.baseline({"a": 1, "b": 5}, "a")[0] == "a"


def test_tests_of_groups(spark):
    rows = [(float(t), t % 3 > 0, "a") for t in range(1, 41)] + [(t / 2, t % 4 > 0, "b") for t in range(1, 41)] + [(5.0, True, "c")]
    surv = spark.createDataFrame(rows, "time double, event boolean, group string").cache()
    got = {r.group: r for r in survival.combined_tests(surv, ["a", "b"]).collect()}["b"]
    chi2 = survival.logrank_pair(surv, "a", "b").first().chi2
    assert got.chi2 == pytest.approx(chi2) and got.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2))) and got.omnibus_chi2 == pytest.approx(chi2)
    assert (got.n, got.baseline_n, got.split_ratio, got.split_valid) == (40, 40, 1.0, True) and got.median < got.baseline_median and got.hr > 1
    unfit = {r.group: r for r in survival.logrank_tests(surv, "a", ["b", "c"]).collect()}["c"]
    assert unfit.p_value is None and unfit.invalid_reason == "group_size_1" and not unfit.split_valid


def test_survival_edits(spark):
    with pytest.raises(curate.EditError):
        curate.survival_edits(spark.createDataFrame([("a", "Time", "Numerical", None, None)], "col_name string, inferred_datatype string, change_datatype string, survival_label string, remove string"))
