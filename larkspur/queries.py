"""Queries over the star-schema tables, and the same in SQL for DuckDB.

The survival cohort: orders with their first later shipment; time in days until then, event where
the order is finished, group its priority, x its price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dist, naming
from larkspur.operators import curate, cutpoint, describe, normality, plotdata, profile, relational, survival, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
POINTS = [180.0, 365.0, 730.0, 1095.0, 1825.0]
GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CUTS = [50000.0, 100000.0, 150000.0, 200000.0, 250000.0]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, event, group, x."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    first = li.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate > o_orderdate").groupBy("o_orderkey", "o_orderdate").agg(F.min("l_shipdate").alias("first_ship"))
    rows = o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").join(first, "o_orderkey")
    return rows.select(F.datediff("first_ship", "o_orderdate").cast("double").alias("time"), (F.col("o_orderstatus") == "F").alias("event"), F.col("o_orderpriority").alias("group"), F.col("o_totalprice").alias("x"))


COHORT = """c AS (SELECT CAST(date_diff('day', o_orderdate, first_ship) AS DOUBLE) AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, o_orderpriority AS grp, o_totalprice AS x
  FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def curve_sql(event: str = "event", keyed: bool = False) -> str:
    key, part = ("grp, ", "PARTITION BY grp ") if keyed else ("", "")
    return f"""{COHORT}, t AS (SELECT {key}time, CAST(sum({event}) AS BIGINT) AS d, count(*) AS m FROM c GROUP BY {key}time),
  r AS (SELECT *, sum(m) OVER ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM t),
  k AS (SELECT *, product(1 - d / n) OVER ({part}ORDER BY time ROWS UNBOUNDED PRECEDING) AS s, sum(CASE WHEN n > d THEN d / (CAST(n AS DOUBLE) * (n - d)) ELSE 0 END) OVER ({part}ORDER BY time ROWS UNBOUNDED PRECEDING) AS v FROM r),
  curve AS (SELECT *, CASE WHEN s >= 1 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE pow(s, exp({survival.Z95!r} * sqrt(v) / abs(ln(s)))) END AS ci_low,
    CASE WHEN s >= 1 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE pow(s, exp(-{survival.Z95!r} * sqrt(v) / abs(ln(s)))) END AS ci_high FROM k)"""


# Summaries of columns.

NUMBERS = {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "customer": ["c_acctbal", "c_nationkey"],
}


def summary_sql(name: str, columns: list[str]) -> str:
    def one(c: str) -> str:
        q = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {k}" for k, p in describe.QUANTILES.items())
        return f"""SELECT '{c}' AS name, count(v) AS n, count(DISTINCT v) AS unique_n, count(*) - count(v) AS missing_n, round(100.0 * (count(*) - count(v)) / count(*), 2) AS missing_pct, round(round(avg(v), 9), 6) AS mean, round(stddev_samp(v), 6) AS std,
        {q}, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {name})"""

    return " UNION ALL ".join(map(one, columns))


def summary(df: DataFrame) -> DataFrame:
    """Means are rounded to 9 places first: those of prices may end in exactly 5 at the 7th, where the last bit of a sum would decide."""
    return rounded(describe.numerical_summary(df).withColumn("mean", F.round("mean", 9)))


@query(summary_sql("lineitem", NUMBERS["lineitem"]))
def num_summary_lineitem(spark, sf_dir):
    return summary(table(spark, sf_dir, "lineitem").select(*NUMBERS["lineitem"]))


@query(summary_sql("customer", NUMBERS["customer"]))
def num_summary_customer(spark, sf_dir):
    return summary(table(spark, sf_dir, "customer").select(*NUMBERS["customer"]))


def distribution_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS category, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)


@query(distribution_sql("orders", ["o_orderpriority"]))
def cat_distribution_orders(spark, sf_dir):
    return describe.categorical_distribution(table(spark, sf_dir, "orders"), ["o_orderpriority"])


@query(distribution_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]))
def cat_distribution_all_lineitem(spark, sf_dir):
    return describe.categorical_distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def category_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, (SELECT count({c}) FROM {name}) AS n, (SELECT count(*) - count({c}) FROM {name}) AS missing_n, (SELECT round(100.0 * (count(*) - count({c})) / count(*), 2) FROM {name}) AS missing_pct,
        (SELECT count(DISTINCT {c}) FROM {name}) AS unique_n, mode, mode_count, round(100.0 * mode_count / (SELECT count({c}) FROM {name}), 2) AS mode_pct
        FROM (SELECT {c} AS mode, count(*) AS mode_count FROM {name} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in columns
    )


@query(category_sql("part", ["p_brand", "p_type"]))
def cat_summary_part(spark, sf_dir):
    return describe.categorical_summary(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT 'p_brand' AS col_name, category FROM (SELECT DISTINCT p_brand AS category FROM part ORDER BY 1 LIMIT 20)")
def distinct_sample_part(spark, sf_dir):
    return describe.distinct_sample(table(spark, sf_dir, "part"), ["p_brand"]).select("col_name", F.explode("values").alias("category"))


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_customers(spark, sf_dir):
    return describe.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


# Profiles. The types are what the rules give for these names and tables.

def profile_sql(name: str, columns: dict[str, tuple[str, str]]) -> str:
    def one(c: str, kind: str, converted: str) -> str:
        return f"""SELECT '{c}' AS col_name, '{kind}' AS col_type, count(*) - count({c}) AS missing_n, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, CAST({converted} AS DOUBLE) AS num_conversion_pct, count(DISTINCT {c}) AS unique_n, '{naming.normalized(c)}' AS normalized_name FROM {name}"""

    return " UNION ALL ".join(one(c, k, v) for c, (k, v) in columns.items())


@query(profile_sql("events", {"event_id": ("Identifier", "100.0"), "ts": ("Numerical", "100.0"), "user_id": ("Identifier", "100.0"), "event_type": ("Survival", "0.0"), "value": ("Numerical", "100.0"), "props": ("Categorical", "0.0")}))
def col_profile_events(spark, sf_dir):
    return profile.column_profiles(table(spark, sf_dir, "events")).drop("tokens")


@query(profile_sql("customer", {"c_custkey": ("Numerical", "100.0"), "c_name": ("Categorical", "0.0"), "c_nationkey": ("Numerical", "100.0"), "c_acctbal": ("Numerical", "100.0"), "c_mktsegment": ("Categorical", "0.0")}))
def col_profile_customer(spark, sf_dir):
    return profile.column_profiles(table(spark, sf_dir, "customer")).drop("tokens")


# Column names of the kinds of tables that the rules are for, with what they say.
NAMES = {
    "patientID": "Identifier", "OSMonths": "Survival", "FollowUpDays": "Survival", "tumor-stage": "Categorical", "Patient Number": "Identifier", "os_status": "Survival", "date_of_birth": "DateTime", "age": "Numerical",
    "treatment_arm": "Categorical", "clinical_notes": None, "comment": "Free Text", "event_date": "Survival", "admission_day": "Survival", "l_quantity": None, "pfs time": "Survival",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {repr(t) if t else 'NULL'}, '{naming.normalized(n)}')" for n, t in NAMES.items()) + ") AS t(col_name, col_type, normalized_name)")
def semantic_types_all(spark, sf_dir):
    return profile.semantic_types(spark, list(NAMES)).select("col_name", "col_type", "normalized_name")


@query()
def survival_roles_all(spark, sf_dir):
    return profile.survival_profiles(spark, list(NAMES)).select("col_name", "col_type", F.round("score", 2).alias("score"), "normalized_name")


@query()
def datatype_map_long(spark, sf_dir):
    frames = [profile.column_profiles(table(spark, sf_dir, t)).select(F.lit(t).alias("dataset_name"), "col_type", "col_name") for t in ("customer", "events", "orders")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return profile.catalogue(out)


# Normality.

MOMENTS = "m AS (SELECT count(v) AS n, count(DISTINCT v) AS u, avg(v) AS mean, stddev_samp(v) AS sd FROM s), p AS (SELECT m.*, sum((v - mean) ** 2) OVER () AS m2, sum((v - mean) ** 3) OVER () AS m3, sum((v - mean) ** 4) OVER () AS m4 FROM s, m LIMIT 1), q AS (SELECT n, u, mean, sd, m3 / n / pow(m2 / n, 1.5) AS sk, m4 / n / pow(m2 / n, 2) - 3 AS ku FROM p)"
QUANTITY = f"WITH s AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), {MOMENTS}"
BALANCE = f"WITH s AS (SELECT CAST(c_acctbal AS DOUBLE) AS v FROM customer), {MOMENTS}"


@query(f"{QUANTITY} SELECT 'l_quantity' AS name, n, u AS n_unique, round(mean, 6) AS mean, round(sd, 6) AS std, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis_excess, round(1 - u / n, 6) AS tie_fraction, (1 - u / n) <= 0.1 AS ks_family_reliable FROM q")
def moments_quantity(spark, sf_dir):
    return rounded(normality.moments(table(spark, sf_dir, "lineitem"), ["l_quantity"]))


@query(f"{QUANTITY} SELECT 'l_quantity' AS name, round(n / 6 * (sk * sk + ku * ku / 4), 4) AS jb FROM q")
def jarque_bera_quantity(spark, sf_dir):
    return normality.moments(table(spark, sf_dir, "lineitem"), ["l_quantity"]).select("name", F.round(normality.jarque_bera(), 4).alias("jb"))


@query(f"""{QUANTITY}, k AS (SELECT n, sk * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y, 3.0 * (n * 1.0 * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2,
  (ku + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))) AS x, 6.0 * (n * 1.0 * n - 5.0 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * 1.0 * (n - 2) * (n - 3))) AS g FROM q),
  w AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / g * (2 / g + sqrt(1 + 4 / (g * g))) AS a FROM k),
  z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (1 - 2 / (9 * a) - sign((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) * pow(abs((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM w)
  SELECT 'l_quantity' AS name, round(zs, 4) AS skew_z, round(zk, 4) AS kurtosis_z, round(zs * zs + zk * zk, 4) AS k2 FROM z""")
def dagostino_quantity(spark, sf_dir):
    r = normality.moments(table(spark, sf_dir, "lineitem"), ["l_quantity"]).first()  # one row
    zs, zk = dist.skew_z(r.skewness, r.n), dist.kurtosis_z(r.kurtosis_excess, r.n)
    return rounded(spark.createDataFrame([(r.name, zs, zk, zs * zs + zk * zk)], "name string, skew_z double, kurtosis_z double, k2 double"), 4)


@query(f"{BALANCE} SELECT 'c_acctbal' AS name, CASE WHEN n < 20 THEN 'low power' WHEN n <= 300 THEN 'moderate power' ELSE 'high power / oversensitive' END AS power_regime, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis_excess FROM q")
def shape_balance(spark, sf_dir):
    return rounded(normality.shape(table(spark, sf_dir, "customer"), ["c_acctbal"]).select("name", "power_regime", "skewness", "kurtosis_excess"))


def outlier_sql(name: str, c: str, method: str) -> str:
    s = f"WITH s AS (SELECT CAST({c} AS DOUBLE) AS v FROM {name} WHERE {c} IS NOT NULL)"
    fences = {
        "iqr": ", f AS (SELECT quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS low, quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS high FROM s)",
        "zscore": ", f AS (SELECT avg(v) - 3 * stddev_samp(v) AS low, avg(v) + 3 * stddev_samp(v) AS high FROM s)",
        "modified_zscore": ", f AS (SELECT median(v) - 3.5 * mad(v) / 0.6745 AS low, median(v) + 3.5 * mad(v) / 0.6745 AS high FROM s)",
    }[method]
    return f"{s}{fences} SELECT '{c}' AS name, '{method}' AS method, round(low, 4) AS low, round(high, 4) AS high, CAST(count(*) FILTER (v < low OR v > high) AS BIGINT) AS n_outliers, round(count(*) FILTER (v < low OR v > high) / count(*), 6) AS outlier_fraction, true AS computable FROM s, f GROUP BY low, high"


def _outliers(spark, sf_dir, method: str) -> DataFrame:
    out = normality.outliers(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], method)
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4), "outlier_fraction": F.round("outlier_fraction", 6)})


@query(outlier_sql("lineitem", "l_extendedprice", "iqr"))
def outlier_iqr(spark, sf_dir):
    return _outliers(spark, sf_dir, "iqr")


@query(outlier_sql("lineitem", "l_extendedprice", "zscore"))
def outlier_z(spark, sf_dir):
    return _outliers(spark, sf_dir, "zscore")


@query(outlier_sql("lineitem", "l_extendedprice", "modified_zscore"))
def outlier_modz(spark, sf_dir):
    return _outliers(spark, sf_dir, "modified_zscore")


@query()
def rank_statistics_balance(spark, sf_dir):
    return rounded(normality.rank_statistics(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query()
def normality_report(spark, sf_dir):
    return rounded(normality.report(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query()
def normality_consensus(spark, sf_dir):
    return normality.consensus(normality.report(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query()
def normality_sensitivity(spark, sf_dir):
    return normality.sensitivity(normality.report(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query()
def effect_size_balance(spark, sf_dir):
    return rounded(normality.effect_size(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query()
def normality_diagnostics_supplier(spark, sf_dir):
    return rounded(normality.diagnostics(table(spark, sf_dir, "supplier"), ["s_acctbal"]))


# Survival.

CURVE = ("time", "d", "m", "at_risk", "s", "ci_low", "ci_high")


@query(f"WITH {curve_sql()} SELECT time, d, m, CAST(n AS BIGINT) AS at_risk, round(s, 6) AS s, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM curve")
def km_curve(spark, sf_dir):
    return rounded(survival.km_curve(survival.event_table(cohort(spark, sf_dir))).select(*CURVE))


@query(f'WITH {curve_sql(keyed=True)} SELECT grp AS "group", time, d, m, CAST(n AS BIGINT) AS at_risk, round(s, 6) AS s, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM curve')
def km_curve_by_group(spark, sf_dir):
    return rounded(survival.km_curve(survival.event_table(cohort(spark, sf_dir), ["group"]), ["group"]).select("group", *CURVE))


def median_sql(event: str) -> str:
    first = lambda c: f"coalesce(min(CASE WHEN {c} <= 0.5 THEN time END), 'infinity'::DOUBLE)"
    return f'WITH {curve_sql(event, True)} SELECT grp AS "group", {first("s")} AS median, {first("ci_low")} AS ci_low, {first("ci_high")} AS ci_high FROM curve GROUP BY grp'


@query(median_sql("event"))
def km_median_by_group(spark, sf_dir):
    return survival.medians(survival.km_curve(survival.event_table(cohort(spark, sf_dir), ["group"]), ["group"]), ["group"])


@query(median_sql("1 - event"))
def followup_median_by_group(spark, sf_dir):
    return survival.medians(survival.km_curve(survival.event_table(cohort(spark, sf_dir), ["group"], reverse=True), ["group"]), ["group"])


VALUES = ", ".join(f"({t})" for t in POINTS)


@query(f"WITH {curve_sql()} SELECT CAST(t AS DOUBLE) AS t, " + ", ".join(f"round(CASE WHEN max(time) < t THEN 'nan'::DOUBLE ELSE coalesce(arg_max({c}, time) FILTER (time <= t), 1.0) END, 6) AS {c}" for c in ("s", "ci_low", "ci_high")) + f" FROM curve, (VALUES {VALUES}) AS p(t) GROUP BY t")
def surv_prob_at(spark, sf_dir):
    return rounded(survival.survival_at(survival.km_curve(survival.event_table(cohort(spark, sf_dir))), POINTS))


@query(f"WITH {curve_sql()}, st AS (SELECT time, s, lead(time) OVER (ORDER BY time) AS nxt, row_number() OVER (ORDER BY time) AS k FROM curve) SELECT CAST(tau AS DOUBLE) AS tau, round(sum(s * greatest(0.0, least(coalesce(nxt, tau), tau) - time) + CASE WHEN k = 1 THEN least(time, tau) ELSE 0 END), 4) AS rmst FROM st, (VALUES {VALUES}) AS p(tau) GROUP BY tau")
def rmst_at(spark, sf_dir):
    return rounded(survival.rmst(survival.km_curve(survival.event_table(cohort(spark, sf_dir))), POINTS), 4)


@query()
def rmst_bootstrap(spark, sf_dir):
    out = survival.rmst_bootstrap(cohort(spark, sf_dir), 1825.0, 200)
    return spark.createDataFrame([(1825.0, out["mean"], out["ci_low"], out["ci_high"])], "tau double, mean double, ci_low double, ci_high double")


@query(f"""WITH {COHORT} SELECT grp AS "group", count(*) AS n, CAST(sum(event) AS BIGINT) AS events, CAST(count(*) - sum(event) AS BIGINT) AS censored, max(time) AS max_time, CASE WHEN count(*) <= 1 THEN 'group_size_1' WHEN sum(event) = 0 THEN 'no_events' WHEN sum(event) = count(*) THEN 'no_censoring' END AS reason FROM c GROUP BY grp""")
def group_validity(spark, sf_dir):
    return survival.split_validity(cohort(spark, sf_dir))


@query(f"""WITH {COHORT}, g AS (SELECT grp, count(*) AS n FROM c GROUP BY grp) SELECT 'largest' AS rule, (SELECT grp FROM g ORDER BY n DESC, grp LIMIT 1) AS baseline UNION ALL SELECT 'smallest', (SELECT grp FROM g ORDER BY n, grp LIMIT 1)""")
def baseline_resolution(spark, sf_dir):
    counts = {r.group: r.n for r in survival.group_counts(cohort(spark, sf_dir)).orderBy("group").collect()}
    return spark.createDataFrame([(rule, survival.baseline(counts, rule)[0]) for rule in ("largest", "smallest")], "rule string, baseline string")


def logrank_sql(first: str, others: list[str]) -> str:
    pairs = " UNION ALL ".join(f"SELECT '{o}' AS pair, time, event, CASE WHEN grp = '{first}' THEN 0 ELSE 1 END AS own FROM c WHERE grp IN ('{first}', '{o}')" for o in others)
    return f"""WITH {COHORT}, u AS ({pairs}), t AS (SELECT pair, time, sum(event) AS d, count(*) AS m, sum(event * own) AS d1, sum(own) AS m1 FROM u GROUP BY pair, time),
      r AS (SELECT *, CAST(sum(m) OVER w AS DOUBLE) AS n, CAST(sum(m1) OVER w AS DOUBLE) AS n1 FROM t WINDOW w AS (PARTITION BY pair ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      z AS (SELECT pair, CAST(sum(d1) AS DOUBLE) AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r WHERE d > 0 GROUP BY pair)
      SELECT pair AS "group", observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(pow(observed - expected, 2) / variance, 6) AS chi2 FROM z"""


@query(f"SELECT observed, expected, variance, chi2 FROM ({logrank_sql('5-LOW', ['1-URGENT'])})")
def logrank_stat_pair(spark, sf_dir):
    return rounded(survival.logrank_pair(cohort(spark, sf_dir), "1-URGENT", "5-LOW"))


@query(logrank_sql("2-HIGH", [g for g in GROUPS if g != "2-HIGH"]))
def logrank_pairwise(spark, sf_dir):
    return rounded(survival.logrank_pairwise(cohort(spark, sf_dir), "2-HIGH", [g for g in GROUPS if g != "2-HIGH"]))


@query()
def logrank_tests(spark, sf_dir):
    return rounded(survival.logrank_tests(cohort(spark, sf_dir), "2-HIGH", [g for g in GROUPS if g != "2-HIGH"]))


@query()
def combined_tests_pair(spark, sf_dir):
    return rounded(survival.combined_tests(cohort(spark, sf_dir), ["1-URGENT", "5-LOW"]))


@query()
def combined_tests_multi(spark, sf_dir):
    return rounded(survival.combined_tests(cohort(spark, sf_dir), GROUPS))


@query()
def logrank_omnibus(spark, sf_dir):
    out = survival.logrank_omnibus(cohort(spark, sf_dir), GROUPS)
    return spark.createDataFrame([(out["chi2"], out["df"], out["p_value"])], "chi2 double, df int, p_value double")


@query()
def cox_hr_binary(spark, sf_dir):
    return rounded(survival.cox_hazards(cohort(spark, sf_dir), ["1-URGENT", "5-LOW"]))


@query()
def cox_hr_multi(spark, sf_dir):
    return rounded(survival.cox_hazards(cohort(spark, sf_dir), ["2-HIGH", *(g for g in GROUPS if g != "2-HIGH")]))


@query()
def endpoint_summary(spark, sf_dir):
    surv = cohort(spark, sf_dir)
    return rounded(survival.endpoint_summary({"all": surv.select("time", "event"), "urgent": surv.where("group = '1-URGENT'").select("time", "event")}, tuple(POINTS)))


# Cut-points.

OBSERVED = f"""{COHORT}, v AS (SELECT DISTINCT x FROM c), w AS (SELECT x FROM v WHERE x < (SELECT max(x) FROM v)), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM w),
  o AS (SELECT x AS threshold FROM w, q WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query(f"WITH {OBSERVED} SELECT threshold FROM o")
def thresholds_observed(spark, sf_dir):
    return cutpoint.observed_thresholds(cohort(spark, sf_dir), "x")


@query(f"""WITH {COHORT}, b AS (SELECT min(round(x / 1000)) AS lo, max(round(x / 1000)) AS hi FROM c), w AS (SELECT lo + 10 * i AS x FROM b, range(0, 100000) AS r(i) WHERE lo + 10 * i <= hi), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM w) SELECT CAST(x AS DOUBLE) AS threshold FROM w, q WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def thresholds_synthetic(spark, sf_dir):
    cuts = cutpoint.thresholds(cohort(spark, sf_dir).withColumn("x", F.round(F.col("x") / 1000)), "x", resolution=10.0)
    return spark.createDataFrame([(float(c),) for c in cuts], "threshold double")


@query(f"""WITH {COHORT}, h(cut) AS (VALUES {', '.join(f'({c})' for c in CUTS)}), u AS (SELECT cut, time, event, CASE WHEN x <= cut THEN 1 ELSE 0 END AS own FROM c, h), t AS (SELECT cut, time, sum(event) AS d, count(*) AS m, sum(event * own) AS d1, sum(own) AS m1 FROM u GROUP BY cut, time),
  r AS (SELECT *, CAST(sum(m) OVER w AS DOUBLE) AS n, CAST(sum(m1) OVER w AS DOUBLE) AS n1 FROM t WINDOW w AS (PARTITION BY cut ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  z AS (SELECT cut, sum(d1) AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v, CAST(sum(m1) AS BIGINT) AS k FROM r GROUP BY cut) SELECT CAST(cut AS DOUBLE) AS threshold, k AS group0_n, round(pow(o - e, 2) / v, 6) AS chi2 FROM z""")
def cutpoint_logrank_scan(spark, sf_dir):
    return rounded(cutpoint.scan(cohort(spark, sf_dir), "x", CUTS).select("threshold", "group0_n", "chi2"))


def _scan(spark, sf_dir) -> tuple[DataFrame, float | None]:
    return cutpoint.scan_and_median(cohort(spark, sf_dir), "x")


def _whole(t: str) -> str:
    return f"CAST(sum({t}) OVER lower AS DOUBLE)"


@query(f"""WITH {OBSERVED}, cuts AS (SELECT threshold FROM o UNION SELECT median(x) FROM c), top AS (SELECT max(threshold) AS top FROM cuts),
  p AS (SELECT (SELECT min(threshold) FROM cuts) AS least, coalesce(x, 'inf'::DOUBLE) AS x, time, event FROM c), a AS (SELECT greatest(least, x) AS x, time, sum(event) AS d, count(*) AS m FROM p, top WHERE greatest(least, x) <= top GROUP BY 1, 2),
  al AS (SELECT time, sum(event) AS d, count(*) AS m FROM c GROUP BY time), al2 AS (SELECT *, CAST(sum(m) OVER (ORDER BY time DESC) AS DOUBLE) AS n FROM al),
  g AS (SELECT threshold, al2.time, al2.d, al2.n, {_whole('coalesce(a.d, 0)')} AS d0, {_whole('coalesce(a.m, 0)')} AS m0 FROM cuts CROSS JOIN al2 LEFT JOIN a ON a.x = threshold AND a.time = al2.time WINDOW lower AS (PARTITION BY al2.time ORDER BY threshold)),
  r AS (SELECT *, sum(m0) OVER (PARTITION BY threshold ORDER BY time DESC) AS n0 FROM g),
  s AS (SELECT threshold, CAST(sum(m0) AS BIGINT) AS group0_n, (SELECT count(*) FROM c) - CAST(sum(m0) AS BIGINT) AS group1_n, sum(d0) AS e0, (SELECT sum(event) FROM c) - sum(d0) AS e1, sum(d0 - d * n0 / n) AS u, sum(CASE WHEN n > 1 THEN d * (n0 / n) * (1 - n0 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r GROUP BY threshold),
  f AS (SELECT *, group0_n > 1 AND group1_n > 1 AND e0 > 0 AND e1 > 0 AND e0 < group0_n AND e1 < group1_n AS valid_split FROM s)
  SELECT threshold, valid_split, group0_n, group1_n, CASE WHEN valid_split THEN round(u * u / v, 5) END AS chi2 FROM f""")
def cutpoint_scan_observed(spark, sf_dir):
    chi2 = F.when(F.col("valid_split"), F.round("chi2", 5))
    return _scan(spark, sf_dir)[0].select("threshold", "valid_split", "group0_n", "group1_n", chi2.alias("chi2"))


@query()
def cutpoint_scan(spark, sf_dir):
    return rounded(_scan(spark, sf_dir)[0])


@query()
def cutpoint_markers(spark, sf_dir):
    return cutpoint.markers(*_scan(spark, sf_dir))


@query()
def cutpoint_marked_tests(spark, sf_dir):
    return rounded(cutpoint.marked_rows(*_scan(spark, sf_dir)))


@query()
def cutpoint_best(spark, sf_dir):
    return rounded(cutpoint.best_threshold(_scan(spark, sf_dir)[0]))


@query()
def cutpoint_corrections(spark, sf_dir):
    surv = cohort(spark, sf_dir)
    scanned = cutpoint.scan(surv, "x", cutpoint.thresholds(surv, "x", resolution=20000.0))
    return rounded(cutpoint.compared_corrections(surv, "x", scanned).drop("details"))


# Curation, relational helpers and tables.

@query("""SELECT o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN NULL ELSE o_orderstatus END AS status, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def curated_orders(spark, sf_dir):
    cols = spark.createDataFrame([("o_custkey", "true", None, None), ("o_orderdate", "TRUE", None, None), ("o_orderkey", None, "order_key", None), ("o_orderstatus", "False", " status ", None)], "col_name string, remove string, change_col_name string, change_datatype string")
    cats = spark.createDataFrame([("status", "F", "finished", None), ("status", "P", None, "yes"), ("status", "O", None, None), ("o_orderpriority", "1-URGENT", "urgent", "true"), ("o_orderpriority", "2-HIGH", "urgent", None)], "col_name string, category string, rename_to string, remove string")
    return curate.curated(table(spark, sf_dir, "orders"), curate.column_edits(cols), curate.category_edits(cats))


@query("""SELECT * FROM (VALUES ('os', 'os_event', 'os_months'), ('pfs', 'pfs_status', 'pfs_days')) AS t(surv_label, event_col, time_col)""")
def surv_pairs(spark, sf_dir):
    meta = spark.createDataFrame([("os_event", "Event", None, "os", None), ("os_months", "Time", None, "os", None), ("pfs_status", "Time", "Event", "pfs", None), ("pfs_days", "Time", None, "pfs", None), ("fu_days", "Time", None, None, None), ("old", "Time", None, "os", True)], "col_name string, inferred_datatype string, change_datatype string, survival_label string, remove boolean")
    return curate.survival_pairs(meta)


@query("""SELECT * FROM (VALUES ('os_status', 'Time', 'os', false), ('old_months', NULL, NULL, true)) AS t(col_name, change_datatype, survival_label, remove)""")
def survival_edits_parsed(spark, sf_dir):
    report = curate.survival_report(profile.survival_profiles(spark, ["os_status", "pfs time", "old_months"]))
    typed = report.withColumn("change_datatype", F.when(F.col("col_name") == "os_status", " Time ")).withColumn("survival_label", F.when(F.col("col_name") == "os_status", "os").otherwise(" ")).withColumn("remove", F.col("col_name") == "old_months")
    return curate.survival_edits(typed).drop("inferred_datatype")


@query(distribution_sql("orders", ["o_orderstatus", "o_orderpriority"]).replace("'o_orderstatus'", "'status'"))
def category_report_orders(spark, sf_dir):
    return curate.category_report(table(spark, sf_dir, "orders"), ["status", "o_orderpriority"], {"status": "o_orderstatus"}).drop("rename_to", "remove")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_customers(spark, sf_dir):
    return relational.without(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join_customers(spark, sf_dir):
    return relational.within(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(spark, sf_dir):
    return relational.common_keys(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query("""WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT coalesce(a.nationkey, b.nationkey) AS nationkey, customers, suppliers FROM a FULL JOIN b ON a.nationkey = b.nationkey""")
def outer_side_by_side(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return relational.side_by_side(a, b, ["nationkey"])


@query()
def journal_numeric(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cohorts = {s: describe.numerical_summary(c.where(F.col("c_mktsegment") == s), ["c_acctbal", "c_nationkey"]) for s in ("AUTOMOBILE", "BUILDING")}
    return tables.numeric_table(cohorts)


@query("""WITH d AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS cohort, o_orderpriority AS category, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2), t AS (SELECT *, printf('%d', n) AS x, 100.0 * n / sum(n) OVER (PARTITION BY cohort) AS pct FROM d)
SELECT '' AS section, 'o_orderpriority' AS variable, category, max(CASE WHEN cohort = 'finished' THEN n END) AS finished, max(CASE WHEN cohort = 'open' THEN n END) AS open FROM t GROUP BY category""")
def journal_categorical(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cohorts = {n: describe.categorical_distribution(o.where(F.col("o_orderstatus") == s), ["o_orderpriority"]) for n, s in (("finished", "F"), ("open", "O"))}
    out = tables.categorical_table(cohorts)
    return out.select("section", "variable", "category", *(F.regexp_replace(F.substring_index(c, " (", 1), ",", "").cast("long").alias(c) for c in cohorts))


# Plot data.

@query(f"""WITH {COHORT} SELECT tick, CAST(count(*) FILTER (time >= tick) AS BIGINT) AS at_risk, CAST(count(*) FILTER (time < tick AND event = 1) AS BIGINT) AS events, CAST(count(*) FILTER (time < tick AND event = 0) AS BIGINT) AS censored FROM c, (VALUES (0.0::DOUBLE), (500.0::DOUBLE), (1000.0::DOUBLE), (2000.0::DOUBLE)) AS p(tick) GROUP BY tick""")
def km_at_risk_ticks(spark, sf_dir):
    return plotdata.at_risk(cohort(spark, sf_dir), [0.0, 500.0, 1000.0, 2000.0])


@query("""WITH s AS (SELECT CAST(l_quantity AS DOUBLE) AS v, min(l_quantity) OVER () AS lo, max(l_quantity) OVER () AS hi FROM lineitem) SELECT CAST(least(19, floor((v - lo) / ((hi - lo) / 20.0))) AS INTEGER) AS bin, count(*) AS count FROM s GROUP BY 1""")
def hist_bins(spark, sf_dir):
    return plotdata.histogram(table(spark, sf_dir, "lineitem"), "l_quantity").where("count > 0").select("bin", "count")


@query()
def qq_points(spark, sf_dir):
    return rounded(plotdata.qq_points(table(spark, sf_dir, "customer"), "c_acctbal", 100))


@query("""WITH s AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem), f AS (SELECT quantile_cont(v, 0.25) - 0.2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS low, quantile_cont(v, 0.75) + 0.2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS high FROM s) SELECT 'l_extendedprice' AS name, round(v, 2) AS v, count(*) AS c FROM s, f WHERE v < low OR v > high GROUP BY v""")
def outlier_values_price(spark, sf_dir):
    return rounded(normality.outlier_values(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], "iqr", 0.2), 2)


@query(f"WITH {curve_sql()} SELECT 0.0::DOUBLE AS time, 1.0::DOUBLE AS s, 1.0::DOUBLE AS ci_low, 1.0::DOUBLE AS ci_high UNION ALL SELECT time, round(s, 6), round(ci_low, 6), round(ci_high, 6) FROM curve")
def km_steps(spark, sf_dir):
    return rounded(plotdata.km_steps(survival.km_curve(survival.event_table(cohort(spark, sf_dir)))))


@query(f"""WITH {COHORT} SELECT CASE WHEN x <= 150000 THEN '<=150000.00' ELSE '>150000.00' END AS "group", count(*) AS n, CAST(sum(event) AS BIGINT) AS events, CAST(count(*) - sum(event) AS BIGINT) AS censored, max(time) AS max_time FROM c GROUP BY 1""")
def binarised_counts(spark, sf_dir):
    return survival.group_counts(cutpoint.at_cutoff(cohort(spark, sf_dir), "x", 150000.0))


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS time, o_orderstatus = 'F' AS event FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def coerced_events(spark, sf_dir):
    coded = F.when(F.col("o_orderstatus") == "F", "1.0").when(F.col("o_orderstatus") == "O", "0").otherwise("unknown")
    return survival.survival_frame(table(spark, sf_dir, "orders").select("o_orderkey", coded.alias("code")), "o_orderkey", "code", lenient=True)


@query("""SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS finished, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def aligned_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relational.aligned({n: o.where(F.col("o_orderstatus") == s).groupBy("o_orderpriority").agg(F.count("*").alias("n")) for n, s in (("finished", "F"), ("open", "O"))}, "o_orderpriority", "n")


@query("""SELECT o_orderkey AS "key", o_custkey AS "customer.id", o_totalprice AS "customer.spent.total" FROM orders""")
def flattened_orders(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_totalprice").alias("total")).alias("spent")).alias("customer"))
    return relational.flattened(nested)


@query()
def catalogue_blocks(spark, sf_dir):
    return profile.catalogue_blocks(datatype_map_long(spark, sf_dir))


@query()
def curated_profiles_customer(spark, sf_dir):
    edits = spark.createDataFrame([("c_name", True, None, None), ("c_mktsegment", None, "segment", None), ("c_nationkey", None, None, naming.CATEGORICAL)], curate.COL_EDITS)
    return curate.curated_profiles(profile.column_profiles(table(spark, sf_dir, "customer")), curate.column_edits(edits)).drop("tokens")


@query()
def selected_summaries(spark, sf_dir):
    frames = [describe.numerical_summary(table(spark, sf_dir, t).select(*c)).select(F.lit(t).alias("dataset_name"), "name", "n", "mean") for t, c in NUMBERS.items()]
    config = spark.createDataFrame([("a", "lineitem", " l_tax "), ("a", "customer", "c_acctbal"), ("b", "customer", ""), ("b", "customer", "c_nationkey")], "uid string, dataset_name string, column_name string")
    return rounded(tables.selected_summaries(config, frames[0].unionByName(frames[1])))


@query()
def scan_curves(spark, sf_dir):
    return rounded(plotdata.scan_curves(_scan(spark, sf_dir)[0]))


@query()
def capped_medians(spark, sf_dir):
    curve = survival.km_curve(survival.event_table(cohort(spark, sf_dir), ["group"]), ["group"])
    return plotdata.capped_medians(survival.medians(curve, ["group"]))
