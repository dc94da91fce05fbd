"""Exploratory statistics on the driver's tables. p-values have no SQL twin and are tested apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.common import r_sql, rounded, table
from rankloom.operators import stats

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


_SUMMARY = ["mean", "median", "std", "variance", "range", "iqr", "q1", "q3", "skewness", "kurtosis"]


@register("""
SELECT l_returnflag, count(v) AS n_valid, count(*) - count(v) AS n_missing, count(*) AS n_total,
  """ + ", ".join(r_sql(e, 5) + f" AS {n}" for n, e in (
    ("mean", "avg(v)"), ("median", "median(v)"), ("std", "stddev_samp(v)"), ("variance", "var_samp(v)"),
    ("range", "max(v) - min(v)"), ("iqr", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"),
    ("q1", "quantile_cont(v, 0.25)"), ("q3", "quantile_cont(v, 0.75)"),
    ("skewness", "skewness(v)"), ("kurtosis", "kurtosis(v)"))) + """,
  min(v) AS min, max(v) AS max, (SELECT v FROM (SELECT l_returnflag AS f, l_quantity AS v, count(*) AS n FROM lineitem
    WHERE l_quantity > 3 GROUP BY ALL) h WHERE f = l_returnflag ORDER BY n DESC, v LIMIT 1) AS mode
FROM (SELECT l_returnflag, CASE WHEN l_quantity > 3 THEN l_quantity END AS v FROM lineitem) GROUP BY l_returnflag""")
def numeric_summary(spark, folder):
    """Location, spread, quartiles, mode and bias-corrected shape per group."""
    lines = table(spark, folder, "lineitem").withColumn(
        "v", F.when(F.col("l_quantity") > 3, F.col("l_quantity"))
    )
    return rounded(stats.numeric_summary(lines, "v", ["l_returnflag"]), *_SUMMARY, places=5)


@register("""
WITH c AS (SELECT nullif(event_type, 'error') AS event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, CAST(coalesce(sum(n) FILTER (event_type IS NULL), 0) AS BIGINT) AS n_missing,
  count(event_type) AS cardinality FROM c)
SELECT event_type, n, n_total, n_missing, cardinality, row_number() OVER (ORDER BY n DESC, event_type) AS place,
  """ + r_sql("n * 100.0 / (n_total - n_missing)") + """ AS percent, n * 100.0 / (n_total - n_missing) < 25 AS rare
FROM c, t WHERE event_type IS NOT NULL""")
def categorical_summary(spark, folder):
    """Counts, shares, rank and rare levels."""
    events = table(spark, folder, "events").withColumn(
        "event_type", F.when(F.col("event_type") != "error", F.col("event_type"))
    )
    return rounded(stats.categorical_summary(events, "event_type", rare_below=25.0), "percent")


_LINEAR = ["pearson_r", "slope", "intercept", "r_squared"]


@register("""
SELECT l_returnflag, count(*) AS n, """ + ", ".join(r_sql(e, 5) + f" AS {n}" for n, e in (
    ("pearson_r", "corr(l_quantity, l_extendedprice)"), ("slope", "regr_slope(l_extendedprice, l_quantity)"),
    ("intercept", "regr_intercept(l_extendedprice, l_quantity)"), ("r_squared", "regr_r2(l_extendedprice, l_quantity)")))
          + " FROM lineitem GROUP BY ALL")
def scatter_statistics(spark, folder):
    """Correlation and trend line."""
    lines = table(spark, folder, "lineitem")
    out = stats.linear_relation(lines, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(out, *_LINEAR, places=5)


_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_COMBOS = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1:]]
_RK = ("rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}")


@register(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r_sql(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in _COMBOS))
def pearson_matrix(spark, folder):
    """Pairwise Pearson correlations."""
    out = stats.correlation_matrix(table(spark, folder, "lineitem"), _COLUMNS)
    return rounded(out, "r")


@register("WITH k AS (SELECT " + ", ".join(_RK.format(c=c) for c in _COLUMNS) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {r_sql(f'corr({a}, {b})')} AS r FROM k" for a, b in _COMBOS))
def spearman_matrix(spark, folder):
    """Pairwise rank correlations with averaged ties."""
    out = stats.correlation_matrix(table(spark, folder, "lineitem"), _COLUMNS, "spearman")
    return rounded(out, "r")


@register()
def correlation_significance(spark, folder):
    """The same with two-sided p-values."""
    out = stats.correlation_significance(table(spark, folder, "lineitem"), _COLUMNS)
    return rounded(out, "r", "p_value")


@register("""
WITH c AS (SELECT event_type AS a, hour(ts) AS b, count(*) AS o FROM events GROUP BY ALL),
r AS (SELECT a, sum(o) AS rt FROM c GROUP BY ALL), k AS (SELECT b, sum(o) AS ct FROM c GROUP BY ALL),
t AS (SELECT sum(o) AS n FROM c),
f AS (SELECT a, b, coalesce(o, 0) AS o, rt * ct / CAST(n AS DOUBLE) AS e, n FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b)),
x AS (SELECT CAST(min(n) AS BIGINT) AS n, sum((o - e) * (o - e) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
  least(count(DISTINCT a), count(DISTINCT b)) - 1 AS m, count(*) FILTER (e < 85) AS low_expected_cells FROM f)
SELECT n, """ + r_sql("chi2", 5) + " AS chi2, CAST(dof AS BIGINT) AS dof, " + r_sql("sqrt(chi2 / (n * m))") + """ AS cramers_v,
  'negligible' AS effect FROM x""")
def chi_square_independence(spark, folder):
    """Chi-square, degrees of freedom and Cramer's V."""
    events = table(spark, folder, "events").withColumn("hour", F.hour("ts"))
    out = stats.chi_square(events, "event_type", "hour")
    out = rounded(rounded(out, "cramers_v"), "chi2", places=5)
    return out.select("n", "chi2", "dof", "cramers_v", "effect")


@register("""
WITH c AS (SELECT o_orderstatus = 'F' AS a, o_totalprice > 250000 AS b, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY ALL),
f AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
SELECT CAST(sum(o) AS BIGINT) AS n, """ + r_sql("sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e)", 5) + """ AS chi2,
  CAST(1 AS BIGINT) AS dof, CAST(count(*) FILTER (e < 5) AS BIGINT) AS low_expected_cells FROM f""")
def chi_square_two_by_two(spark, folder):
    """The continuity-corrected 2x2 case."""
    orders = table(spark, folder, "orders").withColumns(
        {"a": F.col("o_orderstatus") == "F", "b": F.col("o_totalprice") > 250_000}
    )
    out = rounded(stats.chi_square(orders, "a", "b"), "chi2", places=5)
    return out.select("n", "chi2", "dof", "low_expected_cells")


@register("""
SELECT p_type, count(*) AS count, """ + ", ".join(r_sql(e, 4) + f" AS {n}" for n, e in (
    ("mean", "avg(p_size)"), ("median", "median(p_size)"), ("std", "stddev_samp(p_size)"))) + """,
  min(p_size) AS min, max(p_size) AS max FROM part GROUP BY ALL""")
def group_descriptives(spark, folder):
    """Count, mean, median, spread and range per category."""
    out = stats.group_descriptives(table(spark, folder, "part"), "p_type", "p_size")
    return rounded(out, "mean", "median", "std", places=4).drop("_var")


_ANOVA = """(sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)
  / (sum((n - 1) * v) / (sum(n) - count(*)))"""


@register(f"""
WITH b AS (SELECT c_mktsegment AS g, c_acctbal AS x, abs(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS d FROM customer),
s AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM b GROUP BY ALL),
l AS (SELECT g, count(*) AS n, avg(d) AS m, var_samp(d) AS v FROM b GROUP BY ALL)
SELECT 'One-way ANOVA' AS test, (SELECT {r_sql(_ANOVA, 5)} FROM s) AS statistic,
  (SELECT {r_sql('(sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (sum(n * m * m) - pow(sum(n * m), 2) / sum(n) + sum((n - 1) * v))')} FROM s) AS effect_size,
  (SELECT {r_sql(_ANOVA, 5)} FROM l) AS levene""")
def anova_effect(spark, folder):
    """One-way ANOVA with eta squared and Levene's statistic."""
    out = stats.category_effect(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal")
    out = rounded(rounded(out, "effect_size"), "statistic", "levene", places=5)
    return out.select("test", "statistic", "effect_size", "levene")


@register("""
WITH b AS (SELECT l_linestatus AS g, l_extendedprice AS x FROM lineitem),
s AS (SELECT count(*) FILTER (g = 'F') AS n1, avg(x) FILTER (g = 'F') AS m1, var_samp(x) FILTER (g = 'F') AS v1,
  count(*) FILTER (g = 'O') AS n2, avg(x) FILTER (g = 'O') AS m2, var_samp(x) FILTER (g = 'O') AS v2 FROM b)
SELECT 'Welch''s t-test' AS test, """ + r_sql("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)", 5) + " AS statistic, "
          + r_sql("(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))") + " AS effect_size FROM s")
def welch_effect(spark, folder):
    """Welch's t with Cohen's d for two groups."""
    out = stats.category_effect(table(spark, folder, "lineitem"), "l_linestatus", "l_extendedprice")
    out = rounded(rounded(out, "effect_size"), "statistic", places=5)
    return out.select("test", "statistic", "effect_size")


@register("WITH k AS (SELECT *, " + _RK.format(c="p_size").replace("AS p_size", "AS rx") + ", "
          + _RK.format(c="p_retailprice").replace("AS p_retailprice", "AS ry") + """ FROM part)
SELECT count(*) AS n, """ + ", ".join(r_sql(e, 5) + f" AS {n}" for n, e in (
    ("pearson_r", "corr(p_size, p_retailprice)"), ("spearman_rho", "corr(rx, ry)"),
    ("r_squared", "regr_r2(p_retailprice, p_size)"), ("slope", "regr_slope(p_retailprice, p_size)"),
    ("intercept", "regr_intercept(p_retailprice, p_size)"))) + " FROM k")
def numeric_relation(spark, folder):
    """Pearson, Spearman, R-squared, slope and intercept."""
    out = stats.numeric_relation(table(spark, folder, "part"), "p_size", "p_retailprice")
    out = rounded(out, *_LINEAR, "spearman_rho", places=5)
    return out.select("n", *_LINEAR, "spearman_rho")


_BINS = (0, 10, 20, 30, 50)


@register("""
WITH b AS (SELECT l_returnflag AS "group", CAST(CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1
    WHEN l_quantity <= 30 THEN 2 ELSE 3 END AS INT) AS bin, l_quantity AS x, l_extendedprice AS y FROM lineitem),
c AS (SELECT bin, median(x) AS centre FROM b GROUP BY ALL)
SELECT b.bin, b."group", """ + ", ".join(r_sql(e, 4) + f" AS {n}" for n, e in (
    ("q1", "quantile_cont(y, 0.25)"), ("median", "median(y)"), ("q3", "quantile_cont(y, 0.75)"), ("centre", "min(centre)")))
          + """, count(*) AS count FROM b JOIN c USING (bin) GROUP BY b.bin, b."group" """)
def binned_relationship(spark, folder):
    """Quartiles of one variable per bin of another, per group."""
    out = stats.binned_relationship(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", _BINS
    )
    return rounded(out, "q1", "median", "q3", "centre", places=4)


@register("""
WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM lineitem),
b AS (SELECT l_quantity AS y, (SELECT greatest(count(*) FILTER (e < l_extendedprice), 1) - 1 FROM e) AS bin FROM lineitem)
SELECT CAST(bin AS INT) AS bin, count(*) AS count, """ + r_sql("median(y)", 4) + " AS median FROM b GROUP BY ALL")
def decile_relationship(spark, folder):
    """Default decile bins."""
    out = stats.binned_relationship(
        table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity"
    )
    return rounded(out, "median", places=4).select("bin", "count", "median")


@register("""
WITH c AS (SELECT l_returnflag, l_linenumber AS level, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, count(*) AS total, count(DISTINCT l_linenumber) AS distinct_values FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CAST(level AS BIGINT) AS level, coalesce(n, 0) AS n, total, distinct_values,
  """ + r_sql("coalesce(n, 0) * 100.0 / total") + """ AS percent
FROM t CROSS JOIN (SELECT unnest(range(0, 10)) AS level) LEFT JOIN c USING (l_returnflag, level)""")
def discrete_distribution(spark, folder):
    """Share of each level, unobserved ones included."""
    out = stats.discrete_distribution(
        table(spark, folder, "lineitem"), "l_linenumber", "l_returnflag", range(10)
    )
    return rounded(out, "percent")


@register("""
SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS BIGINT) AS size,
  """ + r_sql("count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus, o_orderpriority)") + """ AS percent
FROM orders GROUP BY o_orderstatus, o_orderpriority, year(o_orderdate)""")
def group_composition(spark, folder):
    """Composition of each category per panel."""
    orders = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    out = stats.group_composition(orders, "o_orderpriority", "y", "o_orderstatus")
    return rounded(out, "percent")
