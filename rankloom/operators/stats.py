"""Univariate and bivariate statistics. Everything reduces to moments and histograms on Spark; p-values
come from the tests of Spark ML, which read the rows once more."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.bins import cut_ordinal
from rankloom.operators import ordering

#: Spark's tests take at most so many levels of a category; above, there is no p-value (null).
MOST_LEVELS = 10_000


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_vector").transform(df)


def _tested(rows: DataFrame, test: str, label: str) -> list[float | None]:
    """p-values of a test of ``org.apache.spark.ml.stat``, one per entry of ``_vector``; null where undefined.

    Called in the JVM: Python has no wrapper for the tests of variance.
    """
    spark = rows.sparkSession
    test = getattr(spark._jvm.org.apache.spark.ml.stat, test)
    found = DataFrame(test.test(rows._jdf, "_vector", label, True), spark).orderBy("featureIndex").collect()
    return [None if math.isnan(r["pValue"]) else r["pValue"] for r in found]


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Levels of a category as the numbers that Spark's tests take."""
    texts = df.withColumn(f"{name}_text", F.col(column).cast("string"))
    return StringIndexer(inputCol=f"{name}_text", outputCol=name, stringOrderType="alphabetAsc").fit(texts).transform(texts)


def correlation_p(pairs: DataFrame, r: float | None, n: int) -> float | None:
    """Two-sided p-value of the correlation ``r`` of ``x`` and ``y`` over ``n`` complete pairs.

    The F test of a regression on one feature is the t test of its correlation. Null below three pairs
    and for a constant column; zero for pairs on a line.
    """
    if n < 3 or r is None or math.isnan(r):
        return None
    if abs(r) >= 1.0:
        return 0.0
    return _tested(_vectors(pairs, ["x"]), "FValueTest", "y")[0]


def correlation(x: str, y: str) -> Column:
    """Pearson's r over complete pairs; null for a constant column, which ``corr`` divides by zero for."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def skewness_sample(value: str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(value)
    factor = F.sqrt(n * (n - 1).cast("double")) / (n - 2)
    return F.when(n > 2, F.skewness(value) * factor)


def kurtosis_sample(value: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(value).cast("double")
    scaled = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, scaled)


def numeric_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, location, spread, quartiles and shape of one column."""
    by = list(by)
    grouped = df.groupBy(*by)
    moments = grouped.agg(
        F.count(value).alias("n_valid"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("n_missing"),
        F.count(F.lit(1)).alias("n_total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        skewness_sample(value).alias("skewness"),
        kurtosis_sample(value).alias("kurtosis"),
    )
    hist, size = ordering.session.measured(ordering.histogram(df, by, value))
    middle = ordering.quantiles(
        hist, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, at_most=size
    )
    mode = hist.groupBy(*by).agg(
        F.max_by(value, F.struct("_n", -F.col(value))).alias("mode")
    )
    out = ordering.attach(ordering.attach(moments, middle, by), mode, by)
    return out.withColumns(
        {"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1")}
    )


def categorical_summary(df: DataFrame, value: str, rare_below: float = 5.0) -> DataFrame:
    """One row per category: count, percent of the non-missing, rank, rare flag, totals."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    counts, size = ordering.session.measured(counts)
    totals = counts.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count(value).alias("cardinality"),
    )
    present = counts.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(totals))  # one row
    percent = F.col("n") * 100.0 / (F.col("n_total") - F.col("n_missing"))
    ranked = ordering.group_rank(
        present, [], [F.desc("n"), F.asc(value)], "place", at_most=size
    )
    return ranked.withColumn("percent", percent).withColumn("rare", F.col("percent") < rare_below)


def linear_relation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """n, Pearson r, slope, intercept and R-squared over complete pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        correlation(x, y).alias("pearson_r"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"),
    )


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "spearman_rho"):
    """Rank correlation per ``by`` over complete pairs, with ``n``."""
    return _rank_correlation(complete_pairs(df, x, y, "pearson", by), by, name, "average")


def _rank_correlation(pairs: DataFrame, by: Sequence[str], name: str, ties: str) -> DataFrame:
    """Correlation of the ranks of ``x`` and ``y`` per ``by``, with ``n``; null where a side has one rank.

    Equal pairs collapse before any row is ranked; ranks go to the distinct pairs.
    """
    joint = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("_w"))
    joint, _ = ordering.session.measured(joint)
    ranked = ordering.average_rank(joint, by, "x", "_rx", ties=ties, weight="_w")
    ranked = ordering.average_rank(ranked, by, "y", "_ry", ties=ties, weight="_w")
    a, b, w = F.col("_rx").cast("double"), F.col("_ry").cast("double"), F.col("_w")
    sums = ranked.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("_a"), F.sum(w * b).alias("_b"), F.sum(w * a * b).alias("_ab"),
        F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"),
        ((F.min(a) < F.max(a)) & (F.min(b) < F.max(b))).alias("_varies"),
    )
    n = F.col("n")

    def moment(product, one, other):
        return F.col(product) / n - (F.col(one) / n) * (F.col(other) / n)

    r = moment("_ab", "_a", "_b") / F.sqrt(moment("_aa", "_a", "_a") * moment("_bb", "_b", "_b"))
    return sums.select(*by, F.when(F.col("_varies"), r).alias(name), "n")


def complete_pairs(df: DataFrame, x: str, y: str, method: str, by: Sequence[str] = ()) -> DataFrame:
    """``*by, x, y`` of the rows that have both: the values, or their ranks with ties averaged."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    if method == "pearson":
        return pairs.select(*by, F.col("_x").alias("x"), F.col("_y").alias("y"))
    if method != "spearman":
        raise ValueError(f"unknown method {method!r}")
    ranked = ordering.average_rank(pairs, by, "_x", "_rx")
    ranked = ordering.average_rank(ranked, by, "_y", "_ry")
    return ranked.select(*by, F.col("_rx").cast("double").alias("x"), F.col("_ry").cast("double").alias("y"))


def _pairs(columns: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(a).cast("double").alias("x"),
                F.col(b).cast("double").alias("y"),
            )
            for a, b in combinations(columns, 2)
        ]
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], method: str = "pearson", min_periods: int = 30
) -> DataFrame:
    """One row per column pair: ``a, b, n, r`` (``r`` is null below ``min_periods`` pairs)."""
    long = df.select(F.explode(_pairs(columns)).alias("_p")).select("_p.*")
    if method == "pearson":
        out = complete_pairs(long, "x", "y", method, ["a", "b"]).groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("r")
        )
    elif method in ("spearman", "spearman_min"):
        pairs = complete_pairs(long, "x", "y", "pearson", ["a", "b"])
        out = _rank_correlation(pairs, ["a", "b"], "r", "min" if method == "spearman_min" else "average")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select("a", "b", "n", F.when(F.col("n") >= min_periods, F.col("r")).alias("r"))


def correlation_significance(
    df: DataFrame, columns: Sequence[str], method: str = "pearson", min_periods: int = 30
) -> DataFrame:
    """:func:`correlation_matrix` with ``p_value``: a test per pair of columns, over their complete pairs."""
    held = ordering.session.stage(correlation_matrix(df, columns, method, min_periods))
    tested = [
        (r.a, r.b, correlation_p(complete_pairs(df, r.a, r.b, method), r.r, r.n)) for r in held.collect()
    ]
    values = df.sparkSession.createDataFrame(tested, "a string, b string, p_value double")
    return held.join(F.broadcast(values), ["a", "b"])  # one row per pair of columns


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed counts with both marginals and the expected count (non-empty cells)."""
    cells = (
        df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    cells, size = ordering.session.measured(cells)
    out = ordering.with_group_stats(cells, [first], [F.sum("observed").alias("row_total")], size)
    out = ordering.with_group_stats(out, [second], [F.sum("observed").alias("col_total")], size)
    total = cells.agg(F.sum("observed").alias("total"))
    out = out.crossJoin(F.broadcast(total))  # one-row side
    return out.withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))


def chi_square(df: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """Independence test with Cramer's V; Yates-corrected for 2x2 tables.

    Empty cells need no rows: sum((o-e)^2/e) equals N (sum(o^2/(r c)) - 1). The p-value is that of Spark's
    test, and of the normal tail (one degree of freedom) where the statistic is corrected.
    """
    cells, size = ordering.session.measured(contingency(df, first, second))
    rows = cells.groupBy(first).agg(F.min("row_total").alias("m"))
    cols = cells.groupBy(second).agg(F.min("col_total").alias("m"))
    row_facts = rows.agg(F.count(F.lit(1)).alias("_r"), F.sum(1.0 / F.col("m")).alias("_inv_r"))
    col_facts = cols.agg(F.count(F.lit(1)).alias("_c"), F.sum(1.0 / F.col("m")).alias("_inv_c"))
    sums = cells.agg(
        F.max("total").alias("n"),
        F.sum(F.col("observed") * F.col("observed") / (F.col("row_total") * F.col("col_total")))
        .alias("_s"),
        F.max(F.abs(F.col("observed") - F.col("expected"))).alias("_gap"),
    )
    # Expected counts below 5: for each row total r, columns with c < 5 N / r, by one sorted sweep.
    total = sums.select("n")
    bars = rows.crossJoin(F.broadcast(total)).select(  # one-row side
        (5.0 * F.col("n") / F.col("m")).alias("at"), F.lit(0).cast("long").alias("w")
    )
    marks = cols.select(F.col("m").cast("double").alias("at"), F.lit(1).cast("long").alias("w"))
    # At equal positions the bar comes first: the comparison is strict.
    swept = ordering.running_total(
        bars.unionByName(marks), [], [F.asc("at"), F.asc("w")], "w", "_below", at_most=2 * size
    )
    low = swept.filter("w = 0").agg(F.coalesce(F.sum("_below"), F.lit(0)).alias("low_expected_cells"))
    joined = sums.crossJoin(row_facts).crossJoin(col_facts).crossJoin(low)  # one-row tables
    two_by_two = (F.col("_r") == 2) & (F.col("_c") == 2)
    shrunk = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    corrected = shrunk * shrunk * F.col("n") * F.col("_inv_r") * F.col("_inv_c")
    chi2 = F.when(two_by_two, corrected).otherwise(F.col("n") * (F.col("_s") - 1.0))
    out = joined.withColumns(
        {"chi2": chi2, "dof": (F.col("_r") - 1) * (F.col("_c") - 1)}
    )
    v = F.sqrt(F.col("chi2") / (F.col("n") * (F.least("_r", "_c") - 1)))
    out = ordering.session.stage(out.withColumn("cramers_v", v))
    out = out.withColumn("p_value", F.lit(_chi_square_p(df, first, second, out.first())).cast("double"))
    effect = (
        F.when(F.col("cramers_v") < 0.1, "negligible").when(F.col("cramers_v") < 0.3, "weak")
        .when(F.col("cramers_v") < 0.5, "moderate").otherwise("strong")
    )
    return out.select(
        "n", "chi2", "dof", "p_value", "cramers_v", effect.alias("effect"),
        (F.col("p_value") < alpha).alias("significant"), "low_expected_cells",
    )


def _chi_square_p(df: DataFrame, first: str, second: str, found: T.Row) -> float | None:
    if not found["dof"] or max(found["_r"], found["_c"]) > MOST_LEVELS:
        return None
    if found["_r"] == found["_c"] == 2:
        return math.erfc(math.sqrt(found["chi2"] / 2))
    held = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        F.col(first).alias("_a"), F.col(second).alias("_b"))
    rows = _vectors(_numbered(_numbered(held, "_a", "_first"), "_b", "_second"), ["_first"])
    return _tested(rows, "ChiSquareTest", "_second")[0]


def group_descriptives(df: DataFrame, category: str, value: str) -> DataFrame:
    """Count, mean, median, std, min and max per category."""
    held = df.filter(F.col(category).isNotNull() & F.col(value).isNotNull())
    stats = held.groupBy(category).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.var_samp(value).alias("_var"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    medians = ordering.group_median(held, [category], value, "median")
    return stats.join(medians, category)


def _anova(stats: DataFrame, n: str, mean: str, var: str) -> DataFrame:
    """F statistic, eta squared and degrees of freedom from per-group moments."""
    total = stats.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"),
        (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("_grand"),
        F.sum((F.col(n) - 1) * F.coalesce(F.col(var), F.lit(0.0))).alias("_within"),
        F.sum(F.col(n) * F.col(mean) * F.col(mean)).alias("_squares"),
    )
    between = F.col("_squares") - F.col("n") * F.col("_grand") * F.col("_grand")
    return total.select(
        "k", "n",
        (between / (F.col("k") - 1) / (F.col("_within") / (F.col("n") - F.col("k")))).alias("f"),
        (between / F.nullif(between + F.col("_within"), F.lit(0.0))).alias("eta_squared"),
    )


def _anova_p(df: DataFrame, category: str, values: Sequence[str], levels: int) -> list[float | None]:
    """p-values of one-way ANOVA, a value column each; null where nothing varies inside the groups."""
    if levels > MOST_LEVELS:
        return [None] * len(values)
    return _tested(_vectors(_numbered(df, category, "_level"), values), "ANOVATest", "_level")


def category_effect(df: DataFrame, category: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t (two groups, Cohen's d) or one-way ANOVA (eta squared), with Levene's test.

    Levene is ANOVA on absolute deviations from the group medians. Spark has no test for unequal variances:
    ``p_value`` and ``significant`` are null for Welch's t.
    """
    held = df.filter(F.col(category).isNotNull() & F.col(value).isNotNull()).select(
        category, F.col(value).cast("double").alias(value)
    )
    stats, size = ordering.session.measured(group_descriptives(held, category, value))
    if size < 2:
        raise ValueError(f"need at least 2 groups, found {size}")
    away = ordering.attach(held, stats.select(category, "median"), [category], at_most=size)
    away = away.withColumn("_d", F.abs(F.col(value) - F.col("median")))
    levels = ordering.session.stage(away.select(category, F.col(value).alias("_value"), "_d"))
    tests = _anova_p(levels, category, ["_value", "_d"], size)
    spread = levels.groupBy(category).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_m"), F.var_samp("_d").alias("_v")
    )
    levene = _anova(spread, "_n", "_m", "_v").select(F.col("f").alias("levene"))
    if size == 2:
        sides = stats.agg(*[
            expression.alias(f"{part}{i}")
            for i, pick in ((1, F.min_by), (2, F.max_by))
            for part, expression in (
                ("n", pick("count", category)), ("m", pick("mean", category)),
                ("v", pick("_var", category)),
            )
        ])
        e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
        pooled = F.sqrt(
            ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"))
            / (F.col("n1") + F.col("n2") - 2)
        )
        gap = F.col("m1") - F.col("m2")
        tested = sides.select(
            F.lit("Welch's t-test").alias("test"), (gap / F.sqrt(e1 + e2)).alias("statistic"),
            (gap / pooled).alias("effect_size"), F.lit(None).cast("double").alias("p_value"),
        )
        cuts = (0.2, 0.5, 0.8)
    else:
        tested = _anova(stats, "count", "mean", "_var").select(
            F.lit("One-way ANOVA").alias("test"), F.col("f").alias("statistic"),
            F.col("eta_squared").alias("effect_size"), F.lit(tests[0]).cast("double").alias("p_value"),
        )
        cuts = (0.01, 0.06, 0.14)
    size_of = F.abs(F.col("effect_size"))
    effect = (
        F.when(size_of < cuts[0], "negligible").when(size_of < cuts[1], "small")
        .when(size_of < cuts[2], "medium").otherwise("large")
    )
    out = tested.crossJoin(levene)  # one-row tables
    return out.select(
        "test", "statistic", "p_value", "effect_size", effect.alias("effect"),
        (F.col("p_value") < alpha).alias("significant"), "levene",
        F.lit(tests[1]).cast("double").alias("levene_p"),
    )


def numeric_relation(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Pearson and Spearman with p-values, R-squared, slope, intercept."""
    linear = linear_relation(df, x, y)
    ranked = spearman(df, x, y).select("spearman_rho")
    out = ordering.session.stage(linear.crossJoin(ranked))  # one-row tables
    found = out.first()
    for name, of, method in (("pearson_p", "pearson_r", "pearson"), ("spearman_p", "spearman_rho", "spearman")):
        tested = correlation_p(complete_pairs(df, x, y, method), found[of], found["n"])
        out = out.withColumn(name, F.lit(tested).cast("double"))
    return out.withColumn("significant", F.col("pearson_p") < alpha)


def decile_edges(df: DataFrame, value: str, parts: int = 10) -> list[float]:
    """Distinct decile edges (at most ``parts + 1`` numbers)."""
    wanted = {f"e{i}": i / parts for i in range(parts + 1)}
    row = ordering.group_quantiles(df, [], value, wanted).first()
    return sorted({row[name] for name in wanted})


def binned_relationship(
    df: DataFrame, x: str, y: str, group: str | None = None, bins: Sequence[float] | None = None
) -> DataFrame:
    """Per (group, bin of x): count, quartiles of y and the bin's median x over all groups."""
    held = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    held = held.withColumn("group", F.col(group).cast("string") if group else F.lit("all"))
    held = held.filter(F.col("group").isNotNull())
    edges = list(bins) if bins is not None else decile_edges(held, x)
    binned = held.withColumn("bin", cut_ordinal(F.col(x), edges, include_lowest=True)).filter(
        F.col("bin").isNotNull()
    )
    shape = ordering.group_quantiles(
        binned, ["group", "bin"], y, {"q1": 0.25, "median": 0.5, "q3": 0.75}, rows="count"
    )
    centres = ordering.group_median(binned, ["bin"], x, "centre")
    return shape.join(centres, "bin")


def discrete_distribution(
    df: DataFrame, value: str, group: str, levels: Sequence[int]
) -> DataFrame:
    """Share of each exact level inside each group, unobserved levels included."""
    held = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = held.groupBy(group, F.col(value).cast("long").alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy(group).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values")
    )
    grid = totals.withColumn(
        "level", F.explode(F.array(*[F.lit(int(v)).cast("long") for v in levels]))
    )
    out = grid.join(counts, [group, "level"], "left")
    return out.select(
        group, "level", F.coalesce("n", F.lit(0)).alias("n"), "total", "distinct_values",
        (F.coalesce("n", F.lit(0)) * 100.0 / F.col("total")).alias("percent"),
    )


def group_composition(df: DataFrame, category: str, breakdown: str, panel: str) -> DataFrame:
    """Percent of each breakdown level inside (panel, category), with the category's size."""
    held = df.filter(
        F.col(category).isNotNull() & F.col(breakdown).isNotNull() & F.col(panel).isNotNull()
    )
    counts = held.groupBy(panel, category, breakdown).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(panel, category).agg(F.sum("n").alias("size"))
    return counts.join(sizes, [panel, category]).withColumn(
        "percent", F.col("n") * 100.0 / F.col("size")
    )
