"""Audit jobs: what the pipeline's choices do to the data, as small result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import neighbourhood, ordering, stats


def counts_with_total(df: DataFrame, by: str, total: str = "total") -> DataFrame:
    """Rows per label plus a total row, by one rollup."""
    rolled = df.filter(F.col(by).isNotNull()).rollup(by).agg(F.count(F.lit(1)).alias("rows"))
    return rolled.select(F.coalesce(by, F.lit(total)).alias(by), "rows")


def lag_distribution(df: DataFrame, by: str, later: Column, earlier: Column) -> DataFrame:
    """Rows per (label, days between two dates)."""
    return df.groupBy(by, F.datediff(later, earlier).alias("lag_days")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def strata_profile(
    df: DataFrame, keys: Sequence[str], value: str, small: int = 5, large: int = 10
) -> DataFrame:
    """One row: strata, singletons, large strata, rows in small strata, nulls no stratum can fill."""
    held = df
    for key in keys:
        held = held.filter(F.col(key).isNotNull())
    sizes = held.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_priced")
    )
    nulls = F.col("_n") - F.col("_priced")
    return sizes.agg(
        F.count(F.lit(1)).alias("strata"),
        F.count(F.when(F.col("_n") == 1, 1)).alias("singletons"),
        F.count(F.when(F.col("_n") >= large, 1)).alias("large_strata"),
        F.coalesce(F.sum(F.when(F.col("_n") < small, F.col("_n"))), F.lit(0)).alias(
            "rows_in_small"
        ),
        F.coalesce(F.sum(F.when(F.col("_priced") == 0, nulls)), F.lit(0)).alias("unfillable"),
    )


def spike_table(df: DataFrame, by: str, label: str) -> DataFrame:
    """Per label: rows, mean, and the percent sitting exactly at 0 and at 1."""
    def percent(condition):
        return F.avg(condition.cast("double")) * 100

    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"),
        percent(F.col(label) == 0.0).alias("at_zero_percent"),
        percent(F.col(label) == 1.0).alias("at_one_percent"),
    )


def cohort(first: Column, anchor: Column, new_days: int = 365) -> Column:
    """``never reviewed``, ``new this year`` or ``established``."""
    return (
        F.when(first.isNull(), "never reviewed")
        .when(F.datediff(anchor, first) < new_days, "new this year")
        .otherwise("established")
    )


def population_evidence(
    df: DataFrame, populations: Mapping[str, Column], medians: Mapping[str, Column],
    shares: Mapping[str, Column],
) -> DataFrame:
    """Overlapping populations side by side: rows, exact medians and percent shares."""
    names = F.array(*[F.when(c, F.lit(n)) for n, c in populations.items()])
    long = df.withColumn("population", F.explode(F.array_compact(names)))
    long = long.withColumns({**medians, **{f"_s_{n}": c for n, c in shares.items()}})
    out = long.groupBy("population").agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.avg(F.col(f"_s_{n}").cast("double")) * 100).alias(n) for n in shares],
    )
    for name in medians:
        found = ordering.group_median(long, ["population"], name, f"median_{name}")
        out = out.join(found, "population", "left")
    return out


def correlation_by_market(
    df: DataFrame, signals: Sequence[str], label: str, market: str
) -> DataFrame:
    """Spearman of each signal with the label: per market, market-demeaned and pooled."""
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals
        ]
    )
    long = df.filter(F.col(market).isNotNull()).select(
        F.col(market).cast("string").alias("scope"), F.col(label).cast("double").alias("y"),
        F.explode(pairs).alias("_p"),
    ).select("scope", "y", "_p.signal", "_p.x")
    centred = ordering.with_group_stats(
        long, ["signal", "scope"], [F.avg("x").alias("_mx"), F.avg("y").alias("_my")]
    )
    # Rounded so that equal values stay tied after the subtraction.
    demeaned = centred.select(
        F.lit("demeaned").alias("scope"), "signal",
        F.round(F.col("x") - F.col("_mx"), 9).alias("x"),
        F.round(F.col("y") - F.col("_my"), 9).alias("y"),
    )
    pooled = long.select(F.lit("pooled").alias("scope"), "signal", "x", "y")
    every = long.select("scope", "signal", "x", "y").unionByName(demeaned).unionByName(pooled)
    return stats.spearman(every, "x", "y", ["signal", "scope"], "rho")


def variance_explained(df: DataFrame, cells: Sequence[str], label: str) -> DataFrame:
    """One row: overall sd, mean within-cell sd and the share of variance the cells explain."""
    per_cell = df.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(label).alias("_sd")
    )
    overall = df.agg(F.var_samp(label).alias("_var"))
    within = per_cell.agg(
        (F.sum(F.col("_sd") * F.col("_sd") * F.col("_n")) / F.sum("_n")).alias("_within"),
        F.avg("_sd").alias("mean_cell_sd"),
    )
    return overall.crossJoin(within).select(  # one-row tables
        F.sqrt("_var").alias("overall_sd"), "mean_cell_sd",
        (1 - F.col("_within") / F.col("_var")).alias("explained"),
    )


def inverted_groups(df: DataFrame, group: Sequence[str], label: str, grade: str) -> DataFrame:
    """Groups where a strictly lower label carries a higher grade somewhere.

    Per group only the lowest and highest grade of each distinct label value matter; the highest
    grade seen at lower labels is then a running maximum over those.
    """
    levels = df.groupBy(*group, label).agg(
        F.min(grade).alias("_low"), F.max(grade).alias("_high")
    )
    # A label level is one row; the label lives on a small grid.
    below = Window.partitionBy(*group).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    flagged = levels.withColumn("_above", F.max("_high").over(below) > F.col("_low"))
    return flagged.groupBy(*group).agg(F.max(F.coalesce("_above", F.lit(False))).alias("inverted"))


def rank_cut(
    df: DataFrame, mask: Column, partition: Sequence[str], label: str, ties: Sequence[str],
    bins: int, offset: int = 0, name: str = "grade",
) -> DataFrame:
    """Quantile the masked rows on their *rank* (ties by row order): the rejected alternative."""
    held = ordering.running_total(
        df.filter(mask), partition, [F.col(label).asc(), *[F.col(c).asc() for c in ties]],
        before="_b", total="_t",
    )
    last = F.greatest(F.col("_t") - 1, F.lit(1).cast("long"))
    place = F.greatest(F.ceil(F.col("_b") * bins / last) - 1, F.lit(0).cast("long"))
    return held.withColumn(name, (place + offset).cast("int")).drop("_b", "_t")


def grading_scheme(
    df: DataFrame, scheme: str, partition: Sequence[str], label: str, ties: Sequence[str],
    name: str = "grade",
) -> DataFrame:
    """Alternative gradings: plain quintiles, both atoms reserved, zero atom with rank cuts, or
    only the one atom reserved."""
    zero, one = F.col(label) == 0.0, F.col(label) == 1.0

    def fixed(mask: Column, grade: int) -> DataFrame:
        return df.filter(mask).withColumn(name, F.lit(grade))

    def cut(mask: Column, bins: int, offset: int) -> DataFrame:
        return rank_cut(df, mask, partition, label, ties, bins, offset, name)

    if scheme == "quintiles":
        return cut(F.col(label).isNotNull(), 5, 0)
    if scheme == "both_atoms":
        return fixed(zero, 0).unionByName(fixed(one, 4)).unionByName(cut(~zero & ~one, 3, 1))
    if scheme == "zero_atom_rank":
        return fixed(zero, 0).unionByName(cut(~zero, 4, 1))
    if scheme == "one_atom":
        return fixed(one, 4).unionByName(cut(~one, 4, 0))
    raise ValueError(f"unknown scheme {scheme!r}")


def scheme_summary(
    df: DataFrame, partition: Sequence[str], label: str, grade: str, cold: Column
) -> DataFrame:
    """One row: percent per grade, percent of rows whose label spans grades, cold share in grade 0."""
    per_value = df.groupBy(*partition, label).agg(
        F.count(F.lit(1)).alias("_n"), (F.min(grade) != F.max(grade)).alias("_split")
    )
    ties = per_value.agg(
        (F.sum(F.when(F.col("_split"), F.col("_n")).otherwise(0)) * 100.0 / F.sum("_n")).alias(
            "split_labels_percent"
        )
    )
    shares = df.agg(
        *[
            (F.avg((F.col(grade) == g).cast("double")) * 100).alias(f"grade_{g}_percent")
            for g in range(5)
        ],
        (F.avg(F.when(cold, (F.col(grade) == 0).cast("double"))) * 100).alias(
            "cold_in_zero_percent"
        ),
    )
    return shares.crossJoin(ties)  # one-row tables


def grade_mix(df: DataFrame, by: str, grade: str) -> DataFrame:
    """Percent of each grade inside each cohort."""
    counts = df.groupBy(by, grade).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, by).select(
        by, grade, (F.col("n") * 100.0 / F.col("_t")).alias("percent")
    )


def group_health(df: DataFrame, group: Sequence[str], grade: str) -> DataFrame:
    """One row: groups, singletons, single-grade groups, mean distinct grades, reach of grade 4."""
    levels = df.groupBy(*group, grade).agg(F.count(F.lit(1)).alias("_n"))
    per_group = levels.groupBy(*group).agg(
        F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_distinct"), F.max(grade).alias("_top")
    )
    many = F.col("_size") > 1
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(~many, 1)).alias("singletons"),
        F.count(F.when(many & (F.col("_distinct") == 1), 1)).alias("zero_variance"),
        F.avg(F.when(many, F.col("_distinct"))).alias("mean_distinct"),
        (F.avg((F.col("_top") == 4).cast("double")) * 100).alias("reaching_top_percent"),
    )


def within_variance_ratio(
    df: DataFrame, group: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Per feature: mean within-group variance over overall variance; all features in two passes."""
    per_group = df.groupBy(*group).agg(*[F.var_samp(f).alias(f) for f in features])
    within = per_group.agg(*[F.avg(f).alias(f) for f in features])
    overall = df.agg(*[F.var_samp(f).alias(f"_all_{f}") for f in features])
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.col(f) / F.nullif(F.col(f"_all_{f}"), F.lit(0.0))).alias("ratio"),
            )
            for f in features
        ]
    )
    return within.crossJoin(overall).select(F.explode(rows).alias("_r")).select("_r.*")  # 1 x 1


def null_report(df: DataFrame, features: Sequence[str], cold: Column) -> DataFrame:
    """Per feature with nulls: count, percent and nulls outside the cold cohort."""
    sums = [F.count(F.lit(1)).alias("_all")]
    for f in features:
        missing = F.col(f).isNull()
        sums.append(F.count(F.when(missing, 1)).alias(f"_n_{f}"))
        sums.append(F.count(F.when(missing & ~cold, 1)).alias(f"_b_{f}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"_n_{f}").alias("nulls"),
                (F.col(f"_n_{f}") * 100.0 / F.col("_all")).alias("percent"),
                F.col(f"_b_{f}").alias("beyond_cold"),
            )
            for f in features
        ]
    )
    return df.agg(*sums).select(F.explode(rows).alias("_r")).select("_r.*").filter("nulls > 0")


def within_group_spearman(
    df: DataFrame, group: Sequence[str], x: str, y: str, larger_than: int = 10
) -> DataFrame:
    """Rank correlation inside every group above a size where both sides vary."""
    per_group = stats.spearman(df, x, y, group, "rho")
    return per_group.filter((F.col("n") > larger_than) & F.col("rho").isNotNull() & ~F.isnan("rho"))


def spearman_summary(per_group: DataFrame) -> DataFrame:
    """One row: groups scored, mean, share positive, share at exactly -1."""
    return per_group.agg(
        F.count(F.lit(1)).alias("groups_scored"), F.avg("rho").alias("mean_rho"),
        F.avg((F.col("rho") > 0).cast("double")).alias("share_positive"),
        F.avg((F.col("rho") <= -0.9999).cast("double")).alias("share_minus_one"),
    )


def label_leak_proof(
    df: DataFrame, place: Sequence[str], group: Sequence[str], label: str
) -> DataFrame:
    """Leave-one-out label means against the label inside groups nested in one place."""
    nested = df.groupBy(*group).agg(F.min(F.struct(*place)).alias("_a"), F.max(F.struct(*place))
                                    .alias("_b"))
    nested = nested.filter(F.col("_a").eqNullSafe(F.col("_b"))).select(*group)
    leaky = neighbourhood.leave_one_out_mean(df, place, label, "_loo")
    # Rounded so that float noise cannot break ties the label has.
    held = ordering.attach(leaky, nested, group, "left_semi").withColumn(
        "_loo", F.round("_loo", 9)
    )
    return spearman_summary(within_group_spearman(held, group, "_loo", label, larger_than=2))


def loo_gap(df: DataFrame, place: Sequence[str], price: str) -> DataFrame:
    """How far the leave-one-out median sits from the plain one, on average."""
    plain = ordering.group_median(df, place, price, "_plain")
    both = ordering.attach(
        neighbourhood.leave_one_out_median(df, place, price, "_loo"), plain, place
    )
    gap = F.avg(F.abs(F.col("_loo") - F.col("_plain")))
    middle = ordering.group_median(df, [], price, "_middle")
    return both.agg(gap.alias("mean_gap")).crossJoin(middle).select(  # one-row tables
        "mean_gap", (F.col("mean_gap") / F.col("_middle") * 100).alias("percent_of_median")
    )


def banded_spread(df: DataFrame, band: Column, value: str) -> DataFrame:
    """Rows, mean and sample sd of a value per band."""
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def difference_by_fold(
    first: DataFrame, second: DataFrame, folds: DataFrame, group: Sequence[str], fold: str,
    value: str = "ndcg",
) -> DataFrame:
    """Mean of two per-group metrics and of their difference, per fold and overall (rollup)."""
    joined = (
        first.select(*group, F.col(value).alias("a"))
        .join(second.select(*group, F.col(value).alias("b")), list(group))
        .join(folds.select(*group, fold), list(group))
    )
    rolled = joined.rollup(fold).agg(
        F.count("a").alias("groups"), F.avg("a").alias("first"), F.avg("b").alias("second"),
        F.avg(F.col("a") - F.col("b")).alias("difference"),
    )
    return rolled.withColumn(fold, F.coalesce(F.col(fold).cast("string"), F.lit("population")))
