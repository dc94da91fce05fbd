"""Leave-one-out aggregates: what a row's group looks like without the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ordering, quality

NEIGHBOURHOOD_KEY = ("city", "neighbourhood_cleansed")


def middle_values(
    df: DataFrame, group: Sequence[str], value: str, hot_rows: int | None = None
) -> DataFrame:
    """Per group: size ``_n`` and the order statistics a leave-one-out median can land on.

    Without row x the median sits at one or two positions; removing x moves a position up by one
    exactly when x is at or below it. So at most three neighbouring order statistics decide the
    answer for every row of the group, and they come out of a histogram.
    """
    hist, size = ordering.session.measured(ordering.histogram(df, group, value))
    placed = ordering.running_total(
        hist,
        group,
        [F.col(value).asc()],
        "_n",
        "_before",
        "_total",
        hot_rows=hot_rows,
        at_most=size,
    )
    n = F.col("_total")
    # Positions (0-based) of the lower and upper middle once one row is gone.
    low, high = F.floor((n - 2) / 2), F.floor((n - 1) / 2)

    def at(position: Column, name: str) -> Column:
        inside = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value))).alias(name)

    return placed.groupBy(*group).agg(
        F.max("_total").alias("_total"),
        at(low, "_low"),
        at(low + 1, "_low_next"),
        at(high, "_high"),
        at(high + 1, "_high_next"),
    )


def leave_one_out_median(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "loo_median",
    count: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Median of the other rows of the group; null for a lone row. ``count`` adds their number.

    ``value`` must not be null (see :func:`require_complete`).
    """
    stats = middle_values(df, group, value, hot_rows)
    x = F.col(value)
    low = F.when(x <= F.col("_low"), F.col("_low_next")).otherwise(F.col("_low"))
    high = F.when(x <= F.col("_high"), F.col("_high_next")).otherwise(F.col("_high"))
    out = ordering.attach(df, stats, group)
    median = F.when(F.col("_total") >= 2, (low + high) / 2.0)
    columns = {name: median}
    if count is not None:
        columns[count] = F.col("_total") - 1
    return out.withColumns(columns).drop("_total", "_low", "_low_next", "_high", "_high_next")


def leave_one_out_count(df: DataFrame, group: Sequence[str], name: str = "others") -> DataFrame:
    """How many other rows share the group."""
    return ordering.with_group_stats(
        df, group, [(F.count(F.lit(1)) - 1).alias(name)]
    )


def leave_one_out_mean(
    df: DataFrame, group: Sequence[str], value: str, name: str = "loo_mean"
) -> DataFrame:
    """Mean of the other rows; null for a lone row. Used to *show* that a label mean leaks."""
    out = ordering.with_group_stats(
        df, group, [F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n")]
    )
    mean = (F.col("_sum") - F.col(value)) / F.nullif(F.col("_n") - 1, F.lit(0).cast("long"))
    return out.withColumn(name, mean).drop("_sum", "_n")


def require_complete(df: DataFrame, value: str) -> None:
    """Stop on a null that would silently shift its group's median."""
    quality.require(df, {f"{value} is null": F.col(value).isNull()})


def neighbourhood_features(
    df: DataFrame, key: Sequence[str] = NEIGHBOURHOOD_KEY, price: str = "price"
) -> DataFrame:
    """``nbhd_listings``, ``nbhd_median_price`` and ``price_vs_nbhd``."""
    out = leave_one_out_median(df, key, price, "nbhd_median_price", "nbhd_listings")
    return out.withColumn(
        "price_vs_nbhd", F.try_divide(F.col(price), F.col("nbhd_median_price"))
    )
