"""Does a score mean the same thing in two groups? Pairwise accuracy within and across groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import metrics, ordering

MIN_PAIRS = 200
GRADES = (0, 1, 2, 3, 4)


def evaluation_cells(df: DataFrame, universe: str, fold: str, name: str = "cell") -> DataFrame:
    """The fold-pure unit: scores of different fold models never meet."""
    return df.withColumn(
        name, F.concat(F.col(universe).cast("string"), F.lit("|f"), F.col(fold).cast("string"))
    )


def pair_counts(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    truth: str,
    grades: Sequence[float] = GRADES,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per ``by``: ``pairs`` of rows whose truths differ, and ``doubled``, twice the number of pairs
    that the scores order like the truths (a tie in the score is half a pair).

    No pair is formed. Rows collapse to counts per (``by``, score); for each grade the rows of lower
    grades with a lower score are a running total over those counts. Rows without a score or a truth
    take part in no pair; a truth outside ``grades`` stops the run.

    Where no ``by`` has more rows than a task may hold, rows are shuffled once and one window carries
    the totals of all grades; else each (``by``, grade) is totalled in pieces.
    """
    known = F.when(F.col(truth).isin(*grades), F.col(truth)).otherwise(
        F.raise_error(F.concat(F.lit("grade outside the scale: "), F.col(truth).cast("string")))
    )
    present = df.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    limit = ordering.session.HOT_ROWS if hot_rows is None else hot_rows
    sizes = present.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    fits = bool(by) and (sizes[0] or 0) <= limit
    judged = present.select(*by, F.col(score).alias("_score"), known.alias("_truth"))
    counted = (
        (ordering.session.spread(judged, sizes[1] or 0, *by) if fits else judged)
        .groupBy(*by, "_score")
        .agg(*[F.count(F.when(F.col("_truth") == g, 1)).alias(f"_n{i}") for i, g in enumerate(grades)])
    )
    rising = [f"_n{i}" for i, _ in sorted(enumerate(grades), key=lambda pair: pair[1])]

    def product(one, other):
        return one.cast("decimal(19,0)") * other.cast("decimal(19,0)")

    if fits:
        earlier = Window.partitionBy(*by).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
        doubled = [F.lit(0).cast("decimal(38,0)")]
        lower, below = F.lit(0).cast("long"), F.lit(0).cast("long")
        for n, higher in zip(rising, rising[1:]):
            lower = lower + F.col(n)
            below = below + F.coalesce(F.col(f"_b{n}"), F.lit(0))
            doubled.append(product(F.col(higher), 2 * below + lower))
        placed = counted.withColumns({f"_b{n}": F.sum(n).over(earlier) for n in rising[:-1]})
        totals = placed.groupBy(*by).agg(
            *[F.sum(n).alias(n) for n in rising],
            *[F.sum(d).cast("decimal(38,0)").alias(f"_d{i}") for i, d in enumerate(doubled)],
        )
        pairs, under = F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("long")
        for n, higher in zip(rising, rising[1:]):
            under = under + F.col(n)
            pairs = (pairs + product(F.col(higher), under)).cast("decimal(38,0)")
        hits = F.lit(0).cast("decimal(38,0)")
        for i in range(len(doubled)):
            hits = (hits + F.col(f"_d{i}")).cast("decimal(38,0)")
        return totals.select(*by, pairs.alias("pairs"), hits.alias("doubled"))
    sides = [
        F.struct(
            F.lit(i).alias("_grade"), F.col(rising[i]).alias("_higher"),
            sum((F.col(n) for n in rising[1:i]), F.col(rising[0])).alias("_lower"),
        )
        for i in range(1, len(rising))
    ]
    long = counted.select(*by, "_score", F.explode(F.array(*sides)).alias("_s")).select(
        *by, "_score", "_s.*"
    )
    long, rows = ordering.session.measured(long.filter("_higher + _lower > 0"))
    placed = ordering.running_total(
        long, [*by, "_grade"], [F.col("_score").asc()], "_lower", "_below", "_all",
        hot_rows=hot_rows, at_most=rows,
    )

    return placed.groupBy(*by).agg(
        F.sum(product(F.col("_higher"), F.col("_all"))).cast("decimal(38,0)").alias("pairs"),
        F.sum(product(F.col("_higher"), 2 * F.col("_below") + F.col("_lower"))).cast("decimal(38,0)").alias("doubled"),
    )


def pair_accuracy(
    df: DataFrame,
    cell: Sequence[str],
    group: str,
    score: str,
    truth: str,
    grades: Sequence[float] = GRADES,
    min_pairs: int = MIN_PAIRS,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per cell: ``within`` and ``cross`` accuracy over all pairs, null below ``min_pairs`` pairs.

    Pairs across groups are all pairs of the cell less those within a group.
    """
    every = pair_counts(df, cell, score, truth, grades, hot_rows)
    inside = pair_counts(df, [*cell, group], score, truth, grades, hot_rows)
    tagged = every.withColumn("_inside", F.lit(False)).unionByName(
        inside.select(*cell, "pairs", "doubled", F.lit(True).alias("_inside"))
    )

    def total(name, side):
        return F.sum(F.when(side, F.col(name)).otherwise(0)).cast("decimal(38,0)")

    own = F.col("_inside")
    sums = tagged.groupBy(*cell).agg(
        total("pairs", own).alias("_pairs_in"), total("doubled", own).alias("_hits_in"),
        total("pairs", ~own).alias("_pairs"), total("doubled", ~own).alias("_hits"),
    )

    def share(hits, pairs):
        enough = (pairs > 0) & (pairs >= min_pairs)
        return F.when(enough, hits.cast("double") / (2 * pairs.cast("double")))

    return sums.select(
        *cell,
        share(F.col("_hits_in"), F.col("_pairs_in")).alias("within"),
        share(F.col("_hits") - F.col("_hits_in"), F.col("_pairs") - F.col("_pairs_in")).alias("cross"),
    )


def comparability(
    per_cell: DataFrame, cell: Sequence[str], iterations: int = metrics.ITERATIONS, seed: int = 0
) -> DataFrame:
    """Three rows, ``within``, ``cross``, ``difference``: cells, estimate, low, high."""
    sides = F.array(
        F.struct(F.lit("within").alias("pairs"), F.col("within").alias("estimate")),
        F.struct(F.lit("cross").alias("pairs"), F.col("cross").alias("estimate")),
        F.struct(
            F.lit("difference").alias("pairs"), (F.col("cross") - F.col("within")).alias("estimate")
        ),
    )
    long = per_cell.select(*cell, F.explode(sides).alias("_s")).select(
        *cell, "_s.pairs", "_s.estimate"
    )
    long = long.filter(F.col("estimate").isNotNull())
    counts = long.groupBy("pairs").agg(F.count(F.lit(1)).alias("cells"))
    ci = metrics.bootstrap_ci(long, ["pairs"], ["estimate"], cell, iterations, seed=seed)
    return counts.join(ci, "pairs").select(
        "pairs", "cells", "estimate", F.col("estimate_low").alias("low"),
        F.col("estimate_high").alias("high"),
    )
