"""NDCG, recall and bootstrap intervals over groups.

Only two small things leave the map tasks: the first ``k`` rows of each group by score, and a
histogram of grades per group. The ideal ordering is never sorted -- equal grades occupy
consecutive positions, so the ideal gain is a sum over grade levels of
``gain * (D(end) - D(start))`` with ``D`` the cumulative discount.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.bins import METRIC_SIZE_EDGES, cut, cut_ordinal, span_labels
from rankloom.functions.hashing import draw_index
from rankloom.functions.parsing import label_gain
from rankloom.operators import ordering

DEFAULT_K = 10
RELEVANT_GRADE = 3
ITERATIONS = 2_000
CONFIDENCE = 0.95
#: Labels (``by``) up to which those of one size share their draws; a drawn row meets at most so many values.
SHARED_DRAWS = 64


def discount(position: Column) -> Column:
    """``1 / log2(position + 1)`` for 1-based positions."""
    return F.lit(1.0) / F.log2(position + 1)


def _cumulative_discount(k: int) -> Column:
    total, values = 0.0, [0.0]
    for position in range(1, k + 1):
        total += 1.0 / math.log2(position + 1)
        values.append(total)
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


def first_rows(
    df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], k: int = DEFAULT_K
) -> DataFrame:
    """The ``k`` best-scored rows of each group with their 1-based ``rank``; ties by ``ties``."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c).asc() for c in ties]]
    return ordering.top_k(df, group, order, k)


def grade_levels(df: DataFrame, group: Sequence[str], grade: str) -> DataFrame:
    """Rows per (group, grade) with the number of better-graded rows before them."""
    counts = df.groupBy(*group, grade).agg(F.count(F.lit(1)).alias("_n"))
    # One row per grade level, a handful per group.
    better = Window.partitionBy(*group).orderBy(F.col(grade).desc())
    earlier = better.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def group_facts(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    k: int = DEFAULT_K,
    exponential: bool = True,
    relevant_grade: float = RELEVANT_GRADE,
) -> DataFrame:
    """Per group: ``size``, ``degenerate`` (one grade only), ``ideal`` DCG@k, ``relevant``, ``levels``."""
    levels = grade_levels(df, group, grade)
    table = _cumulative_discount(k)

    def reach(position: Column) -> Column:
        return F.element_at(table, F.least(position, F.lit(k)).cast("int") + 1)

    width = reach(F.col("_before") + F.col("_n")) - reach(F.col("_before"))
    return levels.groupBy(*group).agg(
        F.sum("_n").alias("size"),
        (F.count(F.lit(1)) == 1).alias("degenerate"),
        F.sum(label_gain(F.col(grade), exponential) * width).alias("ideal"),
        F.sum(F.when(F.col(grade) >= relevant_grade, F.col("_n")).otherwise(0)).alias("relevant"),
        F.sum(label_gain(F.col(grade), exponential) * F.col("_n")).alias("gain_total"),
    )


def ndcg_expression(dcg: Column, include_degenerate: bool = False) -> Column:
    """DCG over ideal DCG; null where there is nothing to order."""
    ratio = F.coalesce(dcg, F.lit(0.0)) / F.nullif(F.col("ideal"), F.lit(0.0))
    return ratio if include_degenerate else F.when(~F.col("degenerate"), ratio)


def ndcg_at_k(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    score: str,
    ties: Sequence[str],
    k: int = DEFAULT_K,
    exponential: bool = True,
    include_degenerate: bool = False,
    name: str = "ndcg",
) -> DataFrame:
    """One row per group with NDCG@k (null for a group whose grades are all equal)."""
    facts = group_facts(df, group, grade, k, exponential)
    top = first_rows(df.select(*group, grade, score, *_extra(ties, group, grade, score)), group,
                     score, ties, k)
    gains = top.groupBy(*group).agg(
        F.sum(label_gain(F.col(grade), exponential) * discount(F.col("rank"))).alias("_dcg")
    )
    return facts.join(gains, list(group), "left").select(
        *group, "size", ndcg_expression(F.col("_dcg"), include_degenerate).alias(name)
    )


def _extra(columns, *known) -> list[str]:
    flat = {c for item in known for c in ([item] if isinstance(item, str) else item)}
    return [c for c in dict.fromkeys(columns) if c not in flat]


def recall_at_k(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    score: str,
    ties: Sequence[str],
    k: int = DEFAULT_K,
    relevant_grade: float = RELEVANT_GRADE,
    name: str = "recall",
) -> DataFrame:
    """Share of a group's relevant rows inside its first ``k``; null when none is relevant."""
    relevant = F.count(F.when(F.col(grade) >= relevant_grade, 1))
    totals = df.groupBy(*group).agg(relevant.alias("_relevant"))
    top = first_rows(df.select(*group, grade, score, *_extra(ties, group, grade, score)), group,
                     score, ties, k)
    found = top.groupBy(*group).agg(relevant.alias("_found"))
    share = F.coalesce("_found", F.lit(0)) / F.nullif(F.col("_relevant"), F.lit(0).cast("long"))
    return totals.join(found, list(group), "left").select(*group, share.alias(name))


def ranking_metrics(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    score: str,
    ties: Sequence[str],
    k: int = DEFAULT_K,
    relevant_grade: float = RELEVANT_GRADE,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """NDCG@k and recall@k per group from one pass of each small table.

    ``carry`` adds per-group constants (aggregates), e.g. a breakdown label.
    """
    facts = group_facts(df, group, grade, k, relevant_grade=relevant_grade)
    top = first_rows(df.select(*group, grade, score, *_extra(ties, group, grade, score)), group,
                     score, ties, k)
    found = top.groupBy(*group).agg(
        F.sum(label_gain(F.col(grade)) * discount(F.col("rank"))).alias("_dcg"),
        F.count(F.when(F.col(grade) >= relevant_grade, 1)).alias("_found"),
    )
    recall = F.coalesce("_found", F.lit(0)) / F.nullif(F.col("relevant"), F.lit(0).cast("long"))
    out = facts.join(found, list(group), "left")
    names = []
    if carry:
        labels = df.groupBy(*group).agg(*[c.alias(n) for n, c in carry.items()])
        out, names = out.join(labels, list(group), "left"), list(carry)
    return out.select(
        *group, "size", *names, ndcg_expression(F.col("_dcg")).alias("ndcg"), recall.alias("recall")
    )


def bootstrap_means(
    per_group: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    order: Sequence[str],
    iterations: int = ITERATIONS,
    seed: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Resampled means: one row per (``by``, ``draw``) with a mean per value column.

    Groups (rows where every value is present) are numbered in ``order`` within ``by``. Every
    numbered row proposes one draw per iteration, so the work is spread like the rows are, and the
    means combine inside each map task: ``iterations`` rows per task reach the shuffle.
    All value columns share one resample, which is what makes their difference paired.
    """
    kept = per_group
    for value in values:
        kept = kept.filter(F.col(value).isNotNull())
    kept = kept.select(*by, *order, *values)
    numbered = ordering.running_total(
        kept, by, [F.col(c).asc() for c in order], before="_slot", total="_size", hot_rows=hot_rows
    ).select(*by, "_slot", "_size", *values)
    numbered, rows = ordering.session.measured(numbered)
    # Draws depend on the size alone: where few ``by`` are there, those of equal size share them.
    shared = not by or numbered.select(*by).distinct().count() <= SHARED_DRAWS
    keys = ["_size", "_slot"] if shared else [*by, "_size", "_slot"]
    proposers, proposing = numbered.select(*keys), rows
    if shared and by:
        proposers, proposing = ordering.session.measured(proposers.distinct())
    draws = ordering.session.spread(proposers, proposing * iterations, *keys).select(
        *keys[:-1],
        F.col("_slot").alias("_proposer"),
        F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("draw"),
    ).withColumn(
        "_slot", draw_index(F.col("_size"), F.lit(seed), F.col("draw"), F.col("_proposer"))
    )
    drawn = ordering.attach(draws.select(*keys, "draw"), numbered, keys, salts=1, at_most=rows)
    return drawn.groupBy(*by, "draw").agg(*[F.avg(v).alias(v) for v in values])


def interval(
    means: DataFrame, by: Sequence[str], values: Sequence[str], confidence: float = CONFIDENCE
) -> DataFrame:
    """``<value>_low`` and ``<value>_high`` per ``by`` from resampled means (a bounded number of rows)."""
    tail = (1 - confidence) / 2
    columns = []
    for value in values:
        columns.append(F.percentile(value, F.lit(tail)).alias(f"{value}_low"))
        columns.append(F.percentile(value, F.lit(1 - tail)).alias(f"{value}_high"))
    return means.groupBy(*by).agg(*columns) if by else means.agg(*columns)


def bootstrap_ci(
    per_group: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    order: Sequence[str],
    iterations: int = ITERATIONS,
    confidence: float = CONFIDENCE,
    seed: int = 0,
) -> DataFrame:
    """Mean and percentile interval of per-group values, resampling groups.

    One row per ``by``: ``<value>``, ``<value>_low``, ``<value>_high``; null if nothing survives.
    """
    levels = per_group.groupBy(*by) if by else per_group
    point = levels.agg(*[F.avg(v).alias(v) for v in values])
    parts = [
        interval(bootstrap_means(per_group, by, [v], order, iterations, seed), by, [v], confidence)
        for v in values
    ]
    out = point
    for part in parts:
        out = ordering.attach(out, part, by)
    return out


def slice_rows(per_group: DataFrame, breakdown: str | None = None) -> DataFrame:
    """Repeat each group under ``overall`` and under its own breakdown label."""
    names = [F.lit("overall")] + ([F.col(breakdown).cast("string")] if breakdown else [])
    out = per_group.withColumn("slice", F.explode(F.array(*names)))
    return out.filter(F.col("slice").isNotNull())


def evaluate_ranking(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    score: str,
    ties: Sequence[str],
    k: int = DEFAULT_K,
    breakdown: str | None = None,
    iterations: int = ITERATIONS,
    seed: int = 0,
) -> DataFrame:
    """NDCG@k and recall@k with intervals, overall and per breakdown label."""
    carry = {"_label": F.min(breakdown)} if breakdown else None
    per_group = ranking_metrics(df, group, grade, score, ties, k, carry=carry)
    per_group, _ = ordering.session.measured(per_group)
    sliced = slice_rows(per_group, "_label" if breakdown else None)
    counts = sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(F.col("ndcg").isNull(), 1)).alias("degenerate"),
    )
    ci = bootstrap_ci(sliced, ["slice"], ["ndcg", "recall"], group, iterations, seed=seed)
    return counts.join(ci, "slice").select(
        "slice", "groups", "degenerate", "ndcg", "ndcg_low", "ndcg_high", "recall", "recall_low",
        "recall_high",
    )


def size_band(
    df: DataFrame,
    group: Sequence[str],
    edges: Sequence[float] = METRIC_SIZE_EDGES,
    labels: Sequence[str] | None = None,
    name: str = "size_band",
) -> DataFrame:
    """Label each row with its group's size band (plus ``<name>_order`` for sorting)."""
    labels = labels or span_labels(edges)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    banded = sizes.select(
        *group,
        cut(F.col("_size"), edges, labels).alias(name),
        cut_ordinal(F.col("_size"), edges).alias(f"{name}_order"),
    )
    return ordering.attach(df, banded, group)
