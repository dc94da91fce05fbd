"""The comparison table: every ranker on every slice, with floors and paired differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.hashing import digits_number, draw_digits
from rankloom.functions.parsing import label_gain
from rankloom.operators import metrics, ordering

FLOOR_DRAWS = 20
#: Rows of a large group that a shuffle orders, as a multiple of ``k``.
FLOOR_MARGIN = 4.0


def random_floor(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    ids: Sequence[str],
    k: int = metrics.DEFAULT_K,
    draws: int = FLOOR_DRAWS,
    seed: int = 0,
    name: str = "floor",
) -> DataFrame:
    """Per-group NDCG@k of a random order, averaged over ``draws`` reproducible shuffles.

    Each shuffle orders rows by a digest of (seed, draw, id). Digests are uniform, so of a large group only those
    above a line that about ``FLOOR_MARGIN`` times ``k`` rows pass are ordered. A group that has fewer than its
    first ``k`` rows above the line in some draw is done again with all rows.
    """
    facts, groups = ordering.session.measured(metrics.group_facts(df, group, grade, k))
    known = F.lit(False)
    for c in ids:
        known = known | F.col(c).isNotNull()
    needed = list(dict.fromkeys([*group, grade, *ids]))
    rows = df.select(*needed, F.when(known, F.concat_ws(":", *ids)).alias("_id"))
    passing = F.least(F.lit(1.0), F.lit(FLOOR_MARGIN * k) / F.col("size"))
    line = F.lower(F.lpad(F.hex(F.floor((1 - passing) * F.lit(float(2**60))).cast("long")), 15, "0"))
    lines = facts.select(*group, line.alias("_line"))
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")

    def drawn(lined: DataFrame) -> DataFrame:
        """Gain of each (group, draw) from the rows whose digest is not below the line, and their number."""
        shuffled = lined.select(*needed, "_id", "_line", every)
        digest = draw_digits(F.lit(seed), F.col("_draw"), F.col("_id"))
        shuffled = shuffled.withColumn("_digest", digest).filter("_digest >= _line")
        shuffled = shuffled.select(*needed, "_draw", digits_number(F.col("_digest")).alias("_lot"))
        top = metrics.first_rows(shuffled, [*group, "_draw"], "_lot", ids, k)
        return top.groupBy(*group, "_draw").agg(
            F.sum(label_gain(F.col(grade)) * metrics.discount(F.col("rank"))).alias("_dcg"),
            F.count(F.lit(1)).alias("_ranked"),
        )

    found, _ = ordering.session.measured(drawn(ordering.attach(rows, lines, group, at_most=groups)))

    def whole(gains: DataFrame) -> DataFrame:
        return gains.groupBy(*group).agg(
            (F.sum("_dcg") / F.lit(draws)).alias("_dcg"), F.min("_ranked").alias("_least"),
            F.count(F.lit(1)).alias("_draws"),
        )

    gains, _ = ordering.session.measured(ordering.attach(facts, whole(found), group, at_most=groups))
    complete = (F.col("_draws") == draws) & (F.col("_least") >= F.least(F.lit(k), F.col("size")))
    short = ~F.coalesce(complete, F.lit(False))
    again, missed = ordering.session.measured(gains.filter(short).drop("_dcg", "_least", "_draws"))
    if missed:
        left = ordering.attach(rows, again.select(*group), group, "left_semi", at_most=missed)
        redone = whole(drawn(left.withColumn("_line", F.lit("0" * 15))))
        gains = gains.filter(~short).unionByName(ordering.attach(again, redone, group, at_most=missed))
    return gains.select(*group, metrics.ndcg_expression(F.col("_dcg")).alias(name))


def expected_floor(
    df: DataFrame, group: Sequence[str], grade: str, k: int = metrics.DEFAULT_K,
    name: str = "floor",
) -> DataFrame:
    """The exact expectation of the same floor: mean gain times the summed discounts."""
    facts = metrics.group_facts(df, group, grade, k)
    table = metrics._cumulative_discount(k)
    width = F.element_at(table, F.least(F.col("size"), F.lit(k)).cast("int") + 1)
    expected = F.col("gain_total") / F.col("size") * width
    return facts.select(*group, metrics.ndcg_expression(expected).alias(name))


def per_group_table(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    scores: Mapping[str, str],
    ties: Sequence[str],
    k: int = metrics.DEFAULT_K,
    breakdown: str | None = None,
) -> DataFrame:
    """NDCG@k per (ranker, group) with the group's ``size`` and ``label``.

    The ideal gain is worked out once per group, not once per ranker.
    """
    facts = metrics.group_facts(df, group, grade, k)
    keep = list(dict.fromkeys([*group, grade, *ties]))
    long = ordering.stacked_contenders(
        df, keep, group, {n: F.col(c) for n, c in scores.items()}, ties, k
    )
    top = metrics.first_rows(long, ["ranker", *group], "score", ties, k)
    gains = top.groupBy("ranker", *group).agg(
        F.sum(label_gain(F.col(grade)) * metrics.discount(F.col("rank"))).alias("_dcg")
    )
    label = F.min(breakdown).cast("string") if breakdown else F.max(F.lit(None).cast("string"))
    labels = df.groupBy(*group).agg(label.alias("label"))
    return (
        gains.join(facts, list(group))
        .join(labels, list(group))
        .select("ranker", *group, "size", "label",
                metrics.ndcg_expression(F.col("_dcg")).alias("ndcg"))
    )


def metric_slices(per_group: DataFrame, k: int = metrics.DEFAULT_K) -> DataFrame:
    """Repeat each group under ``overall``, its size side (``n>k`` or ``n<=k``) and its label."""
    side = F.when(F.col("size") > k, f"n>{k}").otherwise(f"n<={k}")
    out = per_group.withColumn("slice", F.explode(F.array(F.lit("overall"), side, F.col("label"))))
    return out.filter(F.col("slice").isNotNull())


def comparison_table(
    df: DataFrame,
    group: Sequence[str],
    grade: str,
    scores: Mapping[str, str],
    ties: Sequence[str],
    reference: str | None = None,
    k: int = metrics.DEFAULT_K,
    breakdown: str | None = None,
    floor: DataFrame | None = None,
    iterations: int = metrics.ITERATIONS,
    seed: int = 0,
) -> DataFrame:
    """One row per (slice, ranker): level with interval, slice floor, range share and the paired
    difference against ``reference`` with its interval.

    Without ``floor`` the slice floor is the exact expectation of a random order.

    Degenerate groups are degenerate for every ranker, so all rankers of a slice share the same
    groups and, through :func:`metrics.bootstrap_means`, the same resamples.
    """
    if reference is not None and reference not in scores:
        raise KeyError(f"reference {reference!r} is not one of the rankers: {sorted(scores)}")
    if floor is None:
        floor = expected_floor(df, group, grade, k)
    held, _ = ordering.session.measured(
        per_group_table(df, group, grade, scores, ties, k, breakdown)
    )
    if reference is not None:
        base = held.filter(F.col("ranker") == reference).select(
            *group, F.col("ndcg").alias("_reference")
        )
        held = held.join(base, list(group), "left").withColumn(
            "vs", F.col("ndcg") - F.col("_reference")
        )
    sliced, _ = ordering.session.measured(metric_slices(held, k))
    values = ["ndcg"] + (["vs"] if reference is not None else [])
    level = sliced.groupBy("slice", "ranker").agg(
        F.count("ndcg").alias("groups"),
        F.count(F.when(F.col("ndcg").isNull(), 1)).alias("degenerate"),
        *[F.avg(v).alias(v) for v in values],
    )
    by = ["slice", "ranker"]
    means = metrics.bootstrap_means(sliced, by, values, group, iterations, seed)
    ci = metrics.interval(means, by, values)
    one = sliced.filter(F.col("ranker") == F.lit(list(scores)[0])).select(*group, "slice")
    floors = one.join(floor, list(group)).groupBy("slice").agg(F.avg("floor").alias("floor"))
    share = F.try_divide(F.col("ndcg") - F.col("floor"), 1 - F.col("floor"))
    out = level.join(ci, by, "left").join(floors, "slice", "left")
    columns = ["slice", "ranker", "groups", "degenerate", "ndcg", "ndcg_low", "ndcg_high", "floor",
               share.alias("range_share")]
    if reference is not None:
        columns += [F.col("vs").alias(f"vs_{reference}"), "vs_low", "vs_high"]
    return out.select(*columns)


def paired_difference(
    treatment: DataFrame,
    reference: DataFrame,
    group: Sequence[str],
    value: str = "ndcg",
    iterations: int = metrics.ITERATIONS,
    seed: int = 0,
) -> DataFrame:
    """Mean difference on shared groups with a paired interval: ``difference, _low, _high``."""
    delta = treatment.select(*group, F.col(value).alias("_t")).join(
        reference.select(*group, F.col(value).alias("_r")), list(group)
    )
    delta = delta.withColumn("difference", F.col("_t") - F.col("_r"))
    return metrics.bootstrap_ci(delta, [], ["difference"], group, iterations, seed=seed)


def unpaired_difference(
    treatment: DataFrame,
    reference: DataFrame,
    group: Sequence[str],
    value: str = "ndcg",
    iterations: int = metrics.ITERATIONS,
    seed: int = 0,
) -> DataFrame:
    """Difference of means over *different* groups; each side is resampled on its own."""
    t = treatment.select(*group, F.col(value).alias("t"))
    r = reference.select(*group, F.col(value).alias("r"))
    point = t.agg(F.avg("t").alias("_t")).crossJoin(r.agg(F.avg("r").alias("_r")))  # 1 x 1 row
    means = metrics.bootstrap_means(t, [], ["t"], group, iterations, seed).join(
        metrics.bootstrap_means(r, [], ["r"], group, iterations, seed + 1), "draw"
    )
    means = means.withColumn("difference", F.col("t") - F.col("r"))
    ci = metrics.interval(means, [], ["difference"])
    return point.select((F.col("_t") - F.col("_r")).alias("difference")).crossJoin(ci)


def headline(table: DataFrame, ranker: str, reference: str, slice_name: str = "overall",
             k: int = metrics.DEFAULT_K) -> DataFrame:
    """The result sentence, built from the table's own rows: one row, column ``sentence``."""
    here = table.filter(F.col("slice") == slice_name)
    model = here.filter(F.col("ranker") == ranker)
    base = here.filter(F.col("ranker") == reference).select(
        "slice", F.col("ndcg").alias("_base"), F.col("range_share").alias("_base_share")
    )
    start = F.format_string(
        f"NDCG@{k} %.4f [%.4f, %.4f] against {reference} at %.4f and a random floor of %.4f "
        f"on %d groups ({slice_name})",
        "ndcg", "ndcg_low", "ndcg_high", "_base", "floor", "groups",
    )
    shares = [F.col("range_share") * 100, F.col("_base_share") * 100]
    if f"vs_{reference}" in table.columns:
        end = F.format_string(
            "; the difference is %+.4f [%+.4f, %+.4f] paired, and it traverses %.1f%% of the "
            f"floor-to-1 range against %.1f%% for {reference}.",
            f"vs_{reference}", "vs_low", "vs_high", *shares,
        )
    else:
        end = F.format_string(
            f"; it traverses %.1f%% of the floor-to-1 range against %.1f%% for {reference} (no "
            "paired interval: this table was built against a different reference).",
            *shares,
        )
    return model.join(base, "slice").select(F.concat(start, end).alias("sentence"))


def summarise_seeds(table: DataFrame, prefix: str = "model_seed") -> DataFrame:
    """Mean, spread and range over the per-seed rows of a comparison table."""
    seeds = table.filter(F.col("ranker").startswith(prefix))
    spread = F.stddev_samp("ndcg")
    difference = [c for c in table.columns if c.startswith("vs_") and c not in ("vs_low", "vs_high")]
    return seeds.groupBy("slice").agg(
        F.count("ndcg").alias("seeds"),
        F.min("groups").alias("groups"),
        F.avg("ndcg").alias("ndcg_mean"),
        spread.alias("ndcg_sd"),
        F.min("ndcg").alias("ndcg_min"),
        F.max("ndcg").alias("ndcg_max"),
        F.min("floor").alias("floor"),
        (F.coalesce(spread, F.lit(0.0)) == 0.0).alias("deterministic"),
        *[F.avg(c).alias(c) for c in difference],
    )
