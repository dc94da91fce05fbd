"""Where cohorts are placed against where their grades belong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.bins import cut, cut_ordinal
from rankloom.functions.parsing import label_gain
from rankloom.operators import metrics, ordering

MIN_COHORT_MEMBERS = 3
COMMERCIAL_THRESHOLD = 5


def within_group_position(
    df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str],
    name: str = "position", ascending: bool = False, hot_rows: int | None = None,
) -> DataFrame:
    """0.0 first, 1.0 last, null for a lone row."""
    column = F.col(value)
    order = [column.asc_nulls_last() if ascending else column.desc_nulls_last()]
    order += [F.col(c).asc() for c in ties]
    placed = ordering.running_total(
        df, group, order, before="_before", total="_size", hot_rows=hot_rows
    )
    position = F.col("_before") / F.nullif(F.col("_size") - 1, F.lit(0).cast("long"))
    return placed.withColumn(name, position).drop("_before", "_size")


def displacement(
    df: DataFrame, group: Sequence[str], score: str, truth: str, ties: Sequence[str],
    name: str = "displacement", hot_rows: int | None = None,
) -> DataFrame:
    """Ideal minus actual position: positive is over-ranked, in fractions of the group's length."""
    out = within_group_position(df, group, truth, ties, "_ideal", hot_rows=hot_rows)
    out = within_group_position(out, group, score, ties, "_actual", hot_rows=hot_rows)
    return out.withColumn(name, F.col("_ideal") - F.col("_actual")).drop("_ideal", "_actual")


def cohort_gap(
    df: DataFrame, group: Sequence[str], cohort: str, value: str = "displacement",
    min_members: int = MIN_COHORT_MEMBERS, name: str = "cohort_gap",
) -> DataFrame:
    """Per group: mean displacement of the cohort minus that of the rest, both large enough."""
    held = df.filter(F.col(value).isNotNull())
    inside = F.coalesce(F.col(cohort), F.lit(False))
    stats = held.groupBy(*group).agg(
        F.avg(F.when(inside, F.col(value))).alias("_in"),
        F.avg(F.when(~inside, F.col(value))).alias("_out"),
        F.count(F.when(inside, 1)).alias("_n_in"),
        F.count(F.when(~inside, 1)).alias("_n_out"),
    )
    enough = (F.col("_n_in") >= min_members) & (F.col("_n_out") >= min_members)
    return stats.filter(enough).select(*group, (F.col("_in") - F.col("_out")).alias(name))


def side_rates(
    df: DataFrame, group: Sequence[str], score: str, truth: str, cohort: str,
    ties: Sequence[str], k: int = metrics.DEFAULT_K, min_members: int = MIN_COHORT_MEMBERS,
) -> DataFrame:
    """Per (side, group): share in the first ``k`` by score (``reach``) and by truth (``earned``)."""
    side = F.when(F.coalesce(F.col(cohort), F.lit(False)), "cohort").otherwise("rest")
    sided = df.withColumn("side", side)
    members = sided.groupBy(*group, "side").agg(F.count(F.lit(1)).alias("members"))
    out = members.filter(F.col("members") >= min_members)
    for name, column in (("reach", score), ("earned", truth)):
        keep = list(dict.fromkeys([*group, "side", column, *ties]))
        top = metrics.first_rows(sided.select(*keep), group, column, ties, k)
        hits = top.groupBy(*group, "side").agg(F.count(F.lit(1)).alias(f"_{name}"))
        out = out.join(hits, [*group, "side"], "left")
    return out.select(
        "side",
        *group,
        "members",
        *[
            (F.coalesce(F.col(f"_{n}"), F.lit(0)) / F.col("members")).alias(n)
            for n in ("reach", "earned")
        ],
    )


def exposure_amplification(
    df: DataFrame, group: Sequence[str], score: str, truth: str, cohort: str,
    ties: Sequence[str], k: int = metrics.DEFAULT_K, min_members: int = MIN_COHORT_MEMBERS,
    iterations: int = metrics.ITERATIONS, seed: int = 0,
) -> DataFrame:
    """Per side: groups, mean reach, mean earned, and their difference with its interval."""
    rates = side_rates(df, group, score, truth, cohort, ties, k, min_members)
    rates = rates.withColumn("amplification", F.col("reach") - F.col("earned"))
    rates, _ = ordering.session.measured(rates)
    level = rates.groupBy("side").agg(
        F.count(F.lit(1)).alias("groups"), F.avg("reach").alias("reach"),
        F.avg("earned").alias("earned"),
    )
    ci = metrics.bootstrap_ci(rates, ["side"], ["amplification"], group, iterations, seed=seed)
    return level.join(ci, "side")


def dose_response(
    df: DataFrame, group: Sequence[str], dose: str, bands: Sequence[float],
    labels: Sequence[str], value: str = "displacement",
    min_members: int = MIN_COHORT_MEMBERS, iterations: int = metrics.ITERATIONS, seed: int = 0,
) -> DataFrame:
    """Mean displacement per band of a continuous variable, in band order (``band_order``)."""
    banded = df.filter(F.col(value).isNotNull()).withColumns(
        {"band": cut(F.col(dose), bands, labels), "band_order": cut_ordinal(F.col(dose), bands)}
    ).filter(F.col("band").isNotNull())
    per_group = banded.groupBy("band", "band_order", *group).agg(
        F.avg(value).alias("displacement"), F.count(F.lit(1)).alias("_n")
    )
    per_group, _ = ordering.session.measured(per_group)
    listings = per_group.groupBy("band", "band_order").agg(F.sum("_n").alias("listings"))
    large = per_group.filter(F.col("_n") >= min_members)
    groups = large.groupBy("band").agg(F.count(F.lit(1)).alias("groups"))
    ci = metrics.bootstrap_ci(large, ["band"], ["displacement"], group, iterations, seed=seed)
    return listings.join(groups, "band", "left").join(ci, "band", "left").select(
        "band", "band_order", "listings", F.coalesce("groups", F.lit(0)).alias("groups"),
        "displacement", F.col("displacement_low").alias("low"),
        F.col("displacement_high").alias("high"),
    )


def threshold_ladder(
    df: DataFrame, group: Sequence[str], dose: str, cuts: Sequence[float],
    value: str = "displacement", min_members: int = MIN_COHORT_MEMBERS,
    iterations: int = metrics.ITERATIONS, seed: int = 0,
) -> DataFrame:
    """The cohort gap at every cut, with the share of rows each captures.

    Rows are aggregated once to (group, number of cuts passed); every threshold's two sides are
    sums over those few levels.
    """
    cuts = sorted(cuts)
    passed = sum(((F.col(dose) >= c).cast("int") for c in cuts), F.lit(0))
    levels = df.filter(F.col(value).isNotNull()).withColumn("_level", F.coalesce(passed, F.lit(0)))
    levels = levels.groupBy(*group, "_level").agg(
        F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    levels, _ = ordering.session.measured(levels)
    steps = F.explode(
        F.array(*[
            F.struct(F.lit(i + 1).alias("i"), F.lit(float(c)).alias("cut"))
            for i, c in enumerate(cuts)
        ])
    )
    sides = levels.withColumn("_s", steps)
    inside = F.col("_level") >= F.col("_s.i")
    per_group = sides.groupBy(F.col("_s.cut").alias("cut"), *group).agg(
        F.sum(F.when(inside, F.col("_sum"))).alias("_in"),
        F.sum(F.when(~inside, F.col("_sum"))).alias("_out"),
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("_n_in"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("_n_out"),
    )
    shares = per_group.groupBy("cut").agg(
        (F.sum("_n_in") / (F.sum("_n_in") + F.sum("_n_out"))).alias("share")
    )
    enough = (F.col("_n_in") >= min_members) & (F.col("_n_out") >= min_members)
    gaps = per_group.filter(enough).select(
        "cut", *group, (F.col("_in") / F.col("_n_in") - F.col("_out") / F.col("_n_out")).alias("gap")
    )
    gaps, _ = ordering.session.measured(gaps)
    counts = gaps.groupBy("cut").agg(F.count(F.lit(1)).alias("groups"))
    ci = metrics.bootstrap_ci(gaps, ["cut"], ["gap"], group, iterations, seed=seed)
    return shares.join(counts, "cut", "left").join(ci, "cut", "left").select(
        "cut", "share", F.coalesce("groups", F.lit(0)).alias("groups"), "gap",
        F.col("gap_low").alias("low"), F.col("gap_high").alias("high"),
    )


def standardised(
    df: DataFrame, group: Sequence[str], score: str, name: str = "z"
) -> DataFrame:
    """Score in within-group standard deviations; 0 where the group has no spread."""
    out = ordering.with_group_stats(
        df, group, [F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_sd")]
    )
    z = (F.col(score) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return out.withColumn(name, F.coalesce(z, F.lit(0.0))).drop("_mean", "_sd")


def offset_correction(
    df: DataFrame, group: Sequence[str], grade: str, score: str, cohort: str, fold: str,
    ties: Sequence[str], grid: Sequence[float], k: int = metrics.DEFAULT_K, places: int = 9,
) -> DataFrame:
    """A cohort score offset fitted on the other folds and tested on the held one, per fold.

    NDCG is worked out once per (offset, group); each fold's choice is then arithmetic on
    (offset, fold) sums. The first offset wins a tie.
    """
    keep = list(dict.fromkeys([*group, grade, cohort, fold, "z", *ties]))
    z = ordering.session.stage(standardised(df, group, score).select(*keep))
    member = F.coalesce(F.col(cohort), F.lit(False)).cast("double")
    # Rounded, so that rows equal up to float noise tie the same way everywhere.
    shifted = {i: F.round(F.col("z") + F.lit(float(d)) * member, places) for i, d in enumerate(grid)}
    # Folds hold whole groups, so the fold can ride along in the group key.
    cells = list(dict.fromkeys([fold, *group]))
    kept = list(dict.fromkeys([*cells, grade, *ties]))
    long = ordering.stacked_contenders(z, kept, cells, shifted, ties, k, "step", "_shifted")
    gains = metrics.first_rows(long, ["step", *cells], "_shifted", ties, k).groupBy("step", *cells).agg(
        F.sum(label_gain(F.col(grade)) * metrics.discount(F.col("rank"))).alias("_dcg")
    )
    # Grades do not move with the offset: one ideal order for all steps.
    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(float(d)).alias("offset"))
        for i, d in enumerate(grid)
    ])
    facts = metrics.group_facts(z, cells, grade, k).select(
        *cells, "ideal", "degenerate", F.explode(steps).alias("_d")
    ).select(*cells, "ideal", "degenerate", "_d.*")
    scored = facts.join(gains, ["step", *cells], "left").select(
        "step", "offset", *cells, metrics.ndcg_expression(F.col("_dcg")).alias("ndcg")
    )
    sums = scored.groupBy("step", "offset", fold).agg(
        F.sum("ndcg").alias("_sum"), F.count("ndcg").alias("_n")
    )
    sums, _ = ordering.session.measured(sums)
    whole = sums.groupBy("step", "offset").agg(
        F.sum("_sum").alias("_all"), F.sum("_n").alias("_all_n")
    )
    others = sums.join(whole, ["step", "offset"]).withColumn(
        "_fit",
        F.round((F.col("_all") - F.col("_sum"))
                / F.nullif(F.col("_all_n") - F.col("_n"), F.lit(0).cast("long")), places),
    )
    best = others.groupBy(fold).agg(
        F.min_by("offset", F.struct(-F.col("_fit"), F.col("step"))).alias("chosen_offset")
    )
    here = sums.select(
        fold, F.col("offset").alias("_o"),
        (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0).cast("long"))).alias("_v"),
    )
    base = here.filter(F.col("_o") == 0.0).select(fold, F.col("_v").alias("as_is"))
    corrected = best.join(
        here.withColumnRenamed(fold, "_f"),
        (F.col(fold) == F.col("_f")) & (F.col("chosen_offset") == F.col("_o")),
    ).select(fold, "chosen_offset", F.col("_v").alias("corrected"))
    return corrected.join(base, fold).select(
        fold, "chosen_offset", "as_is", "corrected",
        (F.col("corrected") - F.col("as_is")).alias("difference"),
    )
