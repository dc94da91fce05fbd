"""What reaches the first screen as the candidate set widens, and under which retrieval policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import metrics, ordering

MAX_CANDIDATES = 5_000
RELEVANT_GRADE = metrics.RELEVANT_GRADE


def rung_labels(df: DataFrame, key: Sequence[str], name: str = "rung_group") -> DataFrame:
    """Plain re-keying at one rung: a dense id per key combination, nulls kept as their own."""
    return ordering.attach(df, ordering.dense_ids(df, list(key), name), list(key))


def candidate_set_profile(
    df: DataFrame, cascade: Sequence[tuple[str, Sequence[str]]], cap: int = MAX_CANDIDATES
) -> DataFrame:
    """Per rung: groups, median, p90 and max size, groups over the cap, serviceable.

    Rows are counted once at the finest key; coarser rungs re-aggregate those counts.
    """
    finest = list(dict.fromkeys(c for _, keys in cascade for c in keys))
    counts, _ = ordering.session.measured(df.groupBy(*finest).agg(F.count(F.lit(1)).alias("_n")))
    sizes = None
    for name, keys in cascade:
        rung = counts.groupBy(*keys).agg(F.sum("_n").alias("_size")).select(
            F.lit(name).alias("rung"), F.lit(" x ".join(keys)).alias("key"), "_size"
        )
        sizes = rung if sizes is None else sizes.unionByName(rung)
    summary = sizes.groupBy("rung", "key").agg(
        F.count(F.lit(1)).alias("groups"),
        F.max("_size").alias("max"),
        F.count(F.when(F.col("_size") > cap, 1)).alias("over_cap"),
    )
    middles = ordering.group_quantiles(sizes, ["rung"], "_size", {"median": 0.5, "p90": 0.9})
    return summary.join(middles, "rung").select(
        "rung", "key", "groups",
        F.floor("median").alias("median"), F.floor("p90").alias("p90"),
        "max", "over_cap", (F.col("over_cap") == 0).alias("serviceable"),
    )


def geographic_concentration(
    df: DataFrame, group: Sequence[str], geo: str, score: str, ties: Sequence[str],
    k: int = metrics.DEFAULT_K,
) -> DataFrame:
    """Per group: places available, places in the first ``k``, coverage and normalised entropy."""
    per_geo = df.groupBy(*group, geo).agg(F.count(F.lit(1)).alias("_n"))
    top = metrics.first_rows(
        df.select(*dict.fromkeys([*group, geo, score, *ties])), group, score, ties, k
    )
    return _concentration(per_geo, top, group, geo, k)


def _concentration(
    per_geo: DataFrame, top: DataFrame, group: Sequence[str], geo: str, k: int
) -> DataFrame:
    """The same from the rows ``_n`` per (group, place) and the first rows."""
    available = per_geo.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("geos_available")
    )
    shown = top.groupBy(*group, geo).agg(F.count(F.lit(1)).alias("_c"))
    # p ln p over a screen of t rows: sum(c/t * ln(c/t)) = sum(c ln c)/t - ln t
    found = shown.groupBy(*group).agg(
        F.count(F.lit(1)).alias("geos_in_top_k"),
        F.sum("_c").alias("_t"),
        F.sum(F.col("_c") * F.log(F.col("_c"))).alias("_clogc"),
    )
    reachable = F.least(F.lit(k), F.col("geos_available"))
    entropy = F.log(F.col("_t")) - F.col("_clogc") / F.col("_t")
    return available.join(found, list(group)).select(
        *group, "n", "geos_available", "geos_in_top_k",
        (F.col("geos_in_top_k") / reachable).alias("coverage"),
        F.when(reachable > 1, entropy / F.log(reachable)).alias("entropy"),
    )


def cohort_reach(
    df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], cohort: str,
    k: int = metrics.DEFAULT_K, by: Sequence[str] = (),
) -> DataFrame:
    """Share of a cohort inside the first ``k`` against the exact shuffle expectation min(k, n)/n."""
    sizes = df.groupBy(*by, *group).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(cohort), 1)).alias("_members")
    )
    top = metrics.first_rows(
        df.select(*dict.fromkeys([*by, *group, score, cohort, *ties])), [*by, *group], score,
        ties, k,
    )
    return _reach(sizes, top, group, cohort, k, by)


def _reach(
    sizes: DataFrame, top: DataFrame, group: Sequence[str], cohort: str, k: int, by: Sequence[str]
) -> DataFrame:
    """The same from rows ``_n`` and ``_members`` per group and the first rows."""
    hits = top.groupBy(*by, *group).agg(F.count(F.when(F.col(cohort), 1)).alias("_reached"))
    joined = sizes.join(hits, [*by, *group])
    members, reached = F.sum("_members"), F.sum("_reached")
    chance = F.sum(F.col("_members") * F.least(F.lit(k), F.col("_n")) / F.col("_n"))
    nothing = F.lit(0).cast("long")
    rate, random = reached / F.nullif(members, nothing), chance / F.nullif(members, nothing)
    return joined.groupBy(*by).agg(
        members.alias("cohort"), reached.alias("reached"), rate.alias("reach_rate"),
        random.alias("random_rate"), (rate - random).alias("lift"),
    )


def cold_start_reach(
    df: DataFrame, group: Sequence[str], grade: str, reviews: str, rankers: Mapping[str, str],
    ties: Sequence[str], k: int = metrics.DEFAULT_K, relevant_grade: int = RELEVANT_GRADE,
) -> DataFrame:
    """Deserving never-reviewed rows that each ranker puts in a first screen, ideal included."""
    worthy = (F.col(reviews) == 0) & (F.col(grade) >= relevant_grade)
    flagged = df.withColumn("_worthy", worthy)
    scores = {"ideal": grade, **rankers}
    sizes = flagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_worthy"), 1)).alias("_members")
    )
    sizes = sizes.withColumn("ranker", F.explode(F.array(*[F.lit(n) for n in scores])))
    long = ordering.stacked_contenders(
        flagged, list(dict.fromkeys([*group, "_worthy", *ties])), group,
        {n: F.col(c) for n, c in scores.items()}, ties, k, value="_score",
    )
    top = metrics.first_rows(long, ["ranker", *group], "_score", ties, k)
    reach, _ = ordering.session.measured(_reach(sizes, top, group, "_worthy", k, ["ranker"]))
    shuffled = reach.filter(F.col("ranker") == "ideal").select(
        F.lit("random").alias("ranker"), "cohort", F.col("random_rate").alias("reach_rate")
    )
    return reach.select("ranker", "cohort", "reach_rate").unionByName(shuffled)


def demand_prior(
    df: DataFrame, city: str, geo: str, target: str = "grade", name: str = "prior"
) -> DataFrame:
    """Mean target per (city, place) plus one fallback row per city with a null place."""
    known = df.filter(F.col(city).isNotNull() & F.col(geo).isNotNull())
    sums = known.groupBy(city, geo).agg(F.avg(target).alias(name))
    whole = df.filter(F.col(city).isNotNull()).groupBy(city).agg(F.avg(target).alias(name))
    fallback = whole.select(city, F.lit(None).cast(df.schema[geo].dataType).alias(geo), name)
    return sums.unionByName(fallback)


def ranked_geographies(
    candidates: DataFrame, prior: DataFrame, search: Sequence[str], city: str, geo: str,
    name: str = "prior", limit: int | None = None,
) -> DataFrame:
    """Places of each search by prior: ``(*search, geo, geo_rank)``. Unseen places take the city
    mean; equal priors order by place."""
    places = candidates.groupBy(*search, geo).agg(F.min(city).alias("_city"))
    known = prior.filter(F.col(geo).isNotNull()).select(
        F.col(city).alias("_city"), geo, F.col(name).alias("_own")
    )
    whole = prior.filter(F.col(geo).isNull()).select(
        F.col(city).alias("_city"), F.col(name).alias("_mean")
    )
    scored = ordering.attach(ordering.attach(places, known, ["_city", geo]), whole, ["_city"])
    value = F.coalesce("_own", "_mean")
    order = [value.desc_nulls_last(), F.col(geo).asc_nulls_first()]
    if limit is not None:
        return ordering.top_k(scored, search, order, limit, "geo_rank").select(
            *search, geo, "geo_rank"
        )
    return ordering.group_rank(scored, search, order, "geo_rank").select(*search, geo, "geo_rank")


def select_geographies(
    candidates: DataFrame, prior: DataFrame, search: Sequence[str], city: str, geo: str, k_geo: int
) -> DataFrame:
    """Candidates in the ``k_geo`` highest-prior places of their search."""
    chosen = ranked_geographies(candidates, prior, search, city, geo, limit=k_geo)
    return ordering.attach(candidates, chosen.drop("geo_rank"), [*search, geo], "left_semi")


def screen_composition(
    df: DataFrame, group: Sequence[str], geo: str, grade: str, cold: str, score: str,
    ties: Sequence[str], k: int = metrics.DEFAULT_K,
) -> DataFrame:
    """What the first screen of each group holds."""
    top = metrics.first_rows(
        df.select(*dict.fromkeys([*group, geo, grade, cold, score, *ties])), group, score, ties, k
    )
    relevant = F.col(grade) >= RELEVANT_GRADE
    per_geo = top.groupBy(*group, geo).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(grade).alias("_grade"),
        F.count(F.when(relevant, 1)).alias("_rel"),
        F.count(F.when(F.col(cold), 1)).alias("_cold"),
        F.count(F.when(F.col(cold) & relevant, 1)).alias("_deserving"),
    )
    shown = F.sum("_n")
    return per_geo.groupBy(*group).agg(
        shown.alias("shown"),
        (F.sum("_grade") / shown).alias("mean_grade"),
        (F.sum("_rel") / shown).alias("relevant_share"),
        F.count(F.lit(1)).alias("distinct_geos"),
        (F.sum("_cold") / shown).alias("cold_share"),
        (F.sum("_deserving") / shown).alias("deserving_cold_share"),
    )


def simulate_arms(
    candidates: DataFrame, prior: DataFrame, search: Sequence[str], city: str, geo: str,
    grade: str, cold: str, score: str, ties: Sequence[str],
    k_geos: Sequence[int] = (1, 2, 3, 5), k: int = metrics.DEFAULT_K,
) -> DataFrame:
    """Control against narrowed retrieval for each ``k_geo``: means over searches per arm.

    A screen of places is drawn from the first screens of the places: each (search, place) keeps its
    ``k`` best once, inside the map tasks, and only those few meet the arms whose ``k_geo`` reaches their
    place. Candidates are read once for them and once for the counts per place, and are never copied.
    """
    keep = list(dict.fromkeys([*search, geo, grade, cold, score, *ties]))
    places = ranked_geographies(candidates, prior, search, city, geo, limit=max(k_geos))
    places, ranked = ordering.session.measured(places)
    within = F.filter(F.array(*[F.lit(x) for x in k_geos]), lambda x: F.col("geo_rank") <= x)
    # Arm 0 is the control; a place that no arm reaches stands in it alone.
    arms = F.explode(F.concat(F.array(F.lit(0)), F.coalesce(within, F.array().cast("array<int>")))).alias("_arm")
    best = metrics.first_rows(candidates.select(*keep), [*search, geo], score, ties, k).select(*keep)
    best = ordering.attach(best, places, [*search, geo], at_most=ranked)
    screens = screen_composition(best.select(*keep, arms), ["_arm", *search], geo, grade, cold, score, ties, k)
    counted = candidates.groupBy(*search, geo).agg(F.count(F.lit(1)).alias("_here"))
    counted = ordering.attach(counted, places, [*search, geo], at_most=ranked)
    sizes = counted.select(*search, "_here", arms).groupBy("_arm", *search).agg(F.sum("_here").alias("_size"))
    medians = ordering.group_median(sizes, ["_arm"], "_size", "_median")
    names = ["mean_grade", "relevant_share", "distinct_geos", "cold_share", "deserving_cold_share"]
    means = screens.groupBy("_arm").agg(
        F.count(F.lit(1)).alias("searches"), *[F.avg(n).alias(n) for n in names]
    )
    table = means.join(medians, "_arm")
    control = table.filter("_arm = 0").withColumn(
        "k_geo", F.explode(F.array(*[F.lit(x) for x in k_geos]))
    ).withColumn("arm", F.lit("control"))
    treated = table.filter("_arm > 0").withColumn("k_geo", F.col("_arm")).withColumn(
        "arm", F.lit("treatment")
    )
    return control.unionByName(treated).select(
        "k_geo", "arm", "searches", F.floor("_median").alias("median_candidates"), *names
    )


def widening_table(
    df: DataFrame, cascade: Sequence[tuple[str, Sequence[str]]], geo: str, score: str,
    cohort: str, ties: Sequence[str], k: int = metrics.DEFAULT_K,
) -> DataFrame:
    """Per rung: groups, median set, mean spread of the first screen and cohort reach.

    Rows are never copied per rung. The first ``k`` of a rung are among the first ``k`` of the cells
    that all keys make together, so those few and the counts per (cell, place) are what goes through the
    rungs; the rung key is null-padded so all rungs share one plan.
    """
    columns = list(dict.fromkeys(c for _, keys in cascade for c in keys))
    rungs = F.array(
        *[
            F.struct(
                F.lit(name).alias("rung"),
                *[
                    (F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType)).alias(
                        f"_k_{c}"
                    )
                    for c in columns
                ],
            )
            for name, keys in cascade
        ]
    )

    def per_rung(cells: DataFrame, *kept: str) -> DataFrame:
        return cells.select(*kept, F.explode(rungs).alias("_r")).select(
            *kept, F.to_json("_r").alias("_group"), "_r.rung"
        )

    kept = list(dict.fromkeys([geo, score, cohort, *ties]))
    rows = ordering.session.stage(df.select(*dict.fromkeys([*columns, *kept])))
    counted, _ = ordering.session.measured(rows.groupBy(*columns, geo).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(cohort), 1)).alias("_members")
    ))
    group = ["rung", "_group"]
    counts = per_rung(counted, geo, "_n", "_members").groupBy(*group, geo).agg(
        F.sum("_n").alias("_n"), F.sum("_members").alias("_members")
    )
    best = metrics.first_rows(
        ordering.contenders(rows, columns, [score], ties, k), columns, score, ties, k
    ).select(*dict.fromkeys([*columns, *kept]))
    best, _ = ordering.session.measured(best)
    top = metrics.first_rows(per_rung(best, *kept), group, score, ties, k)
    top, _ = ordering.session.measured(top)
    spread = _concentration(counts, top, group, geo, k)
    sizes = ordering.group_median(spread, ["rung"], "n", "_median")
    means = spread.groupBy("rung").agg(
        F.count(F.lit(1)).alias("groups"), F.avg("geos_in_top_k").alias("geos_in_top_k"),
        F.avg("coverage").alias("coverage"), F.avg("entropy").alias("entropy"),
    )
    members = counts.groupBy(*group).agg(F.sum("_n").alias("_n"), F.sum("_members").alias("_members"))
    reach = _reach(members, top, ["_group"], cohort, k, ["rung"])
    return means.join(sizes, "rung").join(reach, "rung").select(
        "rung", "groups", F.floor("_median").alias("median_set"), "geos_in_top_k", "coverage",
        "entropy", F.col("reach_rate").alias("cold_reach"),
        F.col("random_rate").alias("cold_random"), F.col("lift").alias("cold_lift"),
    )


def exposure_report(profile: DataFrame, widening: DataFrame) -> DataFrame:
    """Population profile and sealed-fold widening side by side, keeping rungs of either."""
    right = widening.withColumnRenamed("groups", "groups_sealed")
    return profile.join(right, "rung", "full_outer")
