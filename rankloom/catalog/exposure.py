"""Exposure, retrieval policies and fairness on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.common import (
    GRADED_SQL,
    TIES,
    TIES_SQL,
    bootstrap_sql,
    graded_lines,
    ndcg_sql,
    r_sql,
    rounded,
    table,
)
from rankloom.catalog.features import PART_CASCADE, PART_GROUPS_SQL, tiered_parts
from rankloom.operators import exposure, fairness, metrics, ordering

QUERIES, SQL = {}, {}
PRICE = "l_extendedprice"


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@register("""
SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS rung_group FROM part""")
def rung_labels(spark, folder):
    """Plain re-keying at one rung."""
    out = exposure.rung_labels(table(spark, folder, "part"), ["p_brand", "p_type"])
    return out.select("p_partkey", "rung_group")


@register("WITH " + PART_GROUPS_SQL + """,
sizes AS (SELECT 'type_brand_tier' AS rung, 'p_type x p_brand x tier' AS key, count(*) AS n
  FROM tiered GROUP BY p_type, p_brand, tier
  UNION ALL SELECT 'type_tier', 'p_type x tier', count(*) FROM tiered GROUP BY p_type, tier
  UNION ALL SELECT 'type', 'p_type', count(*) FROM tiered GROUP BY p_type)
SELECT rung, key, count(*) AS groups, CAST(floor(median(n)) AS BIGINT) AS median,
  CAST(floor(quantile_cont(n, 0.9)) AS BIGINT) AS p90, max(n) AS max,
  count(*) FILTER (n > 100) AS over_cap, count(*) FILTER (n > 100) = 0 AS serviceable
FROM sizes GROUP BY ALL""")
def candidate_set_profile(spark, folder):
    """How large one search becomes at each rung."""
    return exposure.candidate_set_profile(tiered_parts(spark, folder), PART_CASCADE, cap=100)


def _priced_lines(spark, folder):
    """Lines with their part's brand as the place."""
    parts = table(spark, folder, "part", "p_partkey", "p_brand").withColumnRenamed(
        "p_partkey", "l_partkey"
    )
    return table(spark, folder, "lineitem").join(parts, "l_partkey")


@register("""
WITH j AS (SELECT l.*, p_brand FROM lineitem l JOIN part ON p_partkey = l_partkey),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, """
          + TIES_SQL + """) AS rn FROM j),
a AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT p_brand) AS geos_available FROM j GROUP BY ALL),
c AS (SELECT l_suppkey, p_brand, count(*) AS c FROM t WHERE rn <= 10 GROUP BY ALL),
s AS (SELECT l_suppkey, count(*) AS geos_in_top_k, sum(c) AS t FROM c GROUP BY ALL),
e AS (SELECT l_suppkey, -sum((c / t) * ln(c / t)) AS h FROM c JOIN s USING (l_suppkey) GROUP BY ALL)
SELECT l_suppkey, n, geos_available, geos_in_top_k,
  """ + r_sql("geos_in_top_k / least(10, geos_available)") + """ AS coverage,
  """ + r_sql("CASE WHEN least(10, geos_available) > 1 THEN h / ln(least(10, geos_available)) END")
          + " AS entropy FROM a JOIN s USING (l_suppkey) JOIN e USING (l_suppkey)")
def geographic_concentration(spark, folder):
    """Spread of places in the first screen of each group."""
    out = exposure.geographic_concentration(
        _priced_lines(spark, folder), ["l_suppkey"], "p_brand", PRICE, TIES
    )
    return rounded(out, "coverage", "entropy")


@register("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, """
          + TIES_SQL + """) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT count(*) AS cohort, count(*) FILTER (rn <= 10) AS reached,
  """ + r_sql("count(*) FILTER (rn <= 10) / count(*)", 9) + " AS reach_rate, "
          + r_sql("avg(least(10, n) / n)", 9) + " AS random_rate, "
          + r_sql("count(*) FILTER (rn <= 10) / count(*) - avg(least(10, n) / n)", 9) + """ AS lift
FROM t WHERE l_quantity > 40""")
def cohort_reach(spark, folder):
    """Share of a cohort in the first screen against the exact shuffle expectation."""
    lines = table(spark, folder, "lineitem").withColumn("cohort", F.col("l_quantity") > 40)
    out = exposure.cohort_reach(lines, ["l_suppkey"], PRICE, TIES, "cohort")
    return rounded(out, "reach_rate", "random_rate", "lift", places=9)


_RANKS = ", ".join(
    f"row_number() OVER (PARTITION BY l_suppkey ORDER BY {c} DESC, {TIES_SQL}) AS {n}"
    for n, c in (("ri", "grade"), ("rp", PRICE), ("rq", "l_quantity"))
)


@register("WITH" + GRADED_SQL + f""", t AS (SELECT *, {_RANKS}, count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM graded), w AS (SELECT * FROM t WHERE l_tax = 0 AND grade >= 3)
SELECT ranker, count(*) AS cohort, """ + r_sql("avg(hit)", 9) + """ AS reach_rate FROM (
  SELECT 'ideal' AS ranker, CAST(ri <= 10 AS DOUBLE) AS hit FROM w
  UNION ALL SELECT 'price', CAST(rp <= 10 AS DOUBLE) FROM w
  UNION ALL SELECT 'quantity', CAST(rq <= 10 AS DOUBLE) FROM w
  UNION ALL SELECT 'random', least(10, n) / n FROM w) GROUP BY ALL""")
def cold_start_reach(spark, folder):
    """Deserving never-reviewed rows each ranker surfaces."""
    lines = graded_lines(spark, folder, "l_tax")
    out = exposure.cold_start_reach(
        lines, ["l_suppkey"], "grade", "l_tax", {"price": PRICE, "quantity": "l_quantity"}, TIES
    )
    return rounded(out, "reach_rate", places=9)


_DEMAND = """demand AS (SELECT g.*, p_type, p_brand, l_returnflag || l_linestatus AS search
  FROM graded g JOIN part ON p_partkey = l_partkey),
prior AS (SELECT p_type, p_brand, avg(grade) AS prior FROM demand WHERE l_linenumber < 6 GROUP BY ALL
  UNION ALL SELECT p_type, NULL, avg(grade) FROM demand WHERE l_linenumber < 6 GROUP BY p_type)"""


def _demand(spark, folder):
    parts = table(spark, folder, "part", "p_partkey", "p_type", "p_brand").withColumnRenamed(
        "p_partkey", "l_partkey"
    )
    lines = graded_lines(spark, folder, "l_linestatus", "l_tax").join(parts, "l_partkey")
    return lines.withColumns(
        {"search": F.concat("l_returnflag", "l_linestatus"), "cold": F.col("l_tax") == 0}
    )


@register("WITH" + GRADED_SQL + "," + _DEMAND + "SELECT p_type, p_brand, " + r_sql("prior") + " AS prior FROM prior")
def demand_prior(spark, folder):
    """Mean grade per place with a city fallback row, from training rows only."""
    training = _demand(spark, folder).filter("l_linenumber < 6")
    return rounded(exposure.demand_prior(training, "p_type", "p_brand"), "prior")


# A search is a part type; its places are brands.
_ARMS = "WITH" + GRADED_SQL + "," + _DEMAND + """,
places AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(p.prior, c.prior)
    DESC, p_brand) AS geo_rank FROM (SELECT DISTINCT p_type, p_brand FROM demand)
  LEFT JOIN prior p USING (p_type, p_brand)
  LEFT JOIN (SELECT p_type, prior FROM prior WHERE p_brand IS NULL) c USING (p_type)),
armed AS (SELECT a.k_geo, a.arm, d.* FROM demand d JOIN places USING (p_type, p_brand) CROSS JOIN
    (SELECT k_geo, arm FROM (SELECT unnest([1, 2, 3, 5]) AS k_geo), (SELECT unnest(['control', 'treatment']) AS arm)) a
  WHERE a.arm = 'control' OR geo_rank <= a.k_geo),
screened AS (SELECT *, row_number() OVER (PARTITION BY k_geo, arm, p_type ORDER BY l_extendedprice DESC, """ + TIES_SQL + """) AS rn FROM armed),
screens AS (SELECT k_geo, arm, p_type, count(*) AS shown, avg(grade) AS mean_grade,
    avg(CAST(grade >= 3 AS INT)) AS relevant_share, count(DISTINCT p_brand) AS distinct_geos,
    avg(CAST(l_tax = 0 AS INT)) AS cold_share, avg(CAST(l_tax = 0 AND grade >= 3 AS INT)) AS deserving_cold_share
  FROM screened WHERE rn <= 10 GROUP BY ALL)"""
_SCREEN = ["mean_grade", "relevant_share", "distinct_geos", "cold_share", "deserving_cold_share"]


@register(_ARMS + """
SELECT """ + TIES_SQL + """ FROM demand JOIN places USING (p_type, p_brand) WHERE geo_rank <= 3""")
def selected_geographies(spark, folder):
    """Candidates in the three highest-prior places of their search."""
    lines = _demand(spark, folder)
    prior = exposure.demand_prior(lines.filter("l_linenumber < 6"), "p_type", "p_brand")
    out = exposure.select_geographies(lines, prior, ["p_type"], "p_type", "p_brand", 3)
    return out.select(*TIES)


@register(_ARMS + """
SELECT p_type, shown, """ + ", ".join(
    (r_sql(c) + f" AS {c}") if c != "distinct_geos" else c for c in _SCREEN
) + " FROM screens WHERE arm = 'control' AND k_geo = 1")
def screen_composition(spark, folder):
    """What the first screen of each search holds."""
    out = exposure.screen_composition(
        _demand(spark, folder), ["p_type"], "p_brand", "grade", "cold", PRICE, TIES
    )
    return rounded(out, *[c for c in _SCREEN if c != "distinct_geos"])


@register(_ARMS + """, sizes AS (SELECT k_geo, arm, p_type, count(*) AS n FROM armed GROUP BY ALL)
SELECT k_geo, arm, count(*) AS searches, m AS median_candidates, """ + ", ".join(
    r_sql(f"avg({c})") + f" AS {c}" for c in _SCREEN) + """
FROM screens JOIN (SELECT k_geo, arm, CAST(floor(median(n)) AS BIGINT) AS m FROM sizes GROUP BY ALL) USING (k_geo, arm)
GROUP BY k_geo, arm, m""")
def retrieval_arms(spark, folder):
    """Control against narrowed retrieval at every width."""
    lines = _demand(spark, folder)
    prior = exposure.demand_prior(lines.filter("l_linenumber < 6"), "p_type", "p_brand")
    out = exposure.simulate_arms(
        lines, prior, ["p_type"], "p_type", "p_brand", "grade", "cold", PRICE, TIES
    )
    return rounded(out, *_SCREEN)


LINE_CASCADE = (("flag_line", ("l_returnflag", "l_linestatus", "l_linenumber")),
                ("flag", ("l_returnflag", "l_linestatus")), ("all", ("l_returnflag",)))


@register("""
WITH j AS (SELECT l.*, p_brand FROM lineitem l JOIN part ON p_partkey = l_partkey),
k AS (SELECT 'flag_line' AS rung, l_returnflag || l_linestatus || l_linenumber AS g, * FROM j
  UNION ALL SELECT 'flag', l_returnflag || l_linestatus, * FROM j
  UNION ALL SELECT 'all', l_returnflag, * FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY rung, g ORDER BY l_extendedprice DESC, """ + TIES_SQL
          + """) AS rn, count(*) OVER (PARTITION BY rung, g) AS n FROM k),
a AS (SELECT rung, g, count(*) AS n, count(DISTINCT p_brand) AS avail FROM k GROUP BY ALL),
c AS (SELECT rung, g, p_brand, count(*) AS c FROM t WHERE rn <= 10 GROUP BY ALL),
s AS (SELECT rung, g, count(*) AS shown, -sum((c / 10.0) * ln(c / 10.0)) AS h FROM c GROUP BY ALL),
r AS (SELECT rung, count(*) FILTER (rn <= 10) / count(*) AS reach, avg(least(10, n) / n) AS chance
  FROM t WHERE l_tax = 0 GROUP BY ALL)
SELECT rung, count(*) AS groups, CAST(floor(median(n)) AS BIGINT) AS median_set,
  """ + r_sql("avg(shown)") + " AS geos_in_top_k, " + r_sql("avg(shown / least(10, avail))")
          + " AS coverage, " + r_sql("avg(h / ln(least(10, avail)))") + " AS entropy, "
          + r_sql("min(reach)", 9) + " AS cold_reach, " + r_sql("min(chance)", 9) + " AS cold_random, "
          + r_sql("min(reach) - min(chance)", 9) + """ AS cold_lift
FROM a JOIN s USING (rung, g) JOIN r USING (rung) GROUP BY rung""")
def widening_table(spark, folder):
    """First-screen spread and cohort reach as the search widens."""
    lines = _priced_lines(spark, folder).withColumn("cold", F.col("l_tax") == 0)
    out = exposure.widening_table(lines, LINE_CASCADE, "p_brand", PRICE, "cold", TIES)
    out = rounded(out, "geos_in_top_k", "coverage", "entropy")
    return rounded(out, "cold_reach", "cold_random", "cold_lift", places=9)


@register("WITH " + PART_GROUPS_SQL + """
SELECT coalesce(a.rung, b.rung) AS rung, groups, groups_sealed FROM (
  SELECT 'type_brand_tier' AS rung, count(DISTINCT (p_type, p_brand, tier)) AS groups FROM tiered UNION ALL
  SELECT 'type_tier', count(DISTINCT (p_type, tier)) FROM tiered UNION ALL
  SELECT 'type', count(DISTINCT p_type) FROM tiered) a
FULL JOIN (SELECT 'type' AS rung, count(DISTINCT p_type) AS groups_sealed FROM tiered WHERE p_size > 25
  UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM tiered WHERE p_size > 25) b ON a.rung = b.rung""")
def exposure_report(spark, folder):
    """Population profile next to a held-out profile, rungs of either kept."""
    parts = tiered_parts(spark, folder)
    profile = exposure.candidate_set_profile(parts, PART_CASCADE)
    held = exposure.candidate_set_profile(
        parts.filter("p_size > 25"), (("type", ("p_type",)), ("brand", ("p_brand",)))
    ).select("rung", "groups")
    return exposure.exposure_report(profile.select("rung", "groups"), held)


_POS = "(row_number() OVER (PARTITION BY l_suppkey ORDER BY {c} DESC, " + TIES_SQL + ") - 1) / nullif(count(*) OVER (PARTITION BY l_suppkey) - 1, 0)"
DISPLACED_SQL = "displaced AS (SELECT *, " + _POS.format(c="grade") + " - " + _POS.format(c=PRICE) + " AS displacement FROM graded)"


@register("SELECT " + TIES_SQL + ", " + r_sql(_POS.format(c=PRICE)) + " AS position FROM lineitem")
def within_group_position(spark, folder):
    """0 first, 1 last."""
    out = fairness.within_group_position(
        table(spark, folder, "lineitem"), ["l_suppkey"], PRICE, TIES
    )
    return rounded(out.select(*TIES, "position"), "position")


def _displaced(spark, folder):
    lines = graded_lines(spark, folder, "l_tax", "l_linestatus")
    return fairness.displacement(lines, ["l_suppkey"], PRICE, "grade", TIES)


@register("WITH" + GRADED_SQL + "," + DISPLACED_SQL + "SELECT " + TIES_SQL + ", " + r_sql("displacement")
          + " AS displacement FROM displaced")
def displacement(spark, folder):
    """Ideal minus actual position."""
    return rounded(_displaced(spark, folder).select(*TIES, "displacement"), "displacement")


@register("WITH" + GRADED_SQL + "," + DISPLACED_SQL + """
SELECT l_suppkey, """ + r_sql("avg(displacement) FILTER (l_tax >= 0.07) - avg(displacement) FILTER (l_tax < 0.07)")
          + """ AS cohort_gap FROM displaced GROUP BY ALL
HAVING count(*) FILTER (l_tax >= 0.07) >= 3 AND count(*) FILTER (l_tax < 0.07) >= 3""")
def cohort_gap(spark, folder):
    """Mean displacement of a cohort minus the rest, inside each group."""
    lines = _displaced(spark, folder).withColumn("cohort", F.col("l_tax") >= 0.07)
    return rounded(fairness.cohort_gap(lines, ["l_suppkey"], "cohort"), "cohort_gap")


@register("WITH" + GRADED_SQL + """,
t AS (SELECT *, CASE WHEN l_tax >= 0.07 THEN 'cohort' ELSE 'rest' END AS side,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, """ + TIES_SQL + """) <= 10 AS hit,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY grade DESC, """ + TIES_SQL + """) <= 10 AS due FROM graded),
g AS (SELECT side, l_suppkey, avg(CAST(hit AS INT)) AS reach, avg(CAST(due AS INT)) AS earned FROM t
  GROUP BY ALL HAVING count(*) >= 3),
h AS (SELECT *, reach - earned AS amplification FROM g),""" + bootstrap_sql("h", "side", "amplification", "l_suppkey", 500)
          + """
SELECT side, count(*) AS groups, """ + ", ".join(r_sql(e) + f" AS {n}" for n, e in (
    ("reach", "avg(reach)"), ("earned", "avg(earned)"), ("amplification", "min(b_ci.amplification)"),
    ("amplification_low", "min(amplification_low)"), ("amplification_high", "min(amplification_high)")))
          + " FROM h JOIN b_ci USING (side) GROUP BY side")
def exposure_amplification(spark, folder):
    """First-screen reach against earned reach, per side, with intervals."""
    lines = graded_lines(spark, folder, "l_tax").withColumn("cohort", F.col("l_tax") >= 0.07)
    out = fairness.exposure_amplification(
        lines, ["l_suppkey"], PRICE, "grade", "cohort", TIES, iterations=500
    )
    return rounded(out, "reach", "earned", "amplification", "amplification_low", "amplification_high")


@register("WITH" + GRADED_SQL + "," + DISPLACED_SQL + """,
b AS (SELECT *, CASE WHEN l_tax <= 0.02 THEN 0 WHEN l_tax <= 0.05 THEN 1 ELSE 2 END AS band_order FROM displaced
  WHERE l_tax > -1),
g AS (SELECT band_order, l_suppkey, avg(displacement) AS displacement, count(*) AS n FROM b GROUP BY ALL),
big AS (SELECT * FROM g WHERE n >= 3),""" + bootstrap_sql("big", "band_order", "displacement", "l_suppkey", 200)
          + """
SELECT ['low', 'middle', 'high'][band_order + 1] AS band, CAST(band_order AS INT) AS band_order,
  CAST(sum(n) AS BIGINT) AS listings, count(*) FILTER (n >= 3) AS groups, """ + ", ".join(
    r_sql(f"min(b_ci.{c})") + f" AS {n}" for n, c in (("displacement", "displacement"),
    ("low", "displacement_low"), ("high", "displacement_high"))) + """
FROM g JOIN b_ci USING (band_order) GROUP BY band_order""")
def dose_response(spark, folder):
    """Displacement per band of a continuous variable."""
    out = fairness.dose_response(
        _displaced(spark, folder), ["l_suppkey"], "l_tax", (-1, 0.02, 0.05, 1),
        ("low", "middle", "high"), iterations=200,
    )
    return rounded(out, "displacement", "low", "high")


CUTS = (0.02, 0.04, 0.06, 0.08)


@register("WITH" + GRADED_SQL + "," + DISPLACED_SQL + f""",
g AS (SELECT cut, l_suppkey, avg(displacement) FILTER (l_tax >= cut) - avg(displacement) FILTER (l_tax < cut) AS gap,
    count(*) FILTER (l_tax >= cut) AS i, count(*) FILTER (l_tax < cut) AS o
  FROM displaced CROSS JOIN (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in CUTS)}]) AS cut) GROUP BY ALL),
ok AS (SELECT * FROM g WHERE i >= 3 AND o >= 3),""" + bootstrap_sql("ok", "cut", "gap", "l_suppkey", 200) + """
SELECT cut, """ + r_sql("sum(i) / sum(i + o)") + """ AS share, count(*) FILTER (i >= 3 AND o >= 3) AS groups, """
          + ", ".join(r_sql(f"min(b_ci.{c})") + f" AS {n}" for n, c in (
              ("gap", "gap"), ("low", "gap_low"), ("high", "gap_high"))) + """
FROM g JOIN b_ci USING (cut) GROUP BY cut""")
def threshold_ladder(spark, folder):
    """The cohort gap at every cut."""
    out = fairness.threshold_ladder(
        _displaced(spark, folder), ["l_suppkey"], "l_tax", CUTS, iterations=200
    )
    return rounded(out, "share", "gap", "low", "high")


GRID = (-0.1, 0.0, 0.1, 0.2, 0.3)


@register("WITH" + GRADED_SQL + f""",
z AS (SELECT *, l_suppkey % 5 AS fold, coalesce((l_extendedprice - avg(l_extendedprice) OVER w)
    / nullif(stddev_samp(l_extendedprice) OVER w, 0), 0) AS z FROM graded WINDOW w AS (PARTITION BY l_suppkey)),
s AS (SELECT z.*, step || '/' || l_suppkey AS gk, step, o AS off, round(z + o * CAST(l_tax >= 0.07 AS INT), 9) AS sc
  FROM z CROSS JOIN (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS o, unnest(range(0, {len(GRID)})) AS step)),
""" + ndcg_sql("s", "gk", "grade", "sc", TIES_SQL) + """,
v AS (SELECT DISTINCT gk, step, off, fold FROM s), m AS (SELECT step, off, fold, sum(ndcg) AS t, count(ndcg) AS n
  FROM n_ndcg JOIN v USING (gk) GROUP BY ALL),
f AS (SELECT a.fold, a.step, a.off, round(sum(b.t) / sum(b.n), 9) AS fit, min(a.t / a.n) AS here FROM m a
  JOIN m b ON a.step = b.step AND a.fold <> b.fold GROUP BY ALL),
best AS (SELECT fold, off, here, row_number() OVER (PARTITION BY fold ORDER BY fit DESC, step) AS rn FROM f)
SELECT best.fold, best.off AS chosen_offset, """ + r_sql("f.here") + " AS as_is, " + r_sql("best.here")
          + " AS corrected, " + r_sql("best.here - f.here") + """ AS difference
FROM best JOIN f ON f.fold = best.fold AND f.off = 0 WHERE rn = 1""")
def offset_correction(spark, folder):
    """A cohort offset fitted on other folds and tested on the held one."""
    lines = graded_lines(spark, folder, "l_tax").withColumns(
        {"cohort": F.col("l_tax") >= 0.07, "fold": F.col("l_suppkey") % 5}
    )
    out = fairness.offset_correction(
        lines, ["l_suppkey"], "grade", PRICE, "cohort", "fold", TIES, GRID
    )
    return rounded(out, "as_is", "corrected", "difference")


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL) + """,
c AS (SELECT l_suppkey, avg(CAST(l_tax = 0 AS INT)) AS share FROM graded GROUP BY ALL)
SELECT CASE WHEN share <= 0.1 THEN 'few' WHEN share <= 0.115 THEN 'some' ELSE 'many' END AS cold_share,
  count(ndcg) AS groups, """ + r_sql("avg(ndcg)") + " AS ndcg FROM c JOIN n_ndcg USING (l_suppkey) GROUP BY ALL")
def metric_by_cohort_share(spark, folder):
    """NDCG of groups banded by how much of the cohort they hold."""
    from rankloom.functions.bins import cut

    lines = graded_lines(spark, folder, "l_tax")
    share = F.avg((F.col("l_tax") == 0).cast("double"))
    out = metrics.ranking_metrics(
        lines, ["l_suppkey"], "grade", PRICE, TIES, carry={"share": share}
    )
    band = cut(F.col("share"), (-1, 0.1, 0.115, 1), ("few", "some", "many")).alias("cold_share")
    return rounded(
        out.groupBy(band).agg(F.count("ndcg").alias("groups"), F.avg("ndcg").alias("ndcg")), "ndcg"
    )


@register("WITH" + GRADED_SQL + """, p AS (SELECT l_tax = 0 AS cold, """ + ", ".join(
    f"(rank() OVER (PARTITION BY l_suppkey ORDER BY {c}) + (count(*) OVER (PARTITION BY l_suppkey, {c}) - 1) / 2.0)"
    f" / count(*) OVER (PARTITION BY l_suppkey) AS {n}" for n, c in (("ideal", "grade"), ("model", PRICE)))
          + """ FROM graded)
SELECT cold, count(*) AS listings, """ + ", ".join(r_sql(e) + f" AS {n}" for n, e in (
    ("ideal", "avg(ideal)"), ("model", "avg(model)"), ("gap", "avg(model) - avg(ideal)"))) + " FROM p GROUP BY ALL")
def cohort_percentiles(spark, folder):
    """Mean within-group percentile of a cohort by truth and by score."""
    lines = graded_lines(spark, folder, "l_tax")
    ranked = ordering.average_rank(lines, ["l_suppkey"], "grade", "_i", share="ideal")
    ranked = ordering.average_rank(ranked, ["l_suppkey"], PRICE, "_m", share="model")
    out = ranked.groupBy((F.col("l_tax") == 0).alias("cold")).agg(
        F.count(F.lit(1)).alias("listings"), F.avg("ideal").alias("ideal"),
        F.avg("model").alias("model"), (F.avg("model") - F.avg("ideal")).alias("gap"),
    )
    return rounded(out, "ideal", "model", "gap")
