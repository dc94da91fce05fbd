"""Ranking metrics, bootstraps, floors, comparison tables and baselines on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.common import (
    GRADED_SQL,
    TIES,
    TIES_SQL,
    bootstrap_sql,
    draws_sql,
    graded_lines,
    ndcg_sql,
    r_sql,
    rnd,
    rounded,
    table,
)
from rankloom.functions import parsing
from rankloom.operators import baseline, comparability, metrics, ordering, report

QUERIES, SQL = {}, {}
PRICE = "l_extendedprice"


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL)
          + "SELECT l_suppkey, size, " + r_sql("ndcg") + " AS ndcg FROM n_ndcg")
def ndcg_per_group(spark, folder):
    """NDCG@10 of the price order inside each supplier."""
    out = metrics.ndcg_at_k(graded_lines(spark, folder), ["l_suppkey"], "grade", PRICE, TIES)
    return rounded(out, "ndcg")


@register("WITH" + GRADED_SQL + ","
          + ndcg_sql("graded", "l_orderkey", "grade", PRICE, TIES_SQL, k=5, gain="{g}")
          + "SELECT l_orderkey, size, " + r_sql("ndcg") + " AS ndcg FROM n_ndcg")
def ndcg_linear_small_groups(spark, folder):
    """Linear gain at cut-off 5 over small groups, degenerate groups null."""
    out = metrics.ndcg_at_k(
        graded_lines(spark, folder), ["l_orderkey"], "grade", PRICE, TIES, k=5, exponential=False
    )
    return rounded(out, "ndcg")


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_orderkey", "grade", PRICE, TIES_SQL)
          + """, d AS (SELECT l_orderkey, max(grade) AS g, min(grade) AS lo FROM graded GROUP BY ALL)
SELECT l_orderkey, size, """ + r_sql("CASE WHEN lo < g THEN ndcg WHEN g > 0 THEN 1.0 END")
          + " AS ndcg FROM n_ndcg JOIN d USING (l_orderkey)")
def ndcg_with_degenerate(spark, folder):
    """The convention that scores single-grade groups 1.0 (all-zero groups stay null)."""
    out = metrics.ndcg_at_k(
        graded_lines(spark, folder), ["l_orderkey"], "grade", PRICE, TIES, include_degenerate=True
    )
    return rounded(out, "ndcg")


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL)
          + "SELECT l_suppkey, " + r_sql("recall") + " AS recall FROM n_ndcg")
def recall_per_group(spark, folder):
    """Share of rows graded 3+ inside the first 10."""
    out = metrics.recall_at_k(graded_lines(spark, folder), ["l_suppkey"], "grade", PRICE, TIES)
    return rounded(out, "recall")


@register("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, """
          + TIES_SQL + """) AS INT) AS rank FROM lineitem) WHERE rank <= 10""")
def top_k_per_group(spark, folder):
    """The ten best rows of each group."""
    out = metrics.first_rows(table(spark, folder, "lineitem"), ["l_suppkey"], PRICE, TIES)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", PRICE, "rank")


@register("""
SELECT """ + TIES_SQL + """, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount DESC, """
          + TIES_SQL + """) AS rank FROM lineitem""")
def full_group_rank(spark, folder):
    """Exact position of every row in three very large groups."""
    order = [F.desc("l_discount"), *[F.col(c) for c in TIES]]
    out = ordering.group_rank(table(spark, folder, "lineitem"), ["l_returnflag"], order)
    return out.select(*TIES, "rank")


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL) + ","
          + bootstrap_sql("n_ndcg", "", "ndcg", "l_suppkey", 2000)
          + "SELECT " + r_sql("ndcg") + " AS ndcg, " + r_sql("ndcg_low") + " AS ndcg_low, "
          + r_sql("ndcg_high") + " AS ndcg_high FROM b_ci")
def bootstrap_interval(spark, folder):
    """Mean NDCG with a 2,000-draw percentile interval over groups."""
    per_group = metrics.ndcg_at_k(
        graded_lines(spark, folder), ["l_suppkey"], "grade", PRICE, TIES
    )
    out = metrics.bootstrap_ci(per_group, [], ["ndcg"], ["l_suppkey"])
    return rounded(out, "ndcg", "ndcg_low", "ndcg_high")


_REGION = """, sliced AS (SELECT 'overall' AS slice, l_suppkey, ndcg, recall FROM n_ndcg UNION ALL
  SELECT CAST(s_nationkey % 5 AS VARCHAR), l_suppkey, ndcg, recall FROM n_ndcg
  JOIN supplier ON s_suppkey = l_suppkey),"""


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL)
          + _REGION + bootstrap_sql("sliced", "slice", "ndcg", "l_suppkey", 200) + ","
          + bootstrap_sql("sliced", "slice", "recall", "l_suppkey", 200, prefix="c") + """
SELECT slice, count(*) AS groups, count(*) FILTER (s.ndcg IS NULL) AS degenerate,
  """ + ", ".join(r_sql(f"min({t}.{c})") + f" AS {c}" for t, c in (
    ("b_ci", "ndcg"), ("b_ci", "ndcg_low"), ("b_ci", "ndcg_high"), ("c_ci", "recall"),
    ("c_ci", "recall_low"), ("c_ci", "recall_high"))) + """
FROM sliced s JOIN b_ci USING (slice) JOIN c_ci USING (slice) GROUP BY slice""")
def evaluated_ranking(spark, folder):
    """NDCG and recall with intervals, overall and per breakdown label."""
    lines = graded_lines(spark, folder)
    labels = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("label")
    )
    out = metrics.evaluate_ranking(
        ordering.attach(lines, labels, ["l_suppkey"]), ["l_suppkey"], "grade", PRICE, TIES,
        breakdown="label", iterations=200,
    )
    return rounded(out, "ndcg", "ndcg_low", "ndcg_high", "recall", "recall_low", "recall_high")


@register("""
SELECT """ + TIES_SQL + """, CASE WHEN n <= 3 THEN '1-3' WHEN n <= 6 THEN '4-6' WHEN n <= 50 THEN '7-50' END
  AS size_band, CAST(CASE WHEN n <= 3 THEN 0 WHEN n <= 6 THEN 1 WHEN n <= 50 THEN 2 END AS INT) AS size_band_order
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""")
def group_size_bands(spark, folder):
    """Each row labelled with its group's size band."""
    out = metrics.size_band(
        table(spark, folder, "lineitem", *TIES), ["l_orderkey"], (0, 3, 6, 50)
    )
    return out.select(*TIES, "size_band", "size_band_order")


FLOOR_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FLOOR_SQL = f"""
shuffled AS (SELECT l_suppkey, grade, (pow(2, grade) - 1) AS gain, d.draw, row_number() OVER (
    PARTITION BY l_suppkey, d.draw ORDER BY {draws_sql('0', 'd.draw', *FLOOR_IDS)} DESC,
    {', '.join(FLOOR_IDS)}) AS sr
  FROM graded CROSS JOIN (SELECT unnest(range(0, 20)) AS draw) d),
floors AS (SELECT l_suppkey, CASE WHEN min(grade) = max(grade) THEN NULL ELSE
    sum(CASE WHEN sr <= 10 THEN gain / log2(sr + 1) ELSE 0 END) / 20 END AS dcg
  FROM shuffled GROUP BY ALL),
ideal AS (SELECT l_suppkey, sum((pow(2, grade) - 1) / log2(ir + 1)) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY grade DESC) AS ir FROM graded)
  WHERE ir <= 10 GROUP BY ALL),
floor_table AS (SELECT l_suppkey, dcg / idcg AS floor FROM floors JOIN ideal USING (l_suppkey))"""


@register("WITH" + GRADED_SQL + "," + FLOOR_SQL + "SELECT l_suppkey, " + r_sql("floor")
          + " AS floor FROM floor_table")
def random_floor(spark, folder):
    """Per-group NDCG of a random order, mean of 20 reproducible shuffles."""
    out = report.random_floor(graded_lines(spark, folder), ["l_suppkey"], "grade", FLOOR_IDS)
    return rounded(out, "floor")


@register("WITH" + GRADED_SQL + """,
ideal AS (SELECT l_suppkey, sum((pow(2, grade) - 1) / log2(ir + 1)) FILTER (ir <= 10) AS idcg,
    avg(pow(2, grade) - 1) AS mean_gain, sum(1 / log2(ir + 1)) FILTER (ir <= 10) AS discounts,
    min(grade) = max(grade) AS degenerate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY grade DESC) AS ir FROM graded) GROUP BY ALL)
SELECT l_suppkey, """ + r_sql("CASE WHEN NOT degenerate THEN mean_gain * discounts / idcg END")
          + " AS floor FROM ideal")
def expected_floor(spark, folder):
    """The exact expectation of the same floor, without draws."""
    out = report.expected_floor(graded_lines(spark, folder), ["l_suppkey"], "grade")
    return rounded(out, "floor")


RANKERS = {"price": PRICE, "quantity": "l_quantity", "late": "l_linenumber"}
_PER_RANKER = ",".join(
    ndcg_sql("graded", "l_suppkey", "grade", column, TIES_SQL, prefix=name)
    for name, column in RANKERS.items()
)
_HELD = "held AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS ranker, l_suppkey, size, ndcg FROM {name}_ndcg" for name in RANKERS
) + ")"
COMPARISON_SQL = "WITH" + GRADED_SQL + "," + _PER_RANKER + "," + _HELD + "," + FLOOR_SQL + """,
labelled AS (SELECT h.*, h.ndcg - r.ndcg AS vs, CAST(s_nationkey % 3 AS VARCHAR) AS label FROM held h
  JOIN (SELECT l_suppkey, ndcg FROM held WHERE ranker = 'price') r USING (l_suppkey)
  JOIN supplier ON s_suppkey = l_suppkey),
sliced AS (SELECT slice || '/' || ranker AS k, * FROM (SELECT 'overall' AS slice, * FROM labelled
  UNION ALL SELECT CASE WHEN size > 10 THEN 'n>10' ELSE 'n<=10' END, * FROM labelled
  UNION ALL SELECT label, * FROM labelled)),
""" + bootstrap_sql("sliced", "k", "ndcg", "l_suppkey", 200) + "," + bootstrap_sql(
    "sliced", "k", "vs", "l_suppkey", 200, prefix="v") + """,
slice_floor AS (SELECT slice, avg(floor) AS floor FROM sliced JOIN floor_table USING (l_suppkey)
  WHERE ranker = 'price' GROUP BY ALL),
comparison AS (SELECT slice, ranker, count(s.ndcg) AS groups, count(*) FILTER (s.ndcg IS NULL) AS degenerate,
    min(b_ci.ndcg) AS ndcg, min(ndcg_low) AS ndcg_low, min(ndcg_high) AS ndcg_high,
    min(f.floor) AS floor, min(v_ci.vs) AS vs_price, min(vs_low) AS vs_low, min(vs_high) AS vs_high
  FROM sliced s JOIN b_ci USING (k) JOIN v_ci USING (k) JOIN slice_floor f USING (slice)
  GROUP BY slice, ranker)"""


def comparison(spark, folder):
    lines = graded_lines(spark, folder)
    labels = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 3).alias("label")
    )
    lines = ordering.session.stage(ordering.attach(lines, labels, ["l_suppkey"]))
    floor = report.random_floor(lines, ["l_suppkey"], "grade", FLOOR_IDS)
    return report.comparison_table(
        lines, ["l_suppkey"], "grade", RANKERS, TIES, reference="price", breakdown="label",
        floor=floor, iterations=200,
    )


_VALUES = ["ndcg", "ndcg_low", "ndcg_high", "floor", "range_share", "vs_price", "vs_low", "vs_high"]


@register(COMPARISON_SQL + "SELECT slice, ranker, groups, degenerate, " + ", ".join(
    r_sql("(ndcg - floor) / (1 - floor)" if v == "range_share" else v) + f" AS {v}" for v in _VALUES
) + " FROM comparison")
def comparison_table(spark, folder):
    """Every ranker on every slice with floors, range shares and paired differences."""
    return rounded(comparison(spark, folder), *_VALUES)


@register(COMPARISON_SQL + """
SELECT format('NDCG@10 {:.4f} [{:.4f}, {:.4f}] against price at {:.4f} and a random floor of {:.4f} on {:d} groups (overall)',
    q.ndcg, q.ndcg_low, q.ndcg_high, p.ndcg, q.floor, q.groups)
  || printf('; the difference is %+.4f [%+.4f, %+.4f] paired, and it traverses %.1f%% of the floor-to-1 range against %.1f%% for price.',
    q.vs_price, q.vs_low, q.vs_high, (q.ndcg - q.floor) / (1 - q.floor) * 100,
    (p.ndcg - p.floor) / (1 - p.floor) * 100) AS sentence
FROM comparison q JOIN comparison p ON q.slice = p.slice AND p.ranker = 'price'
WHERE q.slice = 'overall' AND q.ranker = 'quantity'""")
def headline_sentence(spark, folder):
    """The result sentence written from the table."""
    return report.headline(comparison(spark, folder), "quantity", "price")


@register("WITH" + GRADED_SQL + "," + _PER_RANKER + """,
delta AS (SELECT l_suppkey, q.ndcg - p.ndcg AS difference FROM quantity_ndcg q JOIN price_ndcg p
  USING (l_suppkey)),""" + bootstrap_sql("delta", "", "difference", "l_suppkey", 500)
          + "SELECT " + ", ".join(r_sql(c) + f" AS {c}" for c in (
              "difference", "difference_low", "difference_high")) + " FROM b_ci")
def paired_difference(spark, folder):
    """Two rankers on the same groups, one resample for both."""
    lines = graded_lines(spark, folder)
    one = metrics.ndcg_at_k(lines, ["l_suppkey"], "grade", "l_quantity", TIES)
    two = metrics.ndcg_at_k(lines, ["l_suppkey"], "grade", PRICE, TIES)
    out = report.paired_difference(one, two, ["l_suppkey"], iterations=500)
    return rounded(out, "difference", "difference_low", "difference_high")


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL) + """,
low AS (SELECT l_suppkey, ndcg AS t FROM n_ndcg JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 5000),
high AS (SELECT l_suppkey, ndcg AS r FROM n_ndcg JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 5000),
""" + bootstrap_sql("low", "", "t", "l_suppkey", 500, seed=0, prefix="x") + ","
          + bootstrap_sql("high", "", "r", "l_suppkey", 500, seed=1, prefix="y") + """
SELECT """ + r_sql("(SELECT avg(t) FROM low) - (SELECT avg(r) FROM high)") + " AS difference, "
          + r_sql("quantile_cont(x.m - y.m, 0.025)") + " AS difference_low, "
          + r_sql("quantile_cont(x.m - y.m, 0.975)") + """ AS difference_high
FROM x_mean x JOIN y_mean y USING (draw)""")
def unpaired_difference(spark, folder):
    """Two sets of groups that share no member, resampled independently."""
    lines = graded_lines(spark, folder)
    per_group = metrics.ndcg_at_k(lines, ["l_suppkey"], "grade", PRICE, TIES)
    rich = table(spark, folder, "supplier", "s_suppkey", "s_acctbal").withColumnRenamed(
        "s_suppkey", "l_suppkey"
    )
    labelled = per_group.join(rich, "l_suppkey")
    out = report.unpaired_difference(
        labelled.filter("s_acctbal < 5000"), labelled.filter("s_acctbal >= 5000"), ["l_suppkey"],
        iterations=500,
    )
    return rounded(out, "difference", "difference_low", "difference_high")


@register("WITH" + GRADED_SQL + "," + _PER_RANKER + "," + _HELD + """
SELECT count(*) AS seeds, """ + ", ".join(r_sql(e) + f" AS {n}" for n, e in (
    ("ndcg_mean", "avg(m)"), ("ndcg_sd", "stddev_samp(m)"), ("ndcg_min", "min(m)"),
    ("ndcg_max", "max(m)"))) + """, stddev_samp(m) = 0 AS deterministic
FROM (SELECT ranker, avg(ndcg) AS m FROM held GROUP BY ALL)""")
def seed_summary(spark, folder):
    """Mean, spread and range across rankers that stand for seeds."""
    lines = graded_lines(spark, folder)
    held = report.per_group_table(lines, ["l_suppkey"], "grade", RANKERS, TIES)
    levels = held.groupBy("ranker").agg(F.avg("ndcg").alias("ndcg")).select(
        F.lit("overall").alias("slice"), F.concat(F.lit("model_seed"), "ranker").alias("ranker"),
        "ndcg", F.lit(0).alias("groups"), F.lit(0.0).alias("floor"),
    )
    out = report.summarise_seeds(levels).select(
        "seeds", "ndcg_mean", "ndcg_sd", "ndcg_min", "ndcg_max", "deterministic"
    )
    return rounded(out, "ndcg_mean", "ndcg_sd", "ndcg_min", "ndcg_max")


ACCURACY_SQL = "WITH" + GRADED_SQL + f""",
celled AS (SELECT l_linenumber || '|f' || l_returnflag AS cell, l_suppkey, {PRICE} AS score, grade FROM graded),
judged AS (SELECT x.cell, x.l_suppkey = y.l_suppkey AS same, count(*) AS n,
    sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS hits
  FROM celled x JOIN celled y ON x.cell = y.cell AND x.grade > y.grade GROUP BY ALL),
accuracy AS (SELECT cell,
    CASE WHEN sum(n) FILTER (same) >= 10 THEN CAST(sum(hits) FILTER (same) AS DOUBLE) / sum(n) FILTER (same) END AS within,
    CASE WHEN sum(n) FILTER (NOT same) >= 10
      THEN CAST(sum(hits) FILTER (NOT same) AS DOUBLE) / sum(n) FILTER (NOT same) END AS cross_
  FROM (SELECT DISTINCT cell FROM celled) LEFT JOIN judged USING (cell) GROUP BY cell)"""


@register(ACCURACY_SQL + "SELECT cell, " + r_sql("within") + " AS within, " + r_sql("cross_")
          + " AS cross_ FROM accuracy")
def pair_accuracy(spark, folder):
    """Share of all pairs with different grades ordered correctly, within and across groups, per cell."""
    return rounded(
        _accuracy(spark, folder).withColumnRenamed("cross", "cross_"), "within", "cross_"
    )


def _accuracy(spark, folder):
    lines = graded_lines(spark, folder)
    celled = comparability.evaluation_cells(lines, "l_linenumber", "l_returnflag")
    return comparability.pair_accuracy(celled, ["cell"], "l_suppkey", PRICE, "grade", min_pairs=10)


@register(ACCURACY_SQL + """,
sides AS (SELECT 'within' AS pairs, cell, within AS estimate FROM accuracy
  UNION ALL SELECT 'cross', cell, cross_ FROM accuracy
  UNION ALL SELECT 'difference', cell, cross_ - within FROM accuracy),"""
          + bootstrap_sql("sides", "pairs", "estimate", "cell", 500) + """
SELECT pairs, count(s.estimate) AS cells, """ + ", ".join(
    r_sql(f"min(b_ci.{c})") + f" AS {n}" for c, n in (
        ("estimate", "estimate"), ("estimate_low", "low"), ("estimate_high", "high")))
          + " FROM sides s JOIN b_ci USING (pairs) GROUP BY pairs HAVING count(s.estimate) > 0")
def comparability_table(spark, folder):
    """Within against cross accuracy and the paired difference over cells."""
    out = comparability.comparability(_accuracy(spark, folder), ["cell"], iterations=500)
    return rounded(out, "estimate", "low", "high")


@register("""
SELECT """ + TIES_SQL + """, CAST(l_quantity AS DOUBLE) AS reviews FROM lineitem""")
def review_count_baseline(spark, folder):
    """Score by count."""
    out = baseline.rank_by_reviews(table(spark, folder, "lineitem"), "l_quantity", "reviews")
    return out.select(*TIES, "reviews")


_PCT = """(rank() OVER (PARTITION BY l_suppkey ORDER BY {c}) + (count(*) OVER (PARTITION BY l_suppkey, {c}) - 1) / 2.0)
  / count(*) OVER (PARTITION BY l_suppkey)"""


@register("SELECT " + TIES_SQL + ", " + r_sql("0.5 * " + _PCT.format(c="l_quantity") + " - 0.5 * "
          + _PCT.format(c=PRICE)) + " AS price_rating FROM lineitem")
def price_rating_baseline(spark, folder):
    """Half rating percentile minus half price percentile inside each group, ties averaged."""
    out = baseline.rank_by_price_and_rating(
        table(spark, folder, "lineitem"), ["l_suppkey"], PRICE, "l_quantity"
    )
    return out.select(*TIES, rnd("price_rating").alias("price_rating"))


@register("SELECT " + TIES_SQL + ", " + r_sql("pow(2, l_linenumber) - 1") + " AS gain FROM lineitem")
def label_gains(spark, folder):
    """Exponential gain."""
    return table(spark, folder, "lineitem").select(
        *TIES, rnd(parsing.label_gain(F.col("l_linenumber"))).alias("gain")
    )


@register("""
SELECT """ + TIES_SQL + ", " + r_sql("(rank() OVER (PARTITION BY l_returnflag ORDER BY l_tax) + (count(*) OVER "
          "(PARTITION BY l_returnflag, l_tax) - 1) / 2.0) / count(*) OVER (PARTITION BY l_returnflag)", 9)
          + " AS share FROM lineitem")
def percentile_ranks(spark, folder):
    """Average-tie percentile rank inside three very large groups with nine tied values."""
    out = ordering.average_rank(
        table(spark, folder, "lineitem"), ["l_returnflag"], "l_tax", "rank", share="share"
    )
    return out.select(*TIES, rnd("share", 9).alias("share"))
