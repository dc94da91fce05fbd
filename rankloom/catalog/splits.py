"""Components, folds and coverage on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.common import GRADED_SQL, draws_sql, graded_lines, r_sql, rounded, table
from rankloom.functions.bins import GROUP_SIZE_LABELS
from rankloom.operators import split

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def linked_orders(spark, folder):
    """Orders as a graph: groups are (customer, priority), clusters (customer, order year).

    Both lie inside a customer, so there are at least as many components as customers.
    """
    return table(spark, folder, "orders").withColumns(
        {
            "query_group": F.col("o_custkey") * 10
            + F.substring("o_orderpriority", 1, 1).cast("long"),
            "cluster_id": F.col("o_custkey") * 10_000 + F.year("o_orderdate"),
            "city": F.col("o_orderstatus"),
        }
    )


GRAPH_SQL = """RECURSIVE linked AS (SELECT *, o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS query_group,
    o_custkey * 10000 + year(o_orderdate) AS cluster_id FROM orders),
e AS (SELECT DISTINCT a.query_group AS u, b.query_group AS v FROM linked a JOIN linked b USING (cluster_id)),
reach AS (SELECT DISTINCT query_group AS u, query_group AS v FROM linked UNION
  SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
comp AS (SELECT u AS query_group, min(v) AS component FROM reach GROUP BY ALL)"""


@register("WITH " + GRAPH_SQL + " SELECT o_orderkey, component AS split_component FROM linked JOIN comp USING (query_group)")
def split_component(spark, folder):
    """Connected components of the cluster-group graph, labelled by their smallest group."""
    out = split.split_component(linked_orders(spark, folder))
    return out.select("o_orderkey", "split_component")


def _folds(spark, folder):
    return split.assign_folds(linked_orders(spark, folder))


_SIZE_BAND = ("CASE WHEN rows <= 10 THEN '<10' WHEN rows <= 30 THEN '10-30' WHEN rows <= 100 THEN '30-100' "
              "WHEN rows <= 400 THEN '100-400' ELSE '400+' END")
#: Folds dealt to and fro within each component's main stratum, from a drawn start.
FOLDS_SQL = GRAPH_SQL + f""",
g AS (SELECT query_group, component, count(*) AS rows, min(o_orderstatus) AS city
  FROM linked JOIN comp USING (query_group) GROUP BY ALL),
c AS (SELECT component, city || '|' || {_SIZE_BAND} AS cell, count(*) AS gg, sum(rows) AS r FROM g GROUP BY ALL),
s AS (SELECT component, r, cell FROM (SELECT component, cell, sum(r) OVER (PARTITION BY component) AS r,
    row_number() OVER (PARTITION BY component ORDER BY gg DESC, cell DESC) AS rn FROM c) WHERE rn = 1),
t AS (SELECT component, cell, row_number() OVER (PARTITION BY cell ORDER BY r DESC,
    {draws_sql("0", "component")}, component) - 1 AS turn FROM s),
chosen AS (SELECT component, ((CASE WHEN (turn // 5) % 2 = 1 THEN 4 - turn % 5 ELSE turn % 5 END)
    + {draws_sql("0", "'start'", "cell")} % 5) % 5 AS fold FROM t)"""


@register("WITH " + FOLDS_SQL + """,
sized AS (SELECT fold, query_group, component, rows FROM g JOIN chosen USING (component)),
held AS (SELECT fold, count(DISTINCT cluster_id) AS clusters FROM linked JOIN sized USING (query_group) GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, CAST(sum(rows) AS BIGINT) AS rows, """
          + r_sql("sum(rows) / (SELECT sum(rows) FROM g)") + """ AS row_share, count(*) AS groups,
  count(DISTINCT component) AS components, any_value(clusters) AS clusters, """
          + r_sql("quantile_cont(rows, 0.5)") + """ AS median_group_size
FROM sized JOIN held USING (fold) GROUP BY fold""")
def assigned_folds(spark, folder):
    """Fold report: rows, groups, components, clusters per fold."""
    return rounded(_folds(spark, folder)[1], "row_share", "median_group_size")


@register("WITH " + FOLDS_SQL + """,
placed AS (SELECT query_group, cluster_id, fold FROM linked JOIN comp USING (query_group) JOIN chosen USING (component))
SELECT 'cluster_id' AS unit, count(*) FILTER (n > 1) AS spanning FROM (
  SELECT count(DISTINCT fold) AS n FROM placed GROUP BY cluster_id)
UNION ALL SELECT 'query_group', count(*) FILTER (n > 1) FROM (
  SELECT count(DISTINCT fold) AS n FROM placed GROUP BY query_group)""")
def fold_leakage(spark, folder):
    """No cluster and no group may span two folds."""
    folded, _ = _folds(spark, folder)
    return split.leaked_units(folded, "fold", ["cluster_id", "query_group"])


_BAND = ("CASE WHEN n <= 10 THEN '<10' WHEN n <= 30 THEN '10-30' WHEN n <= 100 THEN '30-100' "
         "WHEN n <= 400 THEN '100-400' ELSE '400+' END")


@register(f"""
SELECT l_suppkey, count(*) AS rows, {_BAND} AS group_size_band FROM (SELECT *, count(*) OVER (
  PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY ALL""")
def group_size_bands_split(spark, folder):
    """The split's own group-size bands."""
    assert len(GROUP_SIZE_LABELS) == 5
    out = split.group_size_band(table(spark, folder, "lineitem"), "l_suppkey")
    return out.groupBy("l_suppkey", "group_size_band").agg(F.count(F.lit(1)).alias("rows"))


FOLDED = "folded AS (SELECT *, l_suppkey % 5 AS fold FROM graded)"


def _folded(spark, folder, *extra):
    return graded_lines(spark, folder, *extra).withColumn("fold", F.col("l_suppkey") % 5)


@register("WITH" + GRADED_SQL + "," + FOLDED + """
SELECT fold, grade, count(*) AS n, """ + r_sql("count(*) / sum(count(*)) OVER (PARTITION BY fold)") + """ AS share
FROM folded GROUP BY fold, grade""")
def fold_balance(spark, folder):
    """Grade shares per fold, reported and never optimised."""
    return rounded(split.fold_balance(_folded(spark, folder), "fold", "grade"), "share")


@register("""
WITH g AS (SELECT o_custkey, min(o_custkey % 5) AS fold, min(o_orderstatus) AS city FROM orders GROUP BY ALL)
SELECT fold, city, count(*) AS n, """ + r_sql("count(*) / sum(count(*)) OVER (PARTITION BY fold)") + """ AS share
FROM g GROUP BY fold, city""")
def fold_balance_by_group(spark, folder):
    """The same counted in groups."""
    orders = table(spark, folder, "orders").withColumns(
        {"fold": F.col("o_custkey") % 5, "city": F.col("o_orderstatus")}
    )
    return rounded(split.fold_balance(orders, "fold", "city", "o_custkey"), "share")


@register("WITH" + GRADED_SQL + """
SELECT l_orderkey, min(grade) = max(grade) AS constant_grade FROM graded GROUP BY ALL""")
def constant_grade_groups(spark, folder):
    """Groups any order of which scores the same."""
    return split.constant_grade_groups(graded_lines(spark, folder), ["l_orderkey"], "grade")


@register("WITH" + GRADED_SQL + "," + FOLDED + """
SELECT held, CASE WHEN fold = held THEN 'validation' ELSE 'train' END AS role, count(*) AS rows
FROM folded CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS held) WHERE fold <> 0 GROUP BY ALL""")
def cross_validation_roles(spark, folder):
    """Development rows per held fold and role; the sealed fold appears in none."""
    roles = split.cv_roles(_folded(spark, folder), "fold")
    return roles.groupBy("held", "role").agg(F.count(F.lit(1)).alias("rows"))


@register("WITH" + GRADED_SQL + "," + FOLDED + "SELECT l_suppkey, count(*) AS rows FROM folded WHERE fold = 0 GROUP BY ALL")
def sealed_rows(spark, folder):
    """The held-out fold."""
    sealed = split.sealed_rows(_folded(spark, folder), "fold")
    return sealed.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"))


# Places are months, cities return flags; a place is covered when sealed suppliers shipped then.
PLACES = """placed AS (SELECT *, l_suppkey % 5 AS fold, strftime(l_shipdate, '%Y-%m-%d') AS place FROM lineitem)"""


def _placed(spark, folder):
    return table(spark, folder, "lineitem").withColumns(
        {
            "fold": F.col("l_suppkey") % 5,
            "place": F.date_format("l_shipdate", "yyyy-MM-dd"),
        }
    )


@register("WITH " + PLACES + """
SELECT l_returnflag, place, count(*) AS rows, count(*) FILTER (fold = 0) AS sealed_rows,
  """ + r_sql("count(*) FILTER (fold = 0) / count(*)") + " AS sealed_share FROM placed GROUP BY ALL")
def geography_coverage(spark, folder):
    """How much of each place the sealed fold holds."""
    out = split.geography_coverage(_placed(spark, folder), "fold", "l_returnflag", "place")
    return rounded(out, "sealed_share")


@register("WITH " + PLACES + """,
a AS (SELECT l_returnflag, place FROM placed GROUP BY ALL HAVING count(*) FILTER (fold = 0) = 0)
SELECT l_orderkey, avg(CAST(a.place IS NOT NULL AS INT)) > 0.5 AS unrepresented
FROM placed LEFT JOIN a USING (l_returnflag, place) GROUP BY ALL""")
def unrepresented_groups(spark, folder):
    """Groups mostly in places the sealed fold never sees."""
    return split.unrepresented_groups(
        _placed(spark, folder), "fold", ["l_orderkey"], "l_returnflag", "place"
    )


@register("WITH " + GRAPH_SQL + """
SELECT component, count(DISTINCT query_group) AS groups, count(DISTINCT cluster_id) AS clusters, count(*) AS rows
FROM linked JOIN comp USING (query_group) GROUP BY ALL""")
def component_summary(spark, folder):
    """Groups, clusters and rows per component."""
    out = split.split_component(linked_orders(spark, folder), name="component")
    units = out.groupBy("component", "query_group", "cluster_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return units.groupBy("component").agg(
        F.countDistinct("query_group").alias("groups"),
        F.countDistinct("cluster_id").alias("clusters"),
        F.sum("_n").alias("rows"),
    )


@register("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL""")
def fold_crosstab(spark, folder):
    """Counts of a cross tabulation in long form."""
    wide = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", "l_linenumber")
        .pivot("l_linestatus", ["F", "O"])
        .count()
    )
    return wide.unpivot(
        ["l_returnflag", "l_linenumber"], ["F", "O"], "l_linestatus", "n"
    ).filter("n IS NOT NULL")


