"""Labels, cascades and feature blocks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.common import r_sql, rnd, rounded, table
from rankloom.functions import parsing
from rankloom.functions.hashing import draw_number
from rankloom.operators import (
    amenities,
    cascade,
    filters,
    label,
    neighbourhood,
    ordering,
    reviews,
    sentiment,
    spatial,
)

QUERIES, SQL = {}, {}


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def user_calendar(spark, folder):
    """One row per user and day of the whole span: open when the user bought nothing that day."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type")
    bought = F.max((F.col("event_type") == "purchase").cast("int"))
    active = events.groupBy("user_id", F.to_date("ts").alias("date")).agg(bought.alias("_bought"))
    spans = active.groupBy("user_id").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = spans.select("user_id", F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.join(active, ["user_id", "date"], "left").select(
        "user_id", "date", (F.coalesce("_bought", F.lit(0)) == 0).alias("available")
    )


CALENDAR_SQL = """
active AS (SELECT user_id, CAST(ts AS DATE) AS date, max(CAST(event_type = 'purchase' AS INT)) AS b
  FROM events GROUP BY ALL),
days AS (SELECT user_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT user_id, min(date) AS a, max(date) AS z FROM active GROUP BY ALL)),
calendar AS (SELECT user_id, date, coalesce(b, 0) = 0 AS available
  FROM days LEFT JOIN active USING (user_id, date)),
anchored AS (SELECT *, min(date) OVER (PARTITION BY user_id) AS t FROM calendar),
labels AS (SELECT user_id, min(t) AS "T", count(*) AS calendar_days,
    CAST(max(date) - min(date) + 1 AS INT) AS calendar_span,
    CAST(count(*) FILTER (date < t + 14 AND available) AS BIGINT) AS avail_14,
    1 - avg(CAST(available AS INT)) AS blocked_fraction_calendar
  FROM anchored GROUP BY user_id)"""


@register("WITH " + CALENDAR_SQL + """
SELECT user_id, "T", calendar_days, calendar_span, avail_14,
  """ + r_sql("1 - avail_14 / 14.0") + """ AS blocked_fraction_14,
  """ + r_sql("blocked_fraction_calendar") + """ AS blocked_fraction_calendar FROM labels""")
def occupancy_label(spark, folder):
    """Blocked share of the first 14 days of each user's own calendar."""
    labels = label.occupancy_label(
        user_calendar(spark, folder), "user_id", "date", "available", window_days=14
    )
    return rounded(labels, "blocked_fraction_14", "blocked_fraction_calendar")


@register("WITH " + CALENDAR_SQL + """,
shipped AS (SELECT user_id, user_id % 3 AS market, 14 - count(DISTINCT CAST(ts AS DATE)) AS shipped
  FROM events JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS t FROM events GROUP BY ALL) USING (user_id)
  WHERE event_type = 'purchase' AND CAST(ts AS DATE) < t + 14 AND hour(ts) < 22 GROUP BY ALL)
SELECT market, count(*) AS n, """ + r_sql("avg(CAST(avail_14 = shipped AS INT))") + """ AS exact_agreement,
  count(*) FILTER (avail_14 <> shipped) AS n_mismatched,
  """ + r_sql("avg(abs(avail_14 - shipped))") + """ AS mean_abs_diff
FROM labels JOIN shipped USING (user_id) GROUP BY ALL""")
def availability_crosscheck(spark, folder):
    """Derived availability against an independent count that misses the late evening."""
    events = table(spark, folder, "events", "user_id", "ts", "event_type").withColumn(
        "day", F.to_date("ts")
    )
    labels = label.occupancy_label(user_calendar(spark, folder), "user_id", window_days=14)
    anchored = ordering.attach(events, label.anchors(events, "user_id", "day"), ["user_id"])
    early = anchored.filter(
        (F.col("event_type") == "purchase")
        & (F.col("day") < F.date_add("T", 14))
        & (F.hour("ts") < 22)
    )
    shipped = early.groupBy("user_id").agg(
        (14 - F.countDistinct("day")).alias("shipped")
    ).withColumn("market", F.col("user_id") % 3)
    out = label.crosscheck_availability(
        labels, shipped, "user_id", "user_id", ["market"], "avail_14", "shipped"
    )
    return rounded(out, "exact_agreement", "mean_abs_diff")


#: Customers graded on their positive balance; small cells fall back to the whole segment.
CUSTOMER_GRADES_SQL = """
base AS (SELECT *, greatest(c_acctbal, 0.0) / 10000.0 AS label FROM customer),
own AS (SELECT c_mktsegment, c_nationkey, count(*) AS above, quantile_cont(label, 0) AS q0,
    quantile_cont(label, 0.25) AS q1, quantile_cont(label, 0.5) AS q2,
    quantile_cont(label, 0.75) AS q3, quantile_cont(label, 1) AS q4
  FROM base WHERE label <> 0 GROUP BY ALL),
pool AS (SELECT c_mktsegment, quantile_cont(label, 0.25) AS p1, quantile_cont(label, 0.5) AS p2,
    quantile_cont(label, 0.75) AS p3 FROM base WHERE label <> 0 GROUP BY ALL),
cell AS (SELECT c_mktsegment, c_nationkey, n, coalesce(above, 0) AS above_atom,
    CASE WHEN coalesce(above, 0) = 0 THEN 'empty'
      WHEN above >= 30 AND q0 < q1 AND q1 < q2 AND q2 < q3 AND q3 < q4 THEN 'partition'
      ELSE 'fallback' END AS level, q1, q2, q3, p1, p2, p3
  FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM base GROUP BY ALL)
  LEFT JOIN own USING (c_mktsegment, c_nationkey) LEFT JOIN pool USING (c_mktsegment)),
customer_grades AS (SELECT b.*, level, CAST(CASE WHEN label = 0 THEN 0
    WHEN level = 'partition' THEN 1 + CAST(label > q1 AS INT) + CAST(label > q2 AS INT)
      + CAST(label > q3 AS INT)
    ELSE 1 + CAST(label > p1 AS INT) + CAST(label > p2 AS INT) + CAST(label > p3 AS INT)
    END AS INT) AS grade FROM base b JOIN cell USING (c_mktsegment, c_nationkey))"""


def customer_grades(spark, folder):
    """``(graded customers, report)``."""
    base = table(spark, folder, "customer").withColumn(
        "label", F.greatest("c_acctbal", F.lit(0.0)) / F.lit(10_000.0)
    )
    return label.assign_grades(
        base, "label", ["c_mktsegment", "c_nationkey"], ["c_mktsegment"]
    )


@register("WITH " + CUSTOMER_GRADES_SQL + " SELECT c_custkey, grade FROM customer_grades")
def assigned_grades(spark, folder):
    """Grades 0-4 with the pool fallback."""
    return customer_grades(spark, folder)[0].select("c_custkey", "grade")


@register("WITH " + CUSTOMER_GRADES_SQL + """
SELECT c_mktsegment, c_nationkey, n, above_atom, level FROM cell""")
def grading_report(spark, folder):
    """Which cells cut their own quartiles and which borrowed the pool's."""
    return customer_grades(spark, folder)[1]


RUNGS = (
    ("nation_segment", ("c_mktsegment", "c_nationkey")),
    ("segment", ("c_mktsegment",)),
    ("all", ("planet",)),
)


def _with_gaps(spark, folder):
    """Customers whose balance is missing where it was negative, and in one whole nation."""
    gone = (F.col("c_acctbal") < 0) | (F.col("c_nationkey") == 3)
    return table(spark, folder, "customer").withColumns(
        {"price": F.when(~gone, F.col("c_acctbal")), "planet": F.lit("earth")}
    )


GAPS_SQL = """
gaps AS (SELECT *, CASE WHEN NOT (c_acctbal < 0 OR c_nationkey = 3) THEN c_acctbal END AS price
  FROM customer),
filled AS (SELECT *, median(price) OVER (PARTITION BY c_mktsegment, c_nationkey) AS m0,
    median(price) OVER (PARTITION BY c_mktsegment) AS m1, median(price) OVER () AS m2 FROM gaps)"""


@register("WITH " + GAPS_SQL + """
SELECT c_custkey, """ + r_sql("coalesce(price, m0, m1, m2)", 4) + " AS price FROM filled")
def imputed_prices(spark, folder):
    """Missing values filled from the first rung that has a median."""
    filled, _ = cascade.impute_price(_with_gaps(spark, folder), RUNGS, "price", ["c_mktsegment"])
    return filled.select("c_custkey", rnd("price", 4).alias("price"))


@register("WITH " + GAPS_SQL + """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (price IS NULL) AS missing,
  count(*) FILTER (price IS NULL AND m0 IS NOT NULL) AS filled_nation_segment,
  count(*) FILTER (price IS NULL AND m0 IS NULL AND m1 IS NOT NULL) AS filled_segment,
  count(*) FILTER (price IS NULL AND m0 IS NULL AND m1 IS NULL AND m2 IS NOT NULL) AS filled_all
FROM filled GROUP BY ALL""")
def imputation_report(spark, folder):
    """Rows filled per rung."""
    return cascade.impute_price(_with_gaps(spark, folder), RUNGS, "price", ["c_mktsegment"])[1]


PART_CASCADE = (
    ("type_brand_tier", ("p_type", "p_brand", "tier")),
    ("type_tier", ("p_type", "tier")),
    ("type", ("p_type",)),
)


def tiered_parts(spark, folder):
    from rankloom.functions.bins import capacity_tier

    return table(spark, folder, "part").withColumn("tier", capacity_tier(F.col("p_size")))


PART_GROUPS_SQL = """
tiered AS (SELECT *, CASE WHEN p_size <= 2 THEN '1-2' WHEN p_size <= 4 THEN '3-4'
    WHEN p_size <= 7 THEN '5-7' ELSE '8+' END AS tier FROM part),
g0 AS (SELECT *, count(*) OVER (PARTITION BY p_type, p_brand, tier) AS n0 FROM tiered),
g1 AS (SELECT *, count(*) OVER (PARTITION BY p_type, tier, n0 >= 5) AS n1 FROM g0),
part_groups AS (SELECT *, CASE WHEN n0 >= 5 THEN 'type_brand_tier' WHEN n1 >= 5 THEN 'type_tier'
      ELSE 'type' END AS rung,
    CASE WHEN n0 >= 5 THEN p_type || '|' || p_brand || '|' || tier WHEN n1 >= 5
      THEN p_type || '|' || tier ELSE p_type END AS group_key FROM g1)"""


@register("WITH " + PART_GROUPS_SQL + """
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY rung, group_key) AS first_member,
  count(*) OVER (PARTITION BY rung, group_key) AS members FROM part_groups""")
def query_groups(spark, folder):
    """Groups with fallback, described by their first member and size (ids are arbitrary)."""
    grouped, _ = cascade.query_group(
        tiered_parts(spark, folder), PART_CASCADE, partition=("p_type",)
    )
    out = ordering.with_group_stats(
        grouped, ["query_group"],
        [F.min("p_partkey").alias("first_member"), F.count(F.lit(1)).alias("members")],
    )
    return out.select("p_partkey", "first_member", "members")


@register("WITH " + PART_GROUPS_SQL + """, sizes AS (SELECT rung, group_key, count(*) AS size
  FROM part_groups GROUP BY ALL)
SELECT rung, CASE rung WHEN 'type_brand_tier' THEN 'p_type x p_brand x tier'
    WHEN 'type_tier' THEN 'p_type x tier' ELSE 'p_type' END AS key,
  CAST(sum(size) AS BIGINT) AS n, count(*) AS groups, count(*) FILTER (size = 1) AS singletons,
  count(*) FILTER (size < 5) AS under_minimum, """ + r_sql("median(size)") + """ AS median_size
FROM sizes GROUP BY ALL""")
def query_group_report(spark, folder):
    """Groups settled per rung."""
    _, report = cascade.query_group(
        tiered_parts(spark, folder), PART_CASCADE, partition=("p_type",)
    )
    return rounded(report, "median_size")


@register("""
SELECT o_orderkey, count(*) OVER w AS cluster_size, min(o_orderkey) OVER w AS first_member
FROM (SELECT *, round(37.0 + ((o_custkey * 7919) % 10000) / 20000.0, 4) AS la,
    round(23.0 + ((o_custkey * 104729) % 10000) / 20000.0, 4) AS lo FROM orders)
WINDOW w AS (PARTITION BY o_orderpriority, o_custkey, o_orderstatus)""")
def near_twin_clusters(spark, folder):
    """Orders of one customer point, priority and status, as near-twin clusters."""
    orders = table(spark, folder, "orders").withColumns(
        spatial.point_columns(F.col("o_custkey"))
    ).withColumn("host", F.concat_ws("|", "o_orderpriority", "o_custkey"))
    out = cascade.cluster_id(
        orders, "host", "latitude", "longitude", "o_orderstatus", size="cluster_size"
    )
    out = ordering.with_group_stats(
        out, ["cluster_id"], [F.min("o_orderkey").alias("first_member")]
    )
    return out.select("o_orderkey", "cluster_size", "first_member")


@register("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rk,
    count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
v AS (SELECT l_suppkey, list(l_extendedprice ORDER BY l_extendedprice) AS vs FROM lineitem
  GROUP BY ALL)
SELECT n.l_suppkey, l_extendedprice, n.n - 1 AS others,
  """ + r_sql("""CASE WHEN n.n < 2 THEN NULL ELSE
   (vs[CAST((n.n - 2) // 2 AS INT) + 1 + CAST(rk <= (n.n - 2) // 2 + 1 AS INT)]
  + vs[CAST((n.n - 1) // 2 AS INT) + 1 + CAST(rk <= (n.n - 1) // 2 + 1 AS INT)]) / 2 END""", 4) + """ AS loo_median
FROM n JOIN v USING (l_suppkey)""")
def leave_one_out_median(spark, folder):
    """Median price of the other lines of the supplier."""
    out = neighbourhood.leave_one_out_median(
        table(spark, folder, "lineitem", "l_suppkey", "l_extendedprice"),
        ["l_suppkey"], "l_extendedprice", count="others",
    )
    return rounded(out, "loo_median", places=4)


@register("""
SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) - 1 AS others FROM lineitem""")
def leave_one_out_count(spark, folder):
    """Other lines of the same order."""
    return neighbourhood.leave_one_out_count(
        table(spark, folder, "lineitem", "l_orderkey", "l_partkey"), ["l_orderkey"]
    )


@register("""
WITH b AS (SELECT *, list(p_retailprice) OVER (PARTITION BY p_type, p_brand) AS vs,
    count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part),
m AS (SELECT p_partkey, p_retailprice, n, CASE WHEN n > 1 THEN (SELECT median(x) FROM (
    SELECT unnest(list_sort(vs)) AS x, unnest(range(1, n + 1)) AS i) WHERE i <> list_position(
    list_sort(vs), p_retailprice)) END AS med FROM b)
SELECT p_partkey, n - 1 AS nbhd_listings, """ + r_sql("med", 4) + """ AS nbhd_median_price,
  """ + r_sql("p_retailprice / med") + """ AS price_vs_nbhd FROM m""")
def neighbourhood_features(spark, folder):
    """Leave-one-out count, median and relative price."""
    out = neighbourhood.neighbourhood_features(
        table(spark, folder, "part"), ["p_type", "p_brand"], "p_retailprice"
    )
    out = rounded(rounded(out, "price_vs_nbhd"), "nbhd_median_price", places=4)
    return out.select("p_partkey", "nbhd_listings", "nbhd_median_price", "price_vs_nbhd")


POINTS_SQL = """
pts AS (SELECT c_custkey, c_mktsegment, 37.0 + ((c_custkey * 7919) % 10000) / 20000.0 AS lat,
  23.0 + ((c_custkey * 104729) % 10000) / 20000.0 AS lon FROM customer)"""
HAVERSINE = """2 * 6371.0088 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2)
  + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"""


def customer_points(spark, folder):
    return table(spark, folder, "customer", "c_custkey", "c_mktsegment").withColumns(
        spatial.point_columns(F.col("c_custkey"))
    )


MARKET_ANCHORS = {
    "AUTOMOBILE": [("a", 37.1, 23.1)],
    "BUILDING": [("b", 37.2, 23.2), ("c", 37.4, 23.4)],
    "FURNITURE": [("d", 37.3, 23.1)],
    "HOUSEHOLD": [("e", 37.4, 23.3)],
    "MACHINERY": [("f", 37.1, 23.4), ("g", 37.3, 23.3), ("h", 37.45, 23.05)],
}
ANCHOR_ROWS = ", ".join(
    f"('{m}', {a}, {b})" for m, points in MARKET_ANCHORS.items() for _, a, b in points
)


@register("WITH " + POINTS_SQL + f""", anchors(m, alat, alon) AS (VALUES {ANCHOR_ROWS})
SELECT c_custkey, round(min({HAVERSINE.format(a='lat', b='alat', c='lon', d='alon')}), 2) AS km
FROM pts JOIN anchors ON c_mktsegment = m GROUP BY ALL""")
def nearest_anchor(spark, folder):
    """Distance to the market's nearest anchor."""
    out = spatial.nearest_anchor(
        customer_points(spark, folder), MARKET_ANCHORS, "c_mktsegment", name="km"
    )
    return out.select("c_custkey", "km")


@register("WITH " + POINTS_SQL + f"""
SELECT c_custkey, round(min({HAVERSINE.format(a='lat', b='slat', c='lon', d='slon')}), 2) AS km
FROM (SELECT p.*, c_nationkey FROM pts p JOIN customer USING (c_custkey)) LEFT JOIN (SELECT s_nationkey,
    37.0 + ((s_suppkey * 7919) % 10000) / 20000.0 AS slat,
    23.0 + ((s_suppkey * 104729) % 10000) / 20000.0 AS slon FROM supplier)
  ON c_nationkey = s_nationkey GROUP BY ALL""")
def nearest_supplier(spark, folder):
    """Anchors held in a table: the nearest supplier of the customer's nation, null where it has none."""
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey").withColumns(
        spatial.point_columns(F.col("c_custkey"))
    )
    suppliers = table(spark, folder, "supplier", "s_suppkey", "s_nationkey").withColumns(
        spatial.point_columns(F.col("s_suppkey"))
    )
    out = spatial.nearest_of_table(
        customers, suppliers, "c_nationkey", "s_nationkey", "latitude", "longitude", "latitude", "longitude", "km",
    )
    return out.select("c_custkey", "km")


_OTHERS = "CASE WHEN n > 1 THEN (s{x} - {x}) / (n - 1) END"


@register("WITH " + POINTS_SQL + """, s AS (SELECT *, sum(lat) OVER w AS slat, sum(lon) OVER w AS slon,
    count(*) OVER w AS n FROM (SELECT pts.*, c_nationkey FROM pts JOIN customer USING (c_custkey))
  WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey)),
c AS (SELECT c_custkey, lat, lon, """ + _OTHERS.format(x="lat") + " AS clat, "
          + _OTHERS.format(x="lon") + """ AS clon FROM s)
SELECT c_custkey, """ + r_sql(HAVERSINE.format(a="lat", b="clat", c="lon", d="clon"), 5) + " AS km FROM c")
def centroid_distance(spark, folder):
    """Distance to the centroid of the other members of the cell."""
    customers = table(spark, folder, "customer").withColumns(
        spatial.point_columns(F.col("c_custkey"))
    )
    out = spatial.centroid_distance(
        customers, ["c_mktsegment", "c_nationkey"], name="km", places=None
    )
    return out.select("c_custkey", rnd("km", 5).alias("km"))


@register("""
WITH pts AS (SELECT o_orderkey, o_orderpriority AS m,
    37.0 + ((o_custkey * 7919) % 10000) / 20000.0 AS lat,
    23.0 + ((o_custkey * 104729) % 10000) / 20000.0 AS lon FROM orders),
xy AS (SELECT o_orderkey, m, radians(lon) * 6371.0088 * cos(radians(avg(lat) OVER (PARTITION BY m))) AS x,
    radians(lat) * 6371.0088 AS y FROM pts)
SELECT a.o_orderkey, count(*) - 1 AS density_1km FROM xy a JOIN xy b ON a.m = b.m
  AND b.x BETWEEN a.x - 1.01 AND a.x + 1.01 AND b.y BETWEEN a.y - 1.01 AND a.y + 1.01
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.0 GROUP BY ALL""")
def local_density(spark, folder):
    """Other orders of the same priority within one kilometre of the customer's point."""
    placed = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority").withColumns(
        spatial.point_columns(F.col("o_custkey"))
    )
    out = spatial.density(placed, "o_orderpriority")
    return out.select("o_orderkey", "density_1km")


@register("WITH " + POINTS_SQL + """
SELECT c_mktsegment, """ + r_sql("(max(lat) - min(lat)) * 111.0") + " AS lat_km, "
          + r_sql("(max(lon) - min(lon)) * 111.0 * cos(radians(avg(lat)))") + """ AS lon_km
FROM pts GROUP BY ALL""")
def market_extent(spark, folder):
    """Size of each market in km."""
    out = spatial.market_extent(customer_points(spark, folder), "c_mktsegment")
    return rounded(out, "lat_km", "lon_km")


def customer_anchors(spark, folder):
    """A per-customer anchor date inside the order history."""
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int"))
    return table(spark, folder, "customer", "c_custkey").select("c_custkey", day.alias("T"))


ANCHOR_SQL = "anchors AS (SELECT c_custkey, DATE '1998-01-01' + CAST(c_custkey % 900 AS INT) AS t FROM customer)"


@register("WITH " + ANCHOR_SQL + """
SELECT c_custkey, count(o_orderkey) AS reviews_same_season_ly FROM anchors LEFT JOIN orders
  ON o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= t - 365
  AND CAST(o_orderdate AS DATE) < t - 275 GROUP BY ALL""")
def same_season_reviews(spark, folder):
    """Orders in the season one year before each customer's anchor; zero where none."""
    out = reviews.same_season_last_year(
        table(spark, folder, "orders"), customer_anchors(spark, folder),
        event_key="o_custkey", event_date="o_orderdate", anchor_key="c_custkey",
    )
    return out.select("c_custkey", "reviews_same_season_ly")


@register("WITH " + ANCHOR_SQL + """
SELECT c_custkey,
  count(o_orderkey) FILTER (d >= t - 30 AND d < t) AS trailing_30,
  count(o_orderkey) FILTER (d >= t - 90 AND d < t) AS trailing_90,
  count(o_orderkey) FILTER (d >= t - 365 AND d < t) AS trailing_365,
  count(o_orderkey) FILTER (d >= t - 365 AND d < t - 365 + 180) AS season_180
FROM anchors LEFT JOIN (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) ON o_custkey = c_custkey
GROUP BY ALL""")
def review_windows(spark, folder):
    """Several windows from one join."""
    out = reviews.events_in_windows(
        table(spark, folder, "orders"), customer_anchors(spark, folder), "o_custkey",
        "o_orderdate", "c_custkey", "T",
        {
            "trailing_30": (30, 30),
            "trailing_90": (90, 90),
            "trailing_365": (365, 365),
            "season_180": (365, 180),
        },
    )
    return out.drop("T")


@register("""
WITH b AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size > 5 THEN p_retailprice END AS rating
  FROM part),
t AS (SELECT p_type, sum(rating) AS s, count(rating) AS c FROM b GROUP BY ALL)
SELECT p_partkey, """ + r_sql("""(CASE WHEN rating IS NULL THEN 0 ELSE p_size END * coalesce(rating, 0)
  + 20 * (s - coalesce(rating, 0)) / nullif(c - CAST(rating IS NOT NULL AS INT), 0))
  / (CASE WHEN rating IS NULL THEN 0 ELSE p_size END + 20)""", 5) + """ AS rating_shrunk
FROM b JOIN t USING (p_type)""")
def shrunk_ratings(spark, folder):
    """Ratings pulled toward the leave-one-out market mean by their evidence."""
    parts = table(spark, folder, "part").withColumn(
        "rating", F.when(F.col("p_size") > 5, F.col("p_retailprice"))
    )
    out = reviews.rating_shrunk(parts, "p_type", "p_size", "rating")
    return out.select("p_partkey", rnd("rating_shrunk", 5).alias("rating_shrunk"))


@register("WITH " + ANCHOR_SQL + """
SELECT c_custkey, count(o_orderkey) > 0 AS has_reviews,
  CAST(t - min(CAST(o_orderdate AS DATE)) AS DOUBLE) AS listing_age_days,
  CAST(t - max(CAST(o_orderdate AS DATE)) AS DOUBLE) AS days_since_last_review
FROM anchors LEFT JOIN orders ON o_custkey = c_custkey AND CAST(o_orderdate AS DATE) < t
GROUP BY c_custkey, t""")
def review_ages(spark, folder):
    """Cold-start flag, age since the first and days since the last review."""
    anchors = customer_anchors(spark, folder)
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey"), F.to_date("o_orderdate").alias("d")
    )
    earlier = orders.join(anchors, F.col("o_custkey") == F.col("c_custkey")).filter("d < T")
    facts = earlier.groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last")
    )
    out = anchors.join(facts, "c_custkey", "left")
    return out.select(
        "c_custkey",
        (F.coalesce("n", F.lit(0)) > 0).alias("has_reviews"),
        parsing.days_before(F.col("T"), F.col("first")).alias("listing_age_days"),
        parsing.days_before(F.col("T"), F.col("last")).alias("days_since_last_review"),
    )


def document_items(spark, folder):
    """Documents as lists of words, the item lists the amenity operators work on."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    return table(spark, folder, "documents", "doc_id", "text", "source").select(
        "doc_id", "source", words.alias("items")
    )


WORD_BUCKETS = {
    "tion": ("tion", "ment"), "th": ("th",), "vowels": ("ea", "ou", "au"), "er": ("er", "en"),
}
WORDS_SQL = """
words AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'),
  lambda w: length(w) > 0)) AS item FROM documents)"""
BUCKET_CASE = """CASE WHEN contains(item, 'tion') OR contains(item, 'ment') THEN 'tion'
  WHEN contains(item, 'th') THEN 'th' WHEN contains(item, 'ea') OR contains(item, 'ou')
  OR contains(item, 'au') THEN 'vowels' WHEN contains(item, 'er') OR contains(item, 'en') THEN 'er' END"""


@register("WITH " + WORDS_SQL + f""", b AS (SELECT doc_id, {BUCKET_CASE} AS bucket FROM words
  UNION ALL SELECT doc_id, NULL FROM documents)
SELECT doc_id, count(*) FILTER (bucket = 'tion') AS tion, count(*) FILTER (bucket = 'th') AS th,
  count(*) FILTER (bucket = 'vowels') AS vowels, count(*) FILTER (bucket = 'er') AS er
FROM b GROUP BY ALL""")
def bucket_counts(spark, folder):
    """Mentions per concept bucket, first matching rule wins, repeated mentions counted."""
    docs = document_items(spark, folder)
    rule = amenities.bucket(F.col("item"), WORD_BUCKETS)
    return amenities.bucket_counts(docs, ["doc_id"], "items", rule, list(WORD_BUCKETS))


@register("WITH " + WORDS_SQL + f""", v AS (SELECT item, count(*) AS mentions, {BUCKET_CASE} AS bucket
  FROM words GROUP BY ALL)
SELECT coalesce(bucket, 'unmapped') AS bucket, count(*) AS strings, CAST(sum(mentions) AS BIGINT) AS mentions
FROM v GROUP BY ALL""")
def bucket_coverage(spark, folder):
    """How much of the vocabulary and of the mentions the bucket rules reach."""
    vocab = amenities.vocabulary(document_items(spark, folder), "items")
    mapped = amenities.bucket_map(vocab, WORD_BUCKETS)
    return mapped.groupBy(F.coalesce("bucket", F.lit("unmapped")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("strings"), F.sum("mentions").alias("mentions")
    )


@register()
def canonical_vocabulary(spark, folder):
    """Whole document lines folded to their canonical form (Unicode normalisation has no SQL twin)."""
    lines = table(spark, folder, "documents", "text").select(
        F.explode(F.split("text", "\n")).alias("item")
    )
    vocab = lines.groupBy("item").agg(F.count(F.lit(1)).alias("mentions"))
    return amenities.map_coverage(vocab)


@register("WITH " + WORDS_SQL + """
SELECT item, CAST(count(DISTINCT doc_id) AS BIGINT) AS score FROM words GROUP BY ALL
ORDER BY score DESC, item LIMIT 50""")
def frequency_vocabulary(spark, folder):
    """The 50 items in the most documents (a top-k report)."""
    return amenities.fit_vocabulary(document_items(spark, folder), "items", 50)


@register("WITH " + WORDS_SQL + """,
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT item, source, count(DISTINCT doc_id) AS c FROM words GROUP BY ALL),
s AS (SELECT item, sum(n / (n - 1.0) * (c / n) * (1 - c / n)) / (SELECT count(*) FROM sizes) AS score
  FROM c JOIN sizes USING (source) GROUP BY ALL)
SELECT item, """ + r_sql("score", 5) + """ AS score FROM s ORDER BY s.score DESC, item LIMIT 50""")
def variance_vocabulary(spark, folder):
    """The 50 items whose presence varies most inside groups."""
    out = amenities.fit_vocabulary(
        document_items(spark, folder), "items", 50, "within_group_variance", "source"
    )
    return rounded(out, "score", places=5)


@register("""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'),
  lambda w: length(w) > 0) AS items FROM documents)
SELECT doc_id, CAST(len(items) AS BIGINT) AS amenity_count,
  CAST(list_contains(items, 'the') AS BIGINT) AS amenity_has_the,
  CAST(list_contains(items, 'and') AS BIGINT) AS amenity_has_and FROM d""")
def flag_encoding(spark, folder):
    """One binary per vocabulary item, plus the count every scheme carries."""
    out = amenities.amenity_features(
        document_items(spark, folder), "flags", ["the", "and"], "doc_id", "items"
    )
    return out.drop("items", "source")


@register("""
SELECT p_partkey, trim(regexp_replace(replace(p_type || '/' || p_name, ' ', '_'), '[^a-z0-9]+', '_', 'g'), '_')
  AS slug FROM (SELECT p_partkey, lower(p_type) AS p_type, p_name FROM part)""")
def slugs(spark, folder):
    """Column-safe names."""
    text = F.lower(F.concat("p_type", F.lit("/"), "p_name"))
    return table(spark, folder, "part").select("p_partkey", parsing.slug(text).alias("slug"))


@register("""
WITH r AS (SELECT source, (doc_id * 37 % 101) / 100.0 AS p, (doc_id * 53 % 101) / 200.0 AS n,
    CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS s
  FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS reviews_scored, """ + r_sql("avg(p) - avg(n)") + """ AS sentiment_score,
  """ + r_sql("avg(CAST(s = 'positive' AS INT))") + """ AS positive_share,
  """ + r_sql("avg(p)") + """ AS mean_positive, """ + r_sql("avg(n)") + """ AS mean_negative
FROM r GROUP BY ALL""")
def aggregated_sentiment(spark, folder):
    """Per-source sentiment from scored documents."""
    scored = table(spark, folder, "documents", "doc_id", "source").join(
        table(spark, folder, "labels"), "doc_id"
    )
    verdict = (
        F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative")
        .otherwise("neutral")
    )
    responses = scored.select(
        "source",
        (F.col("doc_id") * 37 % 101 / 100.0).alias("positive"),
        (F.col("doc_id") * 53 % 101 / 200.0).alias("negative"),
        verdict.alias("sentiment"),
    )
    out = sentiment.aggregate_sentiment(responses, ["source"])
    return rounded(out, "sentiment_score", "positive_share", "mean_positive", "mean_negative")


@register("""
SELECT conv_id, turn, CAST(n AS INT) AS piece, md5(substr(text, n * 5120 + 1, 5120)) AS digest
FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 5119) // 5120))) AS n FROM (SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn DESC, text) AS rn FROM conversations
  WHERE text IS NOT NULL AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant'))
WHERE rn <= 2)""")
def latest_documents(spark, folder):
    """The two latest turns of every conversation that holds an answer."""
    turns = table(spark, folder, "conversations")
    chosen = sentiment.select_documents(
        turns, turns.filter("role = 'assistant'"), "conv_id", "text",
        [F.desc("turn"), F.asc("text")], 2,
    )
    return chosen.select("conv_id", "turn", "piece", F.md5("text").alias("digest"))


@register("""
SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 10 + 1 AS batch_id
FROM documents""")
def request_batches(spark, folder):
    """Request-sized batches per language."""
    return sentiment.request_batches(
        table(spark, folder, "documents", "doc_id", "lang"), ["lang"], [F.col("doc_id")]
    )


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, """ + r_sql("""CASE WHEN n > 1 THEN (s - l_tax) / (n - 1)
  END""") + """ AS loo_mean FROM (SELECT *, sum(l_tax) OVER (PARTITION BY l_orderkey) AS s,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)""")
def leave_one_out_mean(spark, folder):
    """Mean of the other rows of the group."""
    out = neighbourhood.leave_one_out_mean(
        table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_tax"),
        ["l_orderkey"], "l_tax",
    )
    return rounded(out, "loo_mean").drop("l_tax")


@register("""
SELECT c_custkey, CAST('0x' || substr(md5(concat_ws(':', 7, c_custkey)), 1, 15) AS BIGINT) AS lot
FROM customer""")
def reproducible_draws(spark, folder):
    """The digest-based random numbers every randomised operator uses."""
    return table(spark, folder, "customer").select(
        "c_custkey", draw_number(F.lit(7), F.col("c_custkey")).alias("lot")
    )


@register("""
SELECT l_linenumber, l_returnflag, """ + r_sql("median(l_extendedprice)", 4) + """ AS median_price
FROM lineitem GROUP BY ALL""")
def stratum_medians(spark, folder):
    """Exact medians per stratum, the reference of the price rule."""
    lines = table(spark, folder, "lineitem", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = ordering.group_median(
        lines, ["l_linenumber", "l_returnflag"], "l_extendedprice", "median_price"
    )
    return rounded(out, "median_price", places=4)


@register("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, median(l_extendedprice) OVER (
  PARTITION BY l_returnflag, l_linenumber) AS m FROM lineitem) WHERE l_extendedprice > 1.8 * m""")
def extreme_prices(spark, folder):
    """Rows far above their stratum's median."""
    priced = filters.with_stratum_median(
        table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linenumber"]
    )
    extreme = filters.is_extreme_price(F.col("l_extendedprice"), F.col("_stratum_median"), 1.8)
    return priced.filter(extreme).select("l_orderkey", "l_linenumber", "l_partkey")
