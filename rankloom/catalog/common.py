"""Shared pieces of the registered queries: table access, rounding, and SQL fragments.

Registered queries run the operators on the driver's tables; the SQL beside each says the same
thing independently, for the correctness check. Floats are rounded on both sides because the two
engines add numbers up in different orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import session

#: Total order over lineitem rows (its natural key repeats).
TIES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_shipdate"]
TIES_SQL = ", ".join(TIES)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def rnd(column: Column | str, places: int = 6) -> Column:
    """Rounded, without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: rnd(n, places) for n in names})


def r_sql(expression: str, places: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0.0)"


def graded_lines(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """lineitem with grade 0-4 of its discount (zero atom, quartiles per return flag)."""
    from rankloom.operators import label

    lines = table(spark, folder, "lineitem")
    graded, _ = label.assign_grades(
        lines, "l_discount", ["l_returnflag", "l_linestatus"], ["l_returnflag"]
    )
    narrow = graded.select(*dict.fromkeys([*TIES, "l_returnflag", "grade", *extra]))
    # Several operators read these rows: write them once, over evenly sized files.
    return session.stage(narrow.hint("rebalance"))


#: The same grades in SQL, as a CTE named ``graded``.
GRADED_SQL = """
cells AS (SELECT l_returnflag, l_linestatus,
    quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.5) AS q2,
    quantile_cont(l_discount, 0.75) AS q3
  FROM lineitem WHERE l_discount <> 0 GROUP BY ALL),
graded AS (SELECT l.*, CAST(CASE WHEN l_discount = 0 THEN 0 ELSE
    1 + CAST(l_discount > q1 AS INT) + CAST(l_discount > q2 AS INT) + CAST(l_discount > q3 AS INT)
    END AS INT) AS grade
  FROM lineitem l JOIN cells USING (l_returnflag, l_linestatus))"""


def ndcg_sql(source: str, group: str, grade: str, score: str, ties: str, k: int = 10,
             name: str = "ndcg", gain: str = "(pow(2, {g}) - 1)", prefix: str = "n") -> str:
    """CTEs ``<prefix>_ranked`` and ``<prefix>_ndcg(group, size, name, relevant, recall)``."""
    g = gain.format(g=grade)
    return f"""
{prefix}_ranked AS (SELECT {group}, {grade}, {g} AS gain,
    row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC NULLS LAST, {ties}) AS sr,
    row_number() OVER (PARTITION BY {group} ORDER BY {grade} DESC) AS ir FROM {source}),
{prefix}_ndcg AS (SELECT {group}, count(*) AS size,
    CASE WHEN min({grade}) = max({grade}) THEN NULL ELSE
      sum(CASE WHEN sr <= {k} THEN gain / log2(sr + 1) ELSE 0 END)
      / nullif(sum(CASE WHEN ir <= {k} THEN gain / log2(ir + 1) ELSE 0 END), 0) END AS {name},
    CAST(count(*) FILTER ({grade} >= 3 AND sr <= {k}) AS DOUBLE)
      / nullif(count(*) FILTER ({grade} >= 3), 0) AS recall
  FROM {prefix}_ranked GROUP BY {group})"""


def draws_sql(*parts: str) -> str:
    """The 60-bit draw number in SQL."""
    joined = ", ".join(parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', {joined})), 1, 15) AS BIGINT)"


def bootstrap_sql(source: str, by: str, value: str, order: str, iterations: int, seed: int = 0,
                  prefix: str = "b") -> str:
    """CTE ``<prefix>_ci(by, value, value_low, value_high)`` over non-null values of ``source``."""
    sep = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by}, slot)" if by else "USING (slot)"
    group = f"GROUP BY {by}" if by else ""
    both = f"USING ({by})" if by else "ON true"
    return f"""
{prefix}_num AS (SELECT {sep}{value}, row_number() OVER ({part} ORDER BY {order}) - 1 AS slot,
    count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL),
{prefix}_draw AS (SELECT {sep}d.draw,
    {draws_sql(str(seed), 'd.draw', 'slot')} % n AS slot
  FROM {prefix}_num CROSS JOIN (SELECT unnest(range(0, {iterations})) AS draw) d),
{prefix}_mean AS (SELECT {sep}draw, avg({value}) AS m FROM {prefix}_draw
  JOIN (SELECT {sep}slot, {value} FROM {prefix}_num) v {using} GROUP BY {sep}draw),
{prefix}_ci AS (SELECT * FROM (SELECT {sep}avg({value}) AS {value} FROM {source} {group})
  LEFT JOIN (SELECT {sep}quantile_cont(m, 0.025) AS {value}_low,
    quantile_cont(m, 0.975) AS {value}_high FROM {prefix}_mean {group}) {both})"""
