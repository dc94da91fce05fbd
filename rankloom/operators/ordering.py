"""Positions, running totals, order statistics and joins back to rows that survive a hot group.

``Window.partitionBy(group)`` puts a whole group into one task. That is fine until one group
holds a third of the table. Everything here first measures the largest group:

* below the limit the plain window is used, one shuffle, nothing else;
* above it rows are range-partitioned on (group, order), so Spark's own sampler balances the
  pieces; each piece is numbered locally and shifted by the rows of the pieces before it. At most
  one group per piece continues from the piece before, so the shift table never has more rows than
  there are pieces, which is what makes it safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import session


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two key lists."""
    condition = None
    for a, b in zip(left, right, strict=True):
        equal = a.eqNullSafe(b)
        condition = equal if condition is None else condition & equal
    return F.lit(True) if condition is None else condition


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows in the largest group (all rows when ``group`` is empty)."""
    if not group:
        return df.count()
    top = df.groupBy(*group).count().agg(F.max("count")).first()[0]
    return int(top or 0)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: str | None = None,
    before: str = "before",
    total: str | None = None,
    hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` (row count when ``None``) over the rows strictly before each row.

    ``total`` names an optional column with the sum over the whole group. ``at_most`` is a row
    count the caller has already measured; a table that small needs no look at its groups, and of a large
    one each task sorts about ``TASK_ROWS`` rows.
    """
    limit = session.HOT_ROWS if hot_rows is None else hot_rows
    group = list(group)
    small = at_most is not None and at_most <= limit
    if not small and largest_group(df, group) > limit:
        return _running_total_in_pieces(df, group, order, weight, before, total)
    if group and at_most is not None and at_most > session.TASK_ROWS:
        df = session.spread(df, at_most, *group)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ordered = whole.orderBy(*order)
    if weight is None:
        running = F.row_number().over(ordered).cast("long") - 1
        everything = F.count(F.lit(1)).over(whole)
    else:
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        running = F.coalesce(F.sum(weight).over(earlier), F.lit(0).cast("long"))
        everything = F.sum(weight).over(whole)
    out = df.withColumn(before, running)
    return out if total is None else out.withColumn(total, everything)


def _running_total_in_pieces(df, group, order, weight, before, total):
    keys = [F.col(c) for c in group]
    # The piece number is read back from files, so every later read sees the same pieces.
    placed = session.stage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_piece", F.shiftrightunsigned("_slot", 33))
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    placed = placed.withColumn("_amount", amount)

    pieces = placed.groupBy(*group, "_piece").agg(
        F.sum("_amount").alias("_in_piece"), F.count(F.lit(1)).alias("_piece_rows"))
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_shift", F.sum("_in_piece").over(earlier))
    # Only the first group of a piece can have begun in an earlier one: at most one row per piece.
    shifts = pieces.filter(F.col("_shift") > 0).select(
        F.col("_piece").alias("_at"), *[F.col(c).alias(f"_k_{c}") for c in group], "_shift"
    )
    match = (F.col("_piece") == F.col("_at")) & same(keys, [F.col(f"_k_{c}") for c in group])
    local = Window.partitionBy(*group, "_piece").orderBy("_slot")
    inside = F.coalesce(
        F.sum("_amount").over(local.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0).cast("long"),
    )
    out = (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(shifts), match, "left")
        .withColumn(before, F.col("_inside") + F.coalesce("_shift", F.lit(0)))
    )
    if total is not None:
        sums = pieces.groupBy(*group).agg(
            F.sum("_in_piece").alias(total), F.sum("_piece_rows").alias("_group_rows"))
        out = attach(out, sums, group, size="_group_rows")
    kept = [*df.columns, before] + ([total] if total else [])
    return out.select(*kept)


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its group (``row_number`` without the hot task)."""
    out = running_total(df, group, order, before=name, hot_rows=hot_rows, at_most=at_most)
    return out.withColumn(name, F.col(name) + 1)


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group.

    Filtering a lone ``row_number`` lets Spark keep only ``k`` rows per group in every map task
    before the shuffle, so a hot group never travels whole.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def score_bounds(
    df: DataFrame, group: Sequence[str], scores: Sequence[str], ids: Sequence[str], k: int
) -> tuple[DataFrame, int] | None:
    """Per group and score a value that at least ``k`` rows reach: ``_bound_<i>`` of ``scores[i]``, and the groups.

    Rows are dealt to 4 ``k`` lots by a hash of their ids; the ``k``-th best of the lots' maxima is reached by one
    row in each of ``k`` lots. Null where fewer lots have a score. Maxima need no sort, and about 5 % of a group of
    600 rows lie above the bound of ``k`` = 10. ``None`` where groups are too small for that to pay.
    """
    size = df.agg(
        F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*group) if group else F.lit(0))
    ).first()
    if size[0] < 16 * k * max(size[1], 1):
        return None
    lot = F.pmod(F.xxhash64(*ids), F.lit(4 * k))
    best = df.groupBy(*group, lot.alias("_lot")).agg(
        *[F.max(s).alias(f"_best_{i}") for i, s in enumerate(scores)]
    )
    kth = [
        F.get(F.sort_array(F.collect_list(f"_best_{i}"), asc=False), F.lit(k - 1)).alias(f"_bound_{i}")
        for i in range(len(scores))  # at most 4 k entries each
    ]
    return session.measured(best.groupBy(*group).agg(*kth))


def contenders(
    df: DataFrame, group: Sequence[str], scores: Sequence[str], ids: Sequence[str], k: int
) -> DataFrame:
    """``df`` without rows that surely miss the first ``k`` of their group by each of ``scores`` (descending,
    nulls last); nothing is sorted, and ``df`` is read three times."""
    found = score_bounds(df, group, scores, ids, k)
    if found is None:
        return df
    bounds, groups = found
    near = F.lit(False)
    for i, score in enumerate(scores):
        near = near | F.col(f"_bound_{i}").isNull() | F.coalesce(F.col(score) >= F.col(f"_bound_{i}"), F.lit(False))
    return attach(df, bounds, group, at_most=groups).filter(near).select(*df.columns)


def stacked_contenders(
    df: DataFrame,
    keep: Sequence[str],
    group: Sequence[str],
    scores: Mapping[object, Column],
    ids: Sequence[str],
    k: int,
    name: str = "ranker",
    value: str = "score",
) -> DataFrame:
    """One row per (row, score) with the key of ``scores`` as ``name`` and the number as ``value``; rows that surely
    miss the first ``k`` of their group by a score have no row for it, so few rows are copied and sorted."""
    numbers = {f"_score_{i}": c.cast("double") for i, c in enumerate(scores.values())}
    rows = df.select(*dict.fromkeys([*keep, *group, *ids]), *[c.alias(n) for n, c in numbers.items()])
    found = score_bounds(rows, group, list(numbers), ids, k)
    if found is not None:
        rows = attach(rows, found[0], group, at_most=found[1])
    pairs = []
    for i, (key, score) in enumerate(zip(scores, numbers)):
        pair = F.struct(F.lit(key).alias(name), F.col(score).alias(value))
        if found is not None:
            bound = F.col(f"_bound_{i}")
            pair = F.when(bound.isNull() | (F.col(score) >= bound), pair)
        pairs.append(pair)
    long = rows.select(*keep, F.explode(F.array(*pairs)).alias("_pair")).filter("_pair IS NOT NULL")
    return long.select(*keep, f"_pair.{name}", f"_pair.{value}")


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = 32,
    broadcast_rows: int | None = None,
    at_most: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """Join a one-row-per-key table back to the rows it describes (null keys match null keys).

    The table is counted first, unless ``at_most`` already bounds its rows. Small enough: broadcast, and the rows never move. Otherwise both
    sides are shuffled on (keys, salt), so that the rows of a hot key spread over ``salts`` tasks.
    ``size`` names a column of the table with the rows per key: keys above ``HOT_ROWS`` are salted
    (there can be at most total / ``HOT_ROWS`` of them, few enough to broadcast). Without it nothing is
    repeated, and a skewed key is left to Spark's adaptive join.
    """
    limit = session.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    keys = list(keys)
    rows = at_most
    if rows is None:
        stats, rows = session.measured(stats)
    extra = [c for c in stats.columns if c not in keys]
    right = stats.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *extra)
    match = same([F.col(c) for c in keys], [F.col(f"_r_{c}") for c in keys])
    kept = df.columns + ([] if how in ("left_semi", "left_anti") else extra)
    if rows <= limit:
        return df.join(F.broadcast(right), match, how).select(*kept)
    # The hint matters: a repeated table looks as small as its files and would be broadcast.
    if salts <= 1 or size is None:
        return df.join(right.hint("merge"), match, how).select(*kept)
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    lot = F.pmod(F.xxhash64(*plain), F.lit(salts))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    is_hot = F.col(size) > session.HOT_ROWS
    hot, hot_keys = session.measured(
        stats.filter(is_hot).select(*[F.col(c).alias(f"_h_{c}") for c in keys])
    )
    if not hot_keys:
        return df.join(right.hint("merge"), match, how).select(*kept)
    hot = hot.withColumn("_hot", F.lit(True))
    on_hot = same([F.col(c) for c in keys], [F.col(f"_h_{c}") for c in keys])
    flagged = df.join(F.broadcast(hot), on_hot, "left")
    none = F.lit(0).cast("long")
    salted = flagged.withColumn("_salt", F.when(F.col("_hot"), lot).otherwise(none))
    copies = F.when(is_hot, every).otherwise(F.array(none))
    repeated = right.withColumn("_r_salt", F.explode(copies)).hint("merge")
    return salted.join(repeated, match & (F.col("_salt") == F.col("_r_salt")), how).select(*kept)


def with_group_stats(
    df: DataFrame,
    group: Sequence[str],
    aggregates: Sequence[Column],
    at_most: int | None = None,
) -> DataFrame:
    """Aggregate per group and put the result on every row (an unordered window without the
    whole-group task). ``at_most`` bounds the rows of ``df``, hence the number of groups."""
    stats = df.groupBy(*group).agg(*aggregates, F.count(F.lit(1)).alias("_group_rows"))
    return attach(df, stats, group, at_most=at_most, size="_group_rows").drop("_group_rows")


def histogram(
    df: DataFrame, group: Sequence[str], value: str, count: str = "_n"
) -> DataFrame:
    """Rows per (group, value), nulls left out. Repeated values collapse before the shuffle."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias(count))
    )


def quantiles(
    hist: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    count: str = "_n",
    rows: str | None = None,
    hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, read from a histogram.

    Repeated values were collapsed by :func:`histogram`; a group with very many distinct values
    takes the piecewise route of :func:`running_total` instead of one task's memory.
    """
    placed = running_total(
        hist,
        group,
        [F.col(value).asc()],
        count,
        "_before",
        "_total",
        hot_rows=hot_rows,
        at_most=at_most,
    )
    # Written as SQL text: one expression per pick however many quantiles are asked for.
    picks, outputs = ["max(_total) AS _total"], []
    for name, p in probabilities.items():
        spot = f"({float(p)}D * (_total - 1))"
        for side, position in (("lo", f"floor({spot})"), ("hi", f"ceil({spot})")):
            picks.append(
                f"max(CASE WHEN _before <= {position} AND {position} < _before + `{count}` "
                f"THEN `{value}` END) AS `_{side}_{name}`"
            )
        low, high = f"CAST(`_lo_{name}` AS DOUBLE)", f"CAST(`_hi_{name}` AS DOUBLE)"
        outputs.append(f"{low} + ({high} - {low}) * ({spot} - floor({spot})) AS `{name}`")
    if rows is not None:
        outputs.append(f"_total AS `{rows}`")
    picked = placed.groupBy(*group).agg(*[F.expr(pick) for pick in picks])
    return picked.selectExpr(*[f"`{c}`" for c in group], *outputs)


def group_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    rows: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """:func:`histogram` then :func:`quantiles`. The rows are read once, into the histogram."""
    hist, size = session.measured(histogram(df, group, value))
    return quantiles(
        hist, group, value, probabilities, rows=rows, hot_rows=hot_rows, at_most=size
    )


def group_median(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "median",
    at_most: int | None = None,
) -> DataFrame:
    """Exact median per group; ``at_most`` bounds the rows of ``df``."""
    if at_most is not None:
        hist = histogram(df, group, value)
        return quantiles(hist, group, value, {name: 0.5}, at_most=at_most)
    return group_quantiles(df, group, value, {name: 0.5})


def average_rank(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "rank",
    share: str | None = None,
    hot_rows: int | None = None,
    ties: str = "average",
    weight: str | None = None,
) -> DataFrame:
    """Ascending rank with ties averaged; ``share`` also divides it by the non-null count.

    With ``ties="min"`` tied rows all take the first of their places, like SQL's ``rank()``. ``weight`` names
    the number of equal rows that a row stands for.
    Worked out once per distinct value and joined back, so a heavy tie is one histogram row.
    Rows with a null value keep a null rank.
    """
    amount = F.lit(1) if weight is None else F.col(weight)
    hist, size = session.measured(
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
            F.sum(amount.cast("long")).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    )
    placed = running_total(
        hist,
        group,
        [F.col(value).asc()],
        "_n",
        "_before",
        "_total",
        hot_rows=hot_rows,
        at_most=size,
    )
    if ties not in ("average", "min"):
        raise ValueError(f"unknown rule for ties {ties!r}")
    rank = F.col("_before") + (F.lit(1.0) if ties == "min" else (F.col("_n") + 1) / F.lit(2.0))
    columns = [rank.alias(name)]
    if share is not None:
        columns.append((rank / F.col("_total")).alias(share))
    ranks = placed.select(*group, value, *columns, "_rows")
    if size > session.BROADCAST_ROWS:
        ranks = session.stage(ranks)
    return attach(df, ranks, [*group, value], at_most=size, size="_rows").drop("_rows")


def dense_ids(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    start: int = 0,
    hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """One dense integer id per distinct key combination, numbered in key order."""
    distinct = df.select(*keys).distinct()
    order = [F.col(c).asc_nulls_first() for c in keys]
    numbered = running_total(distinct, [], order, before=name, hot_rows=hot_rows, at_most=at_most)
    return numbered.withColumn(name, F.col(name) + start)
