"""The forward-window label, its cross-check, and the relevance grades cut from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ordering, quality

LABEL_WINDOW_DAYS = 90
MIN_AVAILABILITY_AGREEMENT = 0.999
GRADES_ABOVE_ATOM = 4
MIN_PARTITION_ROWS = 30


def anchors(calendar: DataFrame, key: str, date: str, name: str = "T") -> DataFrame:
    """First calendar day per key."""
    return calendar.groupBy(key).agg(F.min(date).alias(name))


def occupancy_label(
    calendar: DataFrame,
    key: str = "listing_id",
    date: str = "date",
    available: str = "available",
    window_days: int = LABEL_WINDOW_DAYS,
    check: bool = True,
) -> DataFrame:
    """Blocked share of the ``window_days`` from each key's own first day.

    Two map-side-combined aggregations by key: the anchors, then the window sums once each row
    knows its anchor. ``check`` stops the run unless every window holds exactly ``window_days``
    rows.
    """
    quality.require_columns(calendar, (key, date, available), "calendar")
    anchored = ordering.attach(
        calendar.select(key, date, available), anchors(calendar, key, date), [key]
    )
    inside = F.col(date) < F.date_add(F.col("T"), window_days)
    is_open = F.col(available).cast("int")
    rows = F.count(F.lit(1))
    labels = anchored.groupBy(key).agg(
        F.min("T").alias("T"),
        rows.alias("calendar_days"),
        (F.datediff(F.max(date), F.min(date)) + 1).alias("calendar_span"),
        F.count(F.when(inside, 1)).alias("_window_rows"),
        F.coalesce(F.sum(F.when(inside, is_open)), F.lit(0)).alias(f"avail_{window_days}"),
        F.avg(is_open).alias("_open_share"),
    )
    if check:
        labels, _ = ordering.session.measured(labels)
        wrong = labels.filter(F.col("_window_rows") != window_days)
        short = wrong.count()
        if short:
            named = [r[0] for r in wrong.select(key).limit(5).collect()]
            raise quality.CheckFailed(
                f"{short} {key}(s) do not have exactly {window_days} rows in the window: {named}"
            )
    return labels.select(
        key,
        "T",
        "calendar_days",
        "calendar_span",
        f"avail_{window_days}",
        (1 - F.col(f"avail_{window_days}") / F.lit(window_days)).alias(
            f"blocked_fraction_{window_days}"
        ),
        (1 - F.col("_open_share")).alias("blocked_fraction_calendar"),
    )


def crosscheck_availability(
    labels: DataFrame,
    items: DataFrame,
    key: str,
    item_key: str,
    by: Sequence[str],
    derived: str = "avail_90",
    shipped: str = "availability_90",
) -> DataFrame:
    """Per ``by``: how often the derived availability equals the shipped one, and by how much not."""
    pairs = items.select(item_key, shipped, *by).join(
        labels.select(F.col(key).alias(item_key), derived), item_key
    )
    gap = F.col(derived) - F.col(shipped)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((gap == 0).cast("double")).alias("exact_agreement"),
        F.count(F.when(gap != 0, 1)).alias("n_mismatched"),
        F.avg(F.abs(gap)).alias("mean_abs_diff"),
    )


_EDGES = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}


def _edges(
    hist: DataFrame, keys: list[str], label: str, prefix: str, at_most: int
) -> DataFrame:
    """Quartile edges per key set from a label histogram, with row counts and a cuttable flag."""
    rolled = hist.groupBy(*keys, label).agg(F.sum("_n").alias("_n"))
    cuts = ordering.quantiles(rolled, keys, label, _EDGES, rows="_above", at_most=at_most)
    increasing = "q0 < q1 AND q1 < q2 AND q2 < q3 AND q3 < q4"
    return cuts.selectExpr(
        *[f"`{k}`" for k in keys],
        *[f"{q} AS {prefix}{q}" for q in ("q1", "q2", "q3")],
        f"_above AS {prefix}above",
        f"{increasing} AS {prefix}cuttable",
    )


def label_counts(df: DataFrame, label: str, partition: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows per (cell, label value): the one pass over the rows that grading needs."""
    return ordering.session.measured(
        df.groupBy(*partition, label).agg(F.count(F.lit(1)).alias("_n"))
    )


def grade_edges(
    counts: DataFrame,
    size: int,
    label: str,
    partition: Sequence[str],
    fallback: Sequence[str],
    min_rows: int = MIN_PARTITION_ROWS,
) -> DataFrame:
    """One row per cell: ``n``, ``above_atom``, ``level`` and the three cut points it uses.

    ``counts`` and ``size`` come from :func:`label_counts`; both the cell's own quartiles and those
    of its fallback pool are read off it. A cell below ``min_rows``
    or with repeated edges takes the cut points of the *whole* fallback pool.
    """
    partition, fallback = list(partition), list(fallback)
    if not set(fallback) <= set(partition):
        raise quality.CheckFailed("the fallback must be a coarsening of the partition")
    present = [F.col(c).isNotNull() for c in partition]
    above = counts.filter(F.col(label) != 0.0)
    for condition in present:
        above = above.filter(condition)
    own = _edges(above, partition, label, "own_", size)
    pool = _edges(above, fallback, label, "pool_", size)
    cells = counts.groupBy(*partition).agg(F.sum("_n").alias("n"))
    joined = cells.join(own, partition, "left").join(pool, fallback, "left")
    uses_own = f"(own_above >= {min_rows} AND own_cuttable)"
    return joined.selectExpr(
        *[f"`{k}`" for k in partition],
        "n",
        "coalesce(own_above, 0L) AS above_atom",
        f"CASE WHEN coalesce(own_above, 0) = 0 THEN 'empty' WHEN {uses_own} THEN 'partition' "
        "ELSE 'fallback' END AS level",
        f"own_above >= {min_rows} AS _large",
        "coalesce(pool_cuttable, false) AS _pool_cuttable",
        *[f"CASE WHEN {uses_own} THEN own_{q} ELSE pool_{q} END AS {q}" for q in ("q1", "q2", "q3")],
    )


def grade_from_edges(label: str) -> Column:
    """0 at the zero atom, else 1-4 by right-closed quartiles ``q1, q2, q3``."""
    steps = " + ".join(f"CAST(`{label}` > {q} AS INT)" for q in ("q1", "q2", "q3"))
    return F.expr(f"CASE WHEN `{label}` = 0 THEN 0 ELSE 1 + {steps} END")


def assign_grades(
    df: DataFrame,
    label: str = "blocked_fraction_90",
    partition: Sequence[str] = ("city", "room_type"),
    fallback: Sequence[str] = ("city",),
    min_rows: int = MIN_PARTITION_ROWS,
    name: str = "grade",
) -> tuple[DataFrame, DataFrame]:
    """Grades 0-4 on the label's *value* within a partition: ``(rows with grade, report)``.

    Equal labels in a cell always get equal grades. Stops on a null label, a label outside
    [0, 1], or a fallback pool that must be used but cannot be cut.
    """
    quality.require_columns(df, [label, *partition, *fallback], "rows to grade")
    counts, size = label_counts(df, label, partition)
    quality.require(
        counts,
        {
            f"{label} is null": F.col(label).isNull(),
            f"{label} outside [0, 1]": (F.col(label) < 0) | (F.col(label) > 1),
        },
        weight="_n",
    )
    cells = grade_edges(counts, size, label, partition, fallback, min_rows)
    cells, bound = ordering.session.measured(cells)
    quality.require(
        cells,
        {
            "fallback pool cannot be cut into quartiles": (F.col("level") == "fallback")
            & ~F.col("_pool_cuttable")
        },
    )
    edges = cells.select(*partition, "q1", "q2", "q3")
    graded = ordering.attach(df, edges, list(partition), at_most=bound).withColumn(
        name, grade_from_edges(label)
    )
    report = cells.select(*partition, "n", "above_atom", "level")
    return graded.drop("q1", "q2", "q3"), report


def concentrated_cells(cells: DataFrame) -> DataFrame:
    """Cells that had enough rows but could not be cut, from :func:`grade_edges`."""
    return cells.filter((F.col("level") == "fallback") & F.col("_large"))
