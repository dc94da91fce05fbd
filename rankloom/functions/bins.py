"""Right-closed banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The capacity tiers of the search key, as right-closed edges.
CAPACITY_EDGES = (0, 2, 4, 7, 100)
CAPACITY_LABELS = ("1-2", "3-4", "5-7", "8+")
# Party sizes offered in the open tier.
OPEN_TIER_SIZES = (8, 10, 12, 16)

# Group-size bands used by the split and by the metric breakdown.
GROUP_SIZE_EDGES = (0, 10, 30, 100, 400, float("inf"))
GROUP_SIZE_LABELS = ("<10", "10-30", "30-100", "100-400", "400+")
METRIC_SIZE_EDGES = (0, 10, 50, 200, 10_000)


def span_labels(edges: Sequence[float]) -> list[str]:
    """``1-10``, ``11-50``, ... for integer edges."""
    return [f"{int(a) + 1}-{int(b)}" for a, b in zip(edges, edges[1:])]


def cut(
    value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False
) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` holding ``value``; outside or null is null."""
    return _bands(value, edges, labels, include_lowest)


def cut_ordinal(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Position of that bin, so that labels can be ordered."""
    return _bands(value, edges, list(range(len(edges) - 1)), include_lowest)


def _bands(value, edges, outputs, include_lowest):
    if len(outputs) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(outputs)}")
    chain = None
    for i, output in enumerate(outputs):
        low, high = float(edges[i]), float(edges[i + 1])
        above = value >= low if include_lowest and i == 0 else value > low
        inside = above & (value <= high) if high != float("inf") else above
        chain = F.when(inside, F.lit(output)) if chain is None else chain.when(
            inside, F.lit(output)
        )
    return chain


def capacity_tier(accommodates: Column) -> Column:
    """The four search-intent tiers."""
    return cut(accommodates, CAPACITY_EDGES, CAPACITY_LABELS)


def party_sizes(spark: SparkSession) -> DataFrame:
    """``(tier, guests)``: the party sizes a search form offers, each with its tier.

    Closed tiers offer every size they hold, the open one ``OPEN_TIER_SIZES``. Joining searches to
    this table, or :func:`capacity_tier`, resolves a batch; a size outside the tiers has none.
    """
    largest = CAPACITY_EDGES[-2]
    sizes = F.array(*[F.lit(n) for n in [*range(1, largest + 1), *OPEN_TIER_SIZES]])
    offered = spark.range(1).select(F.explode(sizes).alias("guests"))
    return offered.select(capacity_tier(F.col("guests")).alias("tier"), "guests")
