"""Processed layer to feature table. The order is fixed: label, filter, impute, grade, group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators import assemble, cascade, filters, label
from rankloom.sources import sinks


def prepare_ranked(
    listings: DataFrame, calendar: DataFrame
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(ranked population, reports)``. Cut points and medians see the filtered rows only."""
    labels = label.occupancy_label(calendar)
    joined = listings.join(labels.withColumnRenamed("listing_id", "id"), "id")
    kept, removed = filters.filter_listings(joined)
    tiered = cascade.with_capacity_tier(session.stage(kept))
    priced, rungs = cascade.impute_price(tiered)
    graded, cells = label.assign_grades(priced)
    clustered = cascade.cluster_id(session.stage(graded))
    grouped, group_rungs = cascade.query_group(clustered, partition=("city", "room_type"))
    reports = {"filters": removed, "price": rungs, "grades": cells, "groups": group_rungs}
    return session.stage(grouped.drop("capacity_tier")), reports


def build(
    spark: SparkSession,
    processed: str,
    out: str,
    scheme: str = "buckets",
    vocabulary: Sequence[str] | None = None,
) -> DataFrame:
    """Read the processed tables, assemble, check, write sorted by group."""
    listings = spark.read.parquet(f"{processed}/listings")
    calendar = spark.read.parquet(f"{processed}/calendar")
    ranked, _ = prepare_ranked(listings, calendar)
    review_rows = sinks.read_columns(spark, f"{processed}/reviews", ["listing_id", "date"])
    table = session.stage(
        assemble.assemble_feature_table(ranked, review_rows, scheme, vocabulary)
    )
    assemble.check_feature_table(table)
    sinks.write_feature_table(table, out)
    return spark.read.parquet(out)


def reports_as_rows(reports: dict[str, DataFrame]) -> DataFrame:
    """All stage reports stacked as JSON lines, for a log table."""
    stacked = None
    for name, frame in reports.items():
        rows = frame.select(F.lit(name).alias("stage"), F.to_json(F.struct("*")).alias("row"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked
