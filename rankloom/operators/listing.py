"""The structural, host and amenity block, and which columns may never be inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.parsing import building_type
from rankloom.operators import amenities, quality
from rankloom.sources.schemas import LABEL_ADJACENT

# The columns of the block and the roles of the feature table's columns.
STRUCTURAL = ("accommodates", "bedrooms", "beds", "bathrooms", "bathrooms_shared", "price",
              "minimum_nights", "maximum_nights")
HOST = ("host_is_superhost", "host_is_local", "host_has_about", "host_tenure_months",
        "host_listings_count", "calculated_host_listings_count",
        "calculated_host_listings_count_entire_homes",
        "calculated_host_listings_count_private_rooms",
        "calculated_host_listings_count_shared_rooms", "license_status")
CATEGORICAL = ("room_type", "building_type", "host_is_local", "license_status", "city")
IDENTIFIERS = ("id", "query_group", "cluster_id")
TARGETS = ("grade", "blocked_fraction_90")
DIAGNOSTIC = ("avail_90", "blocked_fraction_calendar", "calendar_days", "calendar_span", "T",
              "scrape_date", "level")


def listing_features(
    df: DataFrame, scheme: str = "buckets", vocabulary: Sequence[str] | None = None
) -> DataFrame:
    """Add ``building_type`` and the amenity block to rows that carry the raw attributes."""
    quality.require_columns(
        df, ["id", "city", "property_type", "room_type", "amenities", *STRUCTURAL, *HOST],
        "ranked rows",
    )
    typed = df.withColumn("building_type", building_type(F.col("property_type")))
    return amenities.amenity_features(typed, scheme, vocabulary)


def listing_columns(columns: Sequence[str]) -> list[str]:
    """The block's columns, in order, as present after :func:`listing_features`."""
    block = [*STRUCTURAL, *HOST, "building_type", "room_type", "city"]
    block += [c for c in columns if c.startswith("amenity_")]
    blocked = sorted(set(block) & set(LABEL_ADJACENT))
    if blocked:
        raise quality.CheckFailed(f"label-adjacent columns in the feature block: {blocked}")
    return block
