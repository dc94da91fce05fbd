"""Declared schemas of the raw entities and the disposition of every listings column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw listings header in file order with its Spark type.
LISTINGS = """
id bigint, listing_url string, scrape_id bigint, last_scraped string, source string, name string,
description string, neighborhood_overview string, picture_url string, host_id bigint,
host_url string, host_profile_id string, host_profile_url string, host_name string,
host_since string, hosts_time_as_user_years int, hosts_time_as_user_months int,
hosts_time_as_host_years int, hosts_time_as_host_months int, host_location string,
host_about string, host_response_time string, host_response_rate string,
host_acceptance_rate string, host_is_superhost string, host_thumbnail_url string,
host_picture_url string, host_neighbourhood string, host_listings_count double,
host_total_listings_count double, host_verifications string, host_has_profile_pic string,
host_identity_verified string, neighbourhood string, neighbourhood_cleansed string,
neighbourhood_group_cleansed string, latitude double, longitude double, property_type string,
room_type string, accommodates int, bathrooms double, bathrooms_text string, bedrooms double,
beds double, amenities string, price string, price_quote_checkin_date string,
price_quote_checkout_date string, price_quote_total_price string,
price_quote_price_per_night string, price_quote_raw string, minimum_nights int,
maximum_nights int, minimum_minimum_nights int, maximum_minimum_nights int,
minimum_maximum_nights int, maximum_maximum_nights int, minimum_nights_avg_ntm double,
maximum_nights_avg_ntm double, calendar_updated string, has_availability string,
availability_30 int, availability_60 int, availability_90 int, availability_365 int,
calendar_last_scraped string, number_of_reviews int, number_of_reviews_ltm int,
number_of_reviews_l30d int, availability_eoy int, number_of_reviews_ly int,
estimated_occupancy_l365d double, estimated_revenue_l365d double, first_review string,
last_review string, review_scores_rating double, review_scores_accuracy double,
review_scores_cleanliness double, review_scores_checkin double,
review_scores_communication double, review_scores_location double, review_scores_value double,
license string, instant_bookable string, calculated_host_listings_count int,
calculated_host_listings_count_entire_homes int,
calculated_host_listings_count_private_rooms int,
calculated_host_listings_count_shared_rooms int, reviews_per_month double
"""
CALENDAR = "listing_id bigint, date string, available string, minimum_nights int, maximum_nights int"
REVIEWS = (
    "listing_id bigint, id bigint, date string, reviewer_id bigint, reviewer_name string, "
    "comments string"
)
NEIGHBOURHOODS = "neighbourhood_group string, neighbourhood string"

# What happens to a column that is not kept as a feature.
ALL_NULL = """calendar_updated host_acceptance_rate host_neighbourhood host_response_rate
host_response_time host_since host_thumbnail_url host_total_listings_count host_verifications
instant_bookable neighborhood_overview neighbourhood neighbourhood_group_cleansed""".split()
PII_DROP = """host_name host_picture_url host_profile_id host_profile_url host_url
listing_url""".split()
DERIVED_FROM = {
    "last_scraped": "scrape_date",
    "host_location": "host_is_local",
    "host_about": "host_has_about",
    "license": "license_status + license_hash",
    "hosts_time_as_user_years": "user_tenure_months",
    "hosts_time_as_user_months": "user_tenure_months",
    "hosts_time_as_host_years": "host_tenure_months",
    "hosts_time_as_host_months": "host_tenure_months",
}
REDUNDANT = """calendar_last_scraped description has_availability maximum_maximum_nights
maximum_minimum_nights maximum_nights_avg_ntm minimum_maximum_nights minimum_minimum_nights
picture_url price_quote_price_per_night price_quote_raw price_quote_total_price scrape_id
source""".split()
LABEL_ADJACENT = """availability_30 availability_60 availability_90 availability_365
availability_eoy estimated_occupancy_l365d estimated_revenue_l365d price_quote_checkin_date
price_quote_checkout_date""".split()
KEEP = """accommodates amenities bathrooms bathrooms_text bedrooms beds
calculated_host_listings_count calculated_host_listings_count_entire_homes
calculated_host_listings_count_private_rooms calculated_host_listings_count_shared_rooms
first_review host_has_profile_pic host_id host_identity_verified host_is_superhost
host_listings_count id last_review latitude longitude maximum_nights minimum_nights
minimum_nights_avg_ntm name neighbourhood_cleansed number_of_reviews number_of_reviews_l30d
number_of_reviews_ltm number_of_reviews_ly price property_type review_scores_accuracy
review_scores_checkin review_scores_cleanliness review_scores_communication
review_scores_location review_scores_rating review_scores_value reviews_per_month
room_type""".split()
HASHED = ["host_id", "id"]
CALENDAR_KEEP = ["listing_id", "date", "available"]
REVIEWS_KEEP = ["listing_id", "id", "date", "comments"]
REVIEWS_PII_DROP = ["reviewer_id", "reviewer_name"]

ENTITIES = {"listings": LISTINGS, "calendar": CALENDAR, "reviews": REVIEWS}
#: Columns whose type is pinned at read and must be present; a null id stops the run.
PINNED = {"listings": ["id", "host_id", "license"], "calendar": ["listing_id"],
          "reviews": ["listing_id", "id"]}
NOT_NULL = {"listings": ["id", "host_id"], "calendar": ["listing_id"],
            "reviews": ["listing_id", "id"]}

# One snapshot per market, with the files each one ships.
SNAPSHOTS = {
    "thessaloniki": "2026-06-29",
    "athens": "2026-06-28",
    "crete": "2026-06-29",
}
FILES = {
    "listings": "listings.csv.gz",
    "calendar": "calendar.csv.gz",
    "reviews": "reviews.csv.gz",
    "neighbourhoods": "neighbourhoods.csv",
}
# Generous market bounds (south, north, west, east).
BOUNDING_BOXES = {
    "thessaloniki": (40.40, 40.80, 22.70, 23.20),
    "athens": (37.60, 38.35, 23.00, 24.20),
    "crete": (34.75, 35.75, 23.40, 26.40),
}
# The landmarks distances are measured to, per market.
ANCHORS = {
    "thessaloniki": [("thessaloniki_centre", 40.62945, 22.94470)],
    "athens": [("syntagma", 37.97550, 23.73480)],
    "crete": [
        ("chania", 35.51380, 24.01800),
        ("rethymno", 35.36620, 24.47770),
        ("heraklion", 35.33870, 25.14420),
        ("agios_nikolaos", 35.19110, 25.71680),
    ],
}


def schema(ddl: str) -> T.StructType:
    """A schema from its column list."""
    return T.StructType.fromDDL(ddl.replace("\n", " "))


def dispositions(spark: SparkSession) -> DataFrame:
    """``(column, disposition)`` for the listings entity."""
    sets = {
        "all_null": ALL_NULL,
        "pii_drop": PII_DROP,
        "derived_from": list(DERIVED_FROM),
        "redundant": REDUNDANT,
        "label_adjacent": LABEL_ADJACENT,
        "keep": KEEP,
    }
    rows = [(column, name) for name, columns in sets.items() for column in columns]
    return spark.createDataFrame(rows, "column string, disposition string")


def audit_columns(present: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns that are not in exactly one disposition set: ``(column, problem)``.

    ``present`` has the header names in ``column``; ``declared`` is :func:`dispositions`.
    """
    counted = declared.groupBy("column").agg(F.count(F.lit(1)).alias("sets"))
    joined = present.select("column", F.lit(1).alias("here")).join(counted, "column", "full_outer")
    problem = (
        F.when(F.col("sets").isNull(), "no disposition")
        .when(F.col("here").isNull(), "not in the file")
        .when(F.col("sets") > 1, "more than one disposition")
    )
    return joined.select("column", problem.alias("problem")).filter("problem IS NOT NULL")
