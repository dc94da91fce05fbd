"""Typing and derivation of the anonymised entities. Only duplicate ids are ever removed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import parsing
from rankloom.operators import quality
from rankloom.sources import schemas

FLAGS = ["host_is_superhost", "host_has_profile_pic", "host_identity_verified"]
DATES = ["last_scraped", "first_review", "last_review", "price_quote_checkin_date",
         "price_quote_checkout_date"]
TENURES = {"user_tenure_months": "hosts_time_as_user", "host_tenure_months": "hosts_time_as_host"}


def fatal_listing_rules() -> dict[str, Column]:
    """Raw values that stop the run."""
    rules = {f"{c}: unexpected boolean token": parsing.unknown_flag(F.col(c)) for c in FLAGS}
    for stem in TENURES.values():
        rules[f"{stem}_months: outside 0-11"] = parsing.bad_tenure(F.col(f"{stem}_months"))
    return rules


def counted_listing_rules() -> dict[str, Column]:
    """Raw values that are counted and kept (as null where unparseable)."""
    rules = {f"{c}: unparseable date": parsing.lost_date(F.col(c)) for c in DATES}
    rules["amenities: unparseable JSON"] = parsing.lost_list(F.col("amenities"))
    return rules


def counted_clean_rules(boxes: Mapping[str, tuple] = schemas.BOUNDING_BOXES) -> dict[str, Column]:
    """Cross-column rules on the cleaned frame, counted and kept."""
    inside = F.lit(False)
    for city, (south, north, west, east) in boxes.items():
        box = parsing.within_box(F.col("latitude"), F.col("longitude"), south, north, west, east)
        inside = inside | ((F.col("city") == city) & box)
    scraped = F.col("scrape_date")
    return {
        "first_review postdates its own scrape": parsing.out_of_range(
            F.col("first_review"), upper=scraped
        ),
        "last_review postdates its own scrape": parsing.out_of_range(
            F.col("last_review"), upper=scraped
        ),
        "first_review is later than last_review": parsing.out_of_range(
            F.col("first_review"), upper=F.col("last_review")
        ),
        "coordinates outside the market": ~F.coalesce(inside, F.lit(False)),
    }


def clean_listings(df: DataFrame, city: str | Column) -> DataFrame:
    """Typed listings with ``city``, ``scrape_date`` and the derived columns.

    Rows keep their first occurrence per id in file order, which the ``_row`` column carries when
    the reader added one; without it the smallest remaining columns decide.
    """
    market = F.lit(city) if isinstance(city, str) else city
    if isinstance(city, str) and city not in schemas.BOUNDING_BOXES:
        raise quality.CheckFailed(f"unknown city {city!r}")
    consumed = [f"{stem}_{part}" for stem in TENURES.values() for part in ("years", "months")]
    dropped = [*schemas.ALL_NULL, *schemas.REDUNDANT, *consumed, "last_scraped"]
    dropped = [c for c in dropped if c not in schemas.PII_DROP]
    read = ["amenities", "bathrooms", "bathrooms_text", "id", "latitude", "longitude", "price"]
    quality.require_columns(df, [*dropped, *read, *FLAGS], "listings")

    # Without row numbers every column takes part, so that only equal rows are interchangeable.
    first = ["last_scraped", "name"]
    others = sorted(set(df.columns) - {*first, "id"})
    order = [F.col(c) for c in (["_row"] if "_row" in df.columns else [*first, *others])]
    out = quality.drop_duplicates_keep_first(df, ["id"], order)
    typed = {c: parsing.parse_date(F.col(c)) for c in DATES}
    typed |= {c: parsing.parse_flag(F.col(c)) for c in FLAGS}
    typed |= {
        "price": parsing.parse_price(F.col("price")),
        "amenities": parsing.parse_string_list(F.col("amenities")),
        "bathrooms": parsing.bathroom_count(F.col("bathrooms"), F.col("bathrooms_text")),
        "bathrooms_shared": parsing.bathroom_shared(F.col("bathrooms_text")),
        "city": market,
        "scrape_date": parsing.parse_date(F.col("last_scraped")),
    }
    typed |= {
        name: parsing.tenure_months(F.col(f"{stem}_years"), F.col(f"{stem}_months"))
        for name, stem in TENURES.items()
    }
    return out.withColumns(typed).drop(*dropped, "_row")


def clean_calendar(df: DataFrame) -> DataFrame:
    """``listing_id, date, available``."""
    quality.require_columns(df, schema_columns(schemas.CALENDAR), "calendar")
    return df.select(
        "listing_id",
        parsing.parse_date(F.col("date")).alias("date"),
        parsing.parse_flag(F.col("available")).alias("available"),
    )


def clean_reviews(df: DataFrame) -> DataFrame:
    """Reviews with a typed date."""
    quality.require_columns(df, schemas.REVIEWS_KEEP, "reviews")
    return df.withColumn("date", parsing.parse_date(F.col("date")))


def schema_columns(ddl: str) -> list[str]:
    """Column names of a declared entity."""
    return schemas.schema(ddl).fieldNames()
