"""Identity removal: hash the keys, derive what is analytically useful, drop the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import parsing
from rankloom.functions.hashing import salted_hash
from rankloom.operators.quality import require_columns
from rankloom.sources import schemas


def hash_column(df: DataFrame, column: str, salt: str, name: str | None = None) -> DataFrame:
    """Replace (or add) the salted digest of one column."""
    digest = salted_hash(F.col(column), salt, df.schema[column].dataType)
    return df.withColumn(name or column, digest)


def anonymise_listings(df: DataFrame, salt: str) -> DataFrame:
    """Drop personal columns, hash ids, keep only the facts derived from host text and licence."""
    sources = ["host_location", "host_about", "license"]
    require_columns(df, [*schemas.PII_DROP, *schemas.HASHED, *sources], "listings")
    for column in schemas.HASHED:
        df = hash_column(df, column, salt)
    df = hash_column(df, "license", salt, "license_hash")
    return (
        df.withColumn("host_is_local", parsing.host_is_local(F.col("host_location")))
        .withColumn("host_has_about", parsing.is_present(F.col("host_about")))
        .withColumn("license_status", parsing.license_status(F.col("license")))
        .drop(*schemas.PII_DROP, *sources)
    )


def anonymise_calendar(df: DataFrame, salt: str) -> DataFrame:
    """Hash the listing id."""
    require_columns(df, ["listing_id"], "calendar")
    return hash_column(df, "listing_id", salt)


def anonymise_reviews(df: DataFrame, salt: str) -> DataFrame:
    """Drop the reviewer, hash the listing id; the review id and text stay."""
    require_columns(df, ["listing_id", *schemas.REVIEWS_PII_DROP], "reviews")
    return hash_column(df, "listing_id", salt).drop(*schemas.REVIEWS_PII_DROP)
