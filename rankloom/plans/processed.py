"""Raw snapshots to the processed layer: read, anonymise, clean, gate, union, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from rankloom import session
from rankloom.operators import anonymise, cleaning, quality
from rankloom.sources import raw, schemas, sinks


def process_listings(df: DataFrame, city: str, salt: str) -> DataFrame:
    """Anonymised, typed listings of one market; fatal raw values stop here."""
    quality.require(df, cleaning.fatal_listing_rules())
    return cleaning.clean_listings(anonymise.anonymise_listings(df, salt), city)


def process_calendar(df: DataFrame, salt: str) -> DataFrame:
    from pyspark.sql import functions as F

    from rankloom.functions.parsing import unknown_flag

    quality.require(df, {"available: unexpected boolean token": unknown_flag(F.col("available"))})
    return cleaning.clean_calendar(anonymise.anonymise_calendar(df, salt))


def process_reviews(df: DataFrame, salt: str) -> DataFrame:
    return cleaning.clean_reviews(anonymise.anonymise_reviews(df, salt))


def build(
    spark: SparkSession, paths: Mapping[str, Mapping[str, str]], out: str, salt: str
) -> dict[str, DataFrame]:
    """Process every market in ``paths[city][entity]`` and write one table per entity.

    Listings come first: ids must be unique across markets, and at least 99 % of calendar and
    review rows must resolve against the written listings. Returns the written tables.
    """
    from pyspark.sql import functions as F

    listings = quality.union_checked(
        {
            city: process_listings(
                raw.require_ids(raw.load_raw(spark, files["listings"], "listings"), "listings"),
                city, salt,
            )
            for city, files in paths.items()
        }
    )
    listings = session.stage(listings)
    repeated = quality.ids_in_several(listings, "id", "city")
    quality.require(repeated, {"listing ids in several markets": F.col("places") > 1})
    sinks.write_entity(listings, f"{out}/listings")
    tables = {"listings": listings}
    for entity, process in (("calendar", process_calendar), ("reviews", process_reviews)):
        frames = {
            city: process(
                raw.require_ids(raw.load_raw(spark, files[entity], entity), entity), salt
            )
            for city, files in paths.items()
        }
        table = session.stage(quality.union_checked(frames))
        quality.require_join_integrity(table, "listing_id", listings, "id")
        table.write.mode("overwrite").parquet(f"{out}/{entity}")
        tables[entity] = table
    return tables


def snapshot_paths(root: str) -> dict[str, dict[str, str]]:
    """Where each market's files live under a root folder."""
    return {
        city: {entity: raw.raw_path(root, city, entity) for entity in schemas.ENTITIES}
        for city in schemas.SNAPSHOTS
    }
