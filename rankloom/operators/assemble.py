"""The feature table: blocks side by side on one frame, checked before anyone trains on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import listing, neighbourhood, quality, reviews, spatial
from rankloom.operators.listing import DIAGNOSTIC, IDENTIFIERS, TARGETS
from rankloom.sources.schemas import LABEL_ADJACENT


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Model inputs: neither identifier nor target."""
    return [c for c in columns if c not in (*IDENTIFIERS, *TARGETS)]


def check_feature_table(df: DataFrame) -> dict:
    """Blocked or diagnostic columns, null keys, repeated ids: all fatal. Returns headline counts.

    Group contiguity is a property of how the table is *written* (see
    :func:`rankloom.sources.sinks.write_feature_table`); rows carry their group explicitly.
    """
    quality.require_columns(df, [*IDENTIFIERS, *TARGETS], "feature table")
    for kind, names in (("label-adjacent", LABEL_ADJACENT), ("diagnostic", DIAGNOSTIC)):
        found = sorted(set(df.columns) & set(names))
        if found:
            raise quality.CheckFailed(f"{kind} columns reached the feature table: {found}")
    keys = [*IDENTIFIERS, *TARGETS]
    quality.require(df, {f"{c} is null": F.col(c).isNull() for c in keys})
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    quality.require(per_id, {"repeated id": F.col("_times") > 1})
    sizes = df.groupBy("query_group").agg(F.count(F.lit(1)).alias("_n"))
    counts = sizes.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("query_groups")).first()
    return {
        "rows": counts["rows"] or 0,
        "query_groups": counts["query_groups"],
        "features": len(feature_columns(df.columns)),
    }


def assemble_feature_table(
    ranked: DataFrame,
    review_rows: DataFrame | None = None,
    scheme: str = "buckets",
    vocabulary: Sequence[str] | None = None,
) -> DataFrame:
    """Identifiers, targets and every feature block for the ranked population."""
    quality.require_columns(ranked, [*IDENTIFIERS, *TARGETS], "ranked rows")
    out = listing.listing_features(ranked, scheme, vocabulary)
    block = listing.listing_columns(out.columns)
    out = reviews.review_features(out, review_rows)
    out = neighbourhood.neighbourhood_features(out)
    out = spatial.spatial_features(out)
    columns = [
        *IDENTIFIERS,
        *TARGETS,
        *block,
        *reviews.review_columns(review_rows is not None),
        "nbhd_listings", "nbhd_median_price", "price_vs_nbhd",
        "km_to_nearest_anchor", "km_to_neighbourhood_centroid", "density_1km",
    ]
    return out.select(*columns)
