"""Review-history windows and ratings, all strictly before each item's own anchor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.parsing import days_before
from rankloom.operators import ordering, quality

WINDOW_DAYS = 90
SEASON_LAG_DAYS = 365
SHRINKAGE_K = 20
PASSTHROUGH = (
    "number_of_reviews", "number_of_reviews_ltm", "reviews_per_month", "review_scores_accuracy",
    "review_scores_cleanliness", "review_scores_checkin", "review_scores_communication",
    "review_scores_location", "review_scores_value",
)


def events_in_windows(
    events: DataFrame,
    anchors: DataFrame,
    event_key: str,
    event_date: str,
    anchor_key: str,
    anchor: str,
    windows: dict[str, tuple[int, int]],
) -> DataFrame:
    """Events per anchor inside several windows ``{name: (days before the anchor, width)}``.

    Windows are half-open, ``[T - lag, T - lag + width)``. Every anchor gets a row, with 0 where
    nothing fell inside. Events are first counted per (key, day), so a hot key joins as at most
    one row per day.
    """
    daily = (
        events.filter(F.col(event_date).isNotNull())
        .groupBy(F.col(event_key).alias("_k"), F.to_date(event_date).alias("_d"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    keyed = anchors.select(F.col(anchor_key).alias("_a"), F.col(anchor).alias("_T"))
    earliest = max(lag for lag, _ in windows.values())
    latest = max(width - lag for lag, width in windows.values())
    joined = daily.join(
        keyed,
        (F.col("_k") == F.col("_a"))
        & (F.col("_d") >= F.date_sub("_T", earliest))
        & (F.col("_d") < F.date_add("_T", latest)),
    )

    def inside(lag: int, width: int):
        opens = F.date_sub(F.col("_T"), lag)
        return (F.col("_d") >= opens) & (F.col("_d") < F.date_add(opens, width))

    counted = joined.groupBy("_a").agg(
        *[
            F.sum(F.when(inside(lag, width), F.col("_n")).otherwise(0)).alias(name)
            for name, (lag, width) in windows.items()
        ]
    )
    out = anchors.join(
        counted.withColumnRenamed("_a", anchor_key), anchor_key, "left"
    )
    return out.withColumns(
        {name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in windows}
    )


def reviews_in_window(
    reviews: DataFrame,
    anchors: DataFrame,
    window_days: int = WINDOW_DAYS,
    starts_days_before: int = SEASON_LAG_DAYS,
    name: str | None = None,
    event_key: str = "listing_id",
    event_date: str = "date",
    anchor_key: str = "listing_id",
    anchor: str = "T",
    check: bool = True,
) -> DataFrame:
    """Reviews per anchor in one window. ``check`` stops on duplicate anchors or no match at all."""
    name = name or f"reviews_w{window_days}_lag{starts_days_before}"
    if check:
        twice = anchors.groupBy(anchor_key).agg(F.count(F.lit(1)).alias("times"))
        quality.require(twice, {f"duplicate {anchor_key} among the anchors": F.col("times") > 1})
        known = reviews.join(
            anchors.select(F.col(anchor_key).alias(event_key)), event_key, "left_semi"
        )
        if not known.take(1) and reviews.take(1) and anchors.take(1):
            raise quality.CheckFailed("no review resolves against the anchors: every count would be 0")
    return events_in_windows(
        reviews, anchors, event_key, event_date, anchor_key, anchor,
        {name: (starts_days_before, window_days)},
    )


def same_season_last_year(reviews: DataFrame, anchors: DataFrame, **columns) -> DataFrame:
    """Reviews in the same season one year before the anchor."""
    return reviews_in_window(
        reviews, anchors, WINDOW_DAYS, SEASON_LAG_DAYS, "reviews_same_season_ly", **columns
    )


def rating_shrunk(
    df: DataFrame,
    city: str = "city",
    reviews: str = "number_of_reviews",
    rating: str = "review_scores_rating",
    k: float = SHRINKAGE_K,
    name: str = "rating_shrunk",
) -> DataFrame:
    """Pull each rating toward the mean of the *other* ratings of its city, by its evidence.

    An unrated row gets the city mean. Where no other rating exists there is no prior: null.
    """
    totals = (
        df.filter(F.col(city).isNotNull())
        .groupBy(city)
        .agg(F.sum(rating).alias("_sum"), F.count(rating).alias("_count"))
    )
    out = ordering.attach(df, totals, [city])
    own = F.coalesce(F.col(rating).cast("double"), F.lit(0.0))
    rated = F.col(rating).isNotNull()
    prior = F.try_divide(F.col("_sum") - own, F.col("_count") - rated.cast("int"))
    evidence = F.when(rated, F.col(reviews)).otherwise(0).cast("double")
    shrunk = (evidence * own + F.lit(float(k)) * prior) / (evidence + F.lit(float(k)))
    return out.withColumn(name, shrunk).drop("_sum", "_count")


def review_features(df: DataFrame, reviews: DataFrame | None = None, k: float = SHRINKAGE_K):
    """Add the derived review columns to rows that carry ``id``, ``T`` and the raw review facts."""
    quality.require_columns(
        df, ["id", "T", "city", "first_review", "last_review", "review_scores_rating", *PASSTHROUGH],
        "ranked rows",
    )
    out = rating_shrunk(df, k=k).withColumns(
        {
            "has_reviews": F.col("number_of_reviews") > 0,
            "listing_age_days": days_before(F.col("T"), F.col("first_review")),
            "days_since_last_review": days_before(F.col("T"), F.col("last_review")),
        }
    )
    if reviews is None:
        return out
    counted = same_season_last_year(
        reviews, df.select(F.col("id").alias("listing_id"), "T")
    ).select(F.col("listing_id").alias("id"), "reviews_same_season_ly")
    return out.join(counted, "id", "left")


def review_date_rules() -> dict:
    """Counted, not fatal: reviews dated after the anchor."""
    return {
        "first review after its own T": F.col("listing_age_days") < 0,
        "last review after its own T": F.col("days_since_last_review") < 0,
        "reviews without a rating": (F.col("number_of_reviews") > 0)
        & F.col("review_scores_rating").isNull(),
    }


def review_columns(same_season: bool) -> Sequence[str]:
    """The review block in order."""
    extra = ("has_reviews", "rating_shrunk", "listing_age_days", "days_since_last_review")
    return (*PASSTHROUGH, *extra, *(("reviews_same_season_ly",) if same_season else ()))
