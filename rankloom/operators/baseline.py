"""The two frozen reference rankers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ordering, quality

PRICE_RATING_WEIGHT = 0.5


def rank_by_reviews(df: DataFrame, reviews: str = "number_of_reviews", name: str = "reviews"):
    """Score by lifetime review count."""
    return df.withColumn(name, F.col(reviews).cast("double"))


def rank_by_price_and_rating(
    df: DataFrame,
    group: Sequence[str],
    price: str = "price",
    rating: str = "rating_shrunk",
    weight: float = PRICE_RATING_WEIGHT,
    name: str = "price_rating",
    check: bool = True,
) -> DataFrame:
    """``weight * pct(rating) - (1 - weight) * pct(price)`` inside the group, ties averaged."""
    if check:
        quality.require(
            df,
            {f"{c} is null": F.col(c).isNull() for c in (price, rating)},
        )
    out = ordering.average_rank(df, group, rating, "_r", share="_rating_pct")
    out = ordering.average_rank(out, group, price, "_p", share="_price_pct")
    score = F.lit(weight) * F.col("_rating_pct") - F.lit(1 - weight) * F.col("_price_pct")
    return out.withColumn(name, score).drop("_r", "_p", "_rating_pct", "_price_pct")
