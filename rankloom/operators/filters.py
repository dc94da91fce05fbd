"""Removal of dead and implausible items, with counts per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import ordering

MAX_MINIMUM_NIGHTS = 30
DORMANT_BLOCKED_SHARE = 0.99
MAX_PRICE_MULTIPLE = 20
PRICE_STRATUM = ("city", "room_type", "accommodates")


def is_inactive(reviews: Column, blocked: Column) -> Column:
    """Nothing ever reviewed and nothing on offer in the window."""
    return (reviews == 0) & (blocked == 1.0)


def is_long_term(minimum_nights: Column, threshold: int = MAX_MINIMUM_NIGHTS) -> Column:
    """A stay minimum above the threshold."""
    return minimum_nights > threshold


def is_dormant(blocked_calendar: Column, share: float = DORMANT_BLOCKED_SHARE) -> Column:
    """Blocked for essentially the whole calendar."""
    return blocked_calendar >= share


def with_stratum_median(
    df: DataFrame, price: str = "price", stratum: Sequence[str] = PRICE_STRATUM,
    name: str = "_stratum_median",
) -> DataFrame:
    """Median price of each row's stratum; a null key has no stratum."""
    keyed = df
    for column in stratum:
        keyed = keyed.filter(F.col(column).isNotNull())
    return ordering.attach(df, ordering.group_median(keyed, stratum, price, name), list(stratum))


def is_extreme_price(price: Column, median: Column, multiple: float = MAX_PRICE_MULTIPLE) -> Column:
    """Price far above its stratum's median; null is never flagged."""
    return F.coalesce(price > median * multiple, F.lit(False))


def flag_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One boolean column per rule (null counts as not flagged)."""
    return df.withColumns(
        {f"_rule_{name}": F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    )


def rule_counts(flagged: DataFrame, rules: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per ``by``: rows, rows per rule, rows under several rules, removed and kept."""
    hits = sum((F.col(f"_rule_{r}").cast("int") for r in rules), F.lit(0))
    removed = F.count(F.when(hits > 0, 1))
    return flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(f"_rule_{r}"), 1)).alias(r) for r in rules],
        F.count(F.when(hits > 1, 1)).alias("multi_rule"),
        removed.alias("removed"),
        (F.count(F.lit(1)) - removed).alias("kept"),
    )


def apply_rules(
    df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ("city",)
) -> tuple[DataFrame, DataFrame]:
    """Independent rules over the same input: ``(rows no rule flags, counts)``."""
    flagged = flag_rows(df, rules)
    names = list(rules)
    any_rule = F.lit(False)
    for name in names:
        any_rule = any_rule | F.col(f"_rule_{name}")
    kept = flagged.filter(~any_rule).select(*df.columns)
    return kept, rule_counts(flagged, names, by)


def filter_listings(
    df: DataFrame,
    threshold: int = MAX_MINIMUM_NIGHTS,
    blocked_share: float = DORMANT_BLOCKED_SHARE,
    price_multiple: float = MAX_PRICE_MULTIPLE,
) -> tuple[DataFrame, DataFrame]:
    """The four listing rules: ``(kept, counts per city)``."""
    priced = with_stratum_median(df)
    kept, counts = apply_rules(
        priced,
        {
            "inactive": is_inactive(F.col("number_of_reviews"), F.col("blocked_fraction_90")),
            "long_term": is_long_term(F.col("minimum_nights"), threshold),
            "dormant": is_dormant(F.col("blocked_fraction_calendar"), blocked_share),
            "extreme_price": is_extreme_price(
                F.col("price"), F.col("_stratum_median"), price_multiple
            ),
        },
    )
    return kept.drop("_stratum_median"), counts
