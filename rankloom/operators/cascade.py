"""Fallback cascades over ever coarser keys: median imputation and search groups.

Both cascades run on small tables of key combinations, not on rows. Rows are aggregated once to
the finest key, the rungs are worked out there, and the answer is joined back once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.bins import capacity_tier
from rankloom.operators import ordering, quality

MIN_GROUP_SIZE = 5
# The two cascades of the listing pipeline, coarsest last.
PRICE_CASCADE = (
    ("nbhd_room_accommodates", ("city", "neighbourhood_cleansed", "room_type", "accommodates")),
    ("nbhd_room_tier", ("city", "neighbourhood_cleansed", "room_type", "capacity_tier")),
    ("nbhd_room", ("city", "neighbourhood_cleansed", "room_type")),
    ("city_room", ("city", "room_type")),
    ("city", ("city",)),
)
GROUP_CASCADE = (
    ("nbhd_room_tier", ("city", "neighbourhood_cleansed", "room_type", "capacity_tier")),
    ("city_room_tier", ("city", "room_type", "capacity_tier")),
    ("city_room", ("city", "room_type")),
)
CLUSTER_KEY = ("host_id", "latitude", "longitude", "accommodates")


def with_capacity_tier(df: DataFrame, accommodates: str = "accommodates") -> DataFrame:
    """Add the tier the cascades key on."""
    return df.withColumn("capacity_tier", capacity_tier(F.col(accommodates)))


def impute_by_cascade(
    df: DataFrame,
    value: str,
    cascade: Sequence[tuple[str, Sequence[str]]],
    rung: str | None = None,
) -> DataFrame:
    """Fill nulls of ``value`` with the median of the first rung that has one.

    Medians are of the original values. A null key has no median at that rung. ``rung`` names an
    optional column holding the rung that filled the row.
    """
    finest = list(dict.fromkeys(c for _, keys in cascade for c in keys))
    hist, size = ordering.session.measured(ordering.histogram(df, finest, value))
    combos = df.filter(F.col(value).isNull()).select(*finest).distinct()
    for i, (_, keys) in enumerate(cascade):
        rolled = hist
        for key in keys:
            rolled = rolled.filter(F.col(key).isNotNull())
        rolled = rolled.groupBy(*keys, value).agg(F.sum("_n").alias("_n"))
        medians = ordering.quantiles(
            rolled, list(keys), value, {f"_m{i}": 0.5}, at_most=size
        )
        combos = combos.join(medians, list(keys), "left")
    filled = F.coalesce(*[F.col(f"_m{i}") for i in range(len(cascade))])
    named = F.coalesce(
        *[F.when(F.col(f"_m{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(cascade)]
    )
    combos = combos.select(*finest, filled.alias("_fill"), named.alias("_rung"))
    out = ordering.attach(df, combos, finest)
    was_null = F.col(value).isNull()
    if rung is not None:
        out = out.withColumn(rung, F.when(was_null, F.col("_rung")))
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("_fill"))).drop(
        "_fill", "_rung"
    )


def impute_report(
    imputed: DataFrame, rung: str, cascade: Sequence[tuple[str, Sequence[str]]],
    value: str, by: Sequence[str],
) -> DataFrame:
    """Per ``by``: rows, missing, ``filled_<rung>`` and rows nothing could fill."""
    return imputed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(rung).isNotNull() | F.col(value).isNull(), 1)).alias("missing"),
        *[F.count(F.when(F.col(rung) == n, 1)).alias(f"filled_{n}") for n, _ in cascade],
        F.count(F.when(F.col(value).isNull(), 1)).alias("unresolved"),
    )


def impute_price(
    df: DataFrame,
    cascade: Sequence[tuple[str, Sequence[str]]] = PRICE_CASCADE,
    value: str = "price",
    by: Sequence[str] = ("city",),
) -> tuple[DataFrame, DataFrame]:
    """Impute and report; stops when a value is still missing after the last rung.

    Which rung filled a row is reported in counts only: a per-row marker would tell the model that
    the value had been missing.
    """
    filled = impute_by_cascade(df, value, cascade, rung="_filled_by")
    report, _ = ordering.session.measured(impute_report(filled, "_filled_by", cascade, value, by))
    quality.require(
        report, {f"{value} is still null after rung {cascade[-1][0]}": F.col("unresolved") > 0}
    )
    return filled.drop("_filled_by"), report.drop("unresolved")


def settle_groups(
    df: DataFrame,
    cascade: Sequence[tuple[str, Sequence[str]]] = GROUP_CASCADE,
    minimum: int = MIN_GROUP_SIZE,
    partition: Sequence[str] = (),
) -> DataFrame:
    """One row per finest key: the rung it settled at and the key it settled on.

    A group under ``minimum`` is dissolved; its members are re-keyed at the next rung among
    themselves, never added to a healthy group. The last rung takes whatever is left. Null keys
    form their own groups.
    """
    if not cascade:
        raise quality.CheckFailed("an empty cascade assigns no group")
    for name, keys in cascade:
        dropped = sorted(set(partition) - set(keys))
        if dropped:
            raise quality.CheckFailed(f"rung {name!r} drops {dropped}, which the grades rely on")
    finest = list(dict.fromkeys(c for _, keys in cascade for c in keys))
    pending, bound = ordering.session.measured(
        df.groupBy(*finest).agg(F.count(F.lit(1)).alias("_rows"))
    )
    settled = None
    for i, (name, keys) in enumerate(cascade):
        size = F.sum("_rows").alias("_size")
        keyed = ordering.with_group_stats(pending, list(keys), [size], at_most=bound)
        done = F.lit(True) if i == len(cascade) - 1 else F.col("_size") >= minimum
        blanks = [
            (F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType)).alias(f"_g_{c}")
            for c in finest
        ]
        here = keyed.filter(done).select(
            *finest, "_rows", "_size", F.lit(i).alias("_level"), F.lit(name).alias("rung"), *blanks
        )
        settled = here if settled is None else settled.unionByName(here)
        pending = keyed.filter(~done).drop("_size")
    return settled


def query_group(
    df: DataFrame,
    cascade: Sequence[tuple[str, Sequence[str]]] = GROUP_CASCADE,
    minimum: int = MIN_GROUP_SIZE,
    partition: Sequence[str] = (),
    name: str = "query_group",
) -> tuple[DataFrame, DataFrame]:
    """Search groups: ``(rows with a dense group id, report per rung)``."""
    settled, bound = ordering.session.measured(settle_groups(df, cascade, minimum, partition))
    finest = list(dict.fromkeys(c for _, keys in cascade for c in keys))
    group_key = ["_level", *[f"_g_{c}" for c in finest]]
    ids = ordering.dense_ids(settled, group_key, name, at_most=bound)
    numbered = ordering.attach(settled, ids, group_key, at_most=bound)
    numbered = ordering.session.stage(numbered)
    rows = ordering.attach(df, numbered.select(*finest, name), finest, at_most=bound)
    return rows, rung_report(numbered, cascade, minimum, name, at_most=bound)


def rung_report(
    numbered: DataFrame,
    cascade,
    minimum: int,
    name: str = "query_group",
    at_most: int | None = None,
) -> DataFrame:
    """Per rung: key, rows settled, groups, singletons, groups under the minimum, median size."""
    groups = numbered.groupBy("rung", "_level", name).agg(F.sum("_rows").alias("_size"))
    medians = ordering.group_median(
        groups, ["rung"], "_size", "median_size", at_most=at_most
    )
    keys = F.create_map(*[F.lit(x) for n, k in cascade for x in (n, " x ".join(k))])
    counted = groups.groupBy("rung", "_level").agg(
        F.sum("_size").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(F.col("_size") == 1, 1)).alias("singletons"),
        F.count(F.when(F.col("_size") < minimum, 1)).alias("under_minimum"),
    )
    return counted.join(medians, "rung", "left").select(
        "rung", keys[F.col("rung")].alias("key"), "n", "groups", "singletons", "under_minimum",
        "median_size",
    )


def cluster_keys(
    df: DataFrame, host: str, lat: str, lon: str, capacity: str, places: int = 4
) -> DataFrame:
    """Add the near-twin key: same host, same point (to ``places`` decimals), same capacity."""
    return df.withColumns(
        {
            "_c_host": F.col(host),
            "_c_lat": F.bround(F.col(lat), places),
            "_c_lon": F.bround(F.col(lon), places),
            "_c_cap": F.col(capacity),
        }
    )


def cluster_id(
    df: DataFrame,
    host: str = "host_id",
    lat: str = "latitude",
    lon: str = "longitude",
    capacity: str = "accommodates",
    name: str = "cluster_id",
    size: str | None = None,
) -> DataFrame:
    """Dense near-twin id per row (and optionally the cluster's size). Null keys match each other."""
    keyed = cluster_keys(df, host, lat, lon, capacity)
    key = ["_c_host", "_c_lat", "_c_lon", "_c_cap"]
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    sizes, bound = ordering.session.measured(sizes)
    ids = ordering.running_total(
        sizes, [], [F.col(c).asc_nulls_first() for c in key], before=name, at_most=bound
    )
    if size is not None:
        ids = ids.withColumnRenamed("_size", size)
    else:
        ids = ids.drop("_size")
    return ordering.attach(keyed, ids, key, at_most=bound).drop(*key)
