"""Distances to anchors and to the rest of the neighbourhood, and local density."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import session
from rankloom.functions.geo import EARTH_RADIUS_KM, east_km, haversine_km, north_km
from rankloom.operators import ordering, quality
from rankloom.operators.neighbourhood import NEIGHBOURHOOD_KEY
from rankloom.sources.schemas import ANCHORS

DISTANCE_PRECISION = 2
DENSITY_RADIUS_KM = 1.0
#: Distinct points of a cell that is compared point by point.
LEAF_POINTS = 32
#: Distinct anchors of a cube that are offered to the places near it one by one.
LEAF_ANCHORS = 64
#: Cells are cut no further: a thousandth of a millionth of the radius.
DEEPEST = 30


def nearest_anchor(
    df: DataFrame,
    anchors: Mapping[str, Sequence[tuple[str, float, float]]] = ANCHORS,
    market: str = "city",
    lat: str = "latitude",
    lon: str = "longitude",
    name: str = "km_to_nearest_anchor",
    check: bool = True,
) -> DataFrame:
    """Distance to the closest anchor of the row's own market.

    Anchors are a handful of constants, so they become one column expression: no join at all.
    ``check`` stops the run for a market without anchors.
    """
    if check:
        known = list(anchors)
        quality.require(
            df, {"market without an anchor set": ~F.coalesce(F.col(market).isin(*known), F.lit(False))}
        )
    nearest = None
    for place, points in anchors.items():
        distances = [
            haversine_km(F.col(lat), F.col(lon), F.lit(a), F.lit(b)) for _, a, b in points
        ]
        closest = distances[0] if len(distances) == 1 else F.least(*distances)
        here = F.col(market) == place
        nearest = F.when(here, closest) if nearest is None else nearest.when(here, closest)
    return df.withColumn(name, F.bround(nearest, DISTANCE_PRECISION))


def in_space(lat: str, lon: str) -> dict[str, Column]:
    """A position as km from the centre of the earth. Straight lines order pairs of places as great
    circles do, and space has neither a seam at 180 degrees nor poles."""
    north, east = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    radius = F.lit(EARTH_RADIUS_KM)
    return {"_x": radius * F.cos(north) * F.cos(east), "_y": radius * F.cos(north) * F.sin(east),
            "_z": radius * F.sin(north)}


def cube_at(level: int | Column) -> list[Column]:
    """The cube of a place at a level; cubes nest exactly, because they are halved by powers of two."""
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return [F.floor(F.col(u) * scale).alias(c) for u, c in (("_u", "_cx"), ("_v", "_cy"), ("_w", "_cz"))]


def _cubes(places: DataFrame, level: int, side: str) -> DataFrame:
    """Cubes that hold anything, named by the side (``t``, ``s``) they have in a pair, with their distinct places."""
    return places.groupBy("_m", *cube_at(level)).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_m").alias(f"_{side}m"), F.col("_cx").alias(f"_{side}x"), F.col("_cy").alias(f"_{side}y"),
        F.col("_cz").alias(f"_{side}z"), F.col("_n").alias(f"_{side}n"))


def _within_bound(pairs: DataFrame, level: int, leaf_anchors: int) -> DataFrame:
    """Pairs of cubes that may hold a nearest anchor, staged. ``_bound``: some anchor is at least so near to all
    places of the target cube (squared, in sides of a cube), the best of its own pairs and its parents'."""
    apart = [F.abs(F.col(f"_t{c}") - F.col(f"_s{c}")).cast("double") for c in "xyz"]
    least = sum((F.pow(F.greatest(d - 1, F.lit(0.0)), F.lit(2)) for d in apart), F.lit(0.0))
    most = sum((F.pow(d + 1, F.lit(2)) for d in apart), F.lit(0.0))
    target = Window.partitionBy("_tm", "_tx", "_ty", "_tz")
    bounded = pairs.withColumn("_bound", F.least(F.col("_bound") * 4, F.min(most).over(target)))
    leaf = (F.col("_sn") <= leaf_anchors) | F.lit(level >= DEEPEST)
    return session.stage(bounded.filter(least <= F.col("_bound") * (1 + 1e-9)).select(
        F.col("_tm").alias("_m"), F.lit(level).alias("_level"), "_tx", "_ty", "_tz", "_sx", "_sy", "_sz",
        "_bound", leaf.alias("_leaf")))


def nearest_candidates(targets: DataFrame, spots: DataFrame, leaf_anchors: int = LEAF_ANCHORS) -> list[DataFrame]:
    """Pairs of cubes, a table per level, whose leaves hold a nearest anchor of every target place.

    Both frames hold distinct places: a market ``_m`` and ``_u, _v, _w`` in [0, 1). A pair is dropped as
    soon as another anchor is surely nearer to the whole target cube, is a leaf when few anchors are left
    in it, and is cut in eight on both sides otherwise.
    """
    first = _cubes(targets, 0, "t").join(_cubes(spots, 0, "s"), F.col("_tm") == F.col("_sm"))
    tables = [_within_bound(first.withColumn("_bound", F.lit(float("inf"))), 0, leaf_anchors)]
    while not tables[-1].filter("NOT _leaf").isEmpty():
        level = len(tables)
        cut = tables[-1].filter("NOT _leaf").select("_bound", F.col("_m").alias("_pm"), *[
            F.col(f"_{side}{c}").alias(f"_p{side}{c}") for side in "ts" for c in "xyz"])
        pairs = cut
        for side, places in (("t", targets), ("s", spots)):
            inside = F.col("_pm") == F.col(f"_{side}m")
            for c in "xyz":
                inside &= F.col(f"_p{side}{c}") == F.shiftright(f"_{side}{c}", 1)
            pairs = pairs.join(_cubes(places, level, side), inside)
        tables.append(_within_bound(pairs, level, leaf_anchors))
    return tables


def nearest_of_table(
    df: DataFrame,
    anchors: DataFrame,
    market: str,
    anchor_market: str,
    lat: str,
    lon: str,
    anchor_lat: str,
    anchor_lon: str,
    name: str = "km_to_nearest_anchor",
    leaf_anchors: int = LEAF_ANCHORS,
) -> DataFrame:
    """The same for anchors held in a table, of any number.

    Rows at one place collapse first. Each market is a cube in space, cut where it has to be (see
    :func:`nearest_candidates`), so a place meets the few anchors near its own bound and never all
    anchors of its market. Rows without a market, a position or an anchor in their market get null.
    """
    def placed(rows: DataFrame, side: str, *columns: str) -> DataFrame:
        of, north, east = columns
        known = F.col(of).isNotNull()
        for c in (north, east):
            known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        found = rows.filter(known).groupBy(
            F.col(of).alias("_m"), F.col(north).cast("double").alias("_lat"), F.col(east).cast("double").alias("_lon"))
        return found.agg(F.count(F.lit(1)).alias("_here")).withColumn("_side", F.lit(side)).withColumns(in_space("_lat", "_lon"))

    places = placed(df, "t", market, lat, lon).unionByName(placed(anchors, "s", anchor_market, anchor_lat, anchor_lon))
    places = ordering.with_group_stats(
        places, ["_m"], [f(c).alias(f"{c}{end}") for c in ("_x", "_y", "_z") for f, end in ((F.min, "0"), (F.max, "1"))])
    span = F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in ("_x", "_y", "_z")], F.lit(1e-9)) * (1 + 1e-9)
    places, rows = session.measured(places.select(
        "_side", "_m", "_lat", "_lon", "_here",
        *[((F.col(c) - F.col(f"{c}0")) / span).alias(u) for c, u in (("_x", "_u"), ("_y", "_v"), ("_z", "_w"))]))
    targets, spots = places.filter("_side = 't'"), places.filter("_side = 's'")
    tables = nearest_candidates(targets, spots, leaf_anchors)
    leaves = tables[0].filter("_leaf")
    for table in tables[1:]:
        leaves = leaves.unionByName(table.filter("_leaf"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1)))

    def at_levels(side: DataFrame) -> DataFrame:
        standing = session.spread(side, rows * len(tables), "_m", "_lat", "_lon").withColumn("_at", levels)
        return standing.select(F.col("_m").alias("_pm"), "_lat", "_lon", "_at", *cube_at(F.col("_at")))

    def inside(side: str) -> Column:
        return ((F.col("_pm") == F.col("_m")) & (F.col("_at") == F.col("_level")) & (F.col("_cx") == F.col(f"_{side}x"))
                & (F.col("_cy") == F.col(f"_{side}y")) & (F.col("_cz") == F.col(f"_{side}z")))

    offered = at_levels(spots).join(leaves, inside("s")).select(
        "_m", "_level", "_tx", "_ty", "_tz", F.col("_lat").alias("_alat"), F.col("_lon").alias("_alon"))
    offered, size = session.measured(offered)
    offered = F.broadcast(offered) if size <= session.BROADCAST_ROWS else offered.hint("merge")
    met = at_levels(targets).join(offered, inside("t"))
    distance = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_alat"), F.col("_alon"))
    nearest = met.groupBy(F.col("_pm").alias("_m"), "_lat", "_lon").agg(
        F.bround(F.min(distance), DISTANCE_PRECISION).alias(name))
    nearest = targets.join(nearest, ["_m", "_lat", "_lon"]).select("_m", "_lat", "_lon", "_here", name)
    keyed = df.withColumns({"_m": F.col(market), "_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    return ordering.attach(keyed, nearest, ["_m", "_lat", "_lon"], size="_here").select(*df.columns, name)


def centroid_distance(
    df: DataFrame,
    group: Sequence[str] = NEIGHBOURHOOD_KEY,
    lat: str = "latitude",
    lon: str = "longitude",
    name: str = "km_to_neighbourhood_centroid",
    places: int | None = DISTANCE_PRECISION,
) -> DataFrame:
    """Distance to the centroid of the *other* rows of the group; null for a lone row."""
    out = ordering.with_group_stats(
        df,
        group,
        [
            F.sum(lat).alias("_lat"),
            F.sum(lon).alias("_lon"),
            F.count(F.lit(1)).alias("_n"),
        ],
    )
    others = F.nullif(F.col("_n") - 1, F.lit(0).cast("long"))
    distance = haversine_km(
        F.col(lat),
        F.col(lon),
        (F.col("_lat") - F.col(lat)) / others,
        (F.col("_lon") - F.col(lon)) / others,
    )
    rounded = distance if places is None else F.bround(distance, places)
    return out.withColumn(name, rounded).drop("_lat", "_lon", "_n")


def cells_of(points: DataFrame, market: str, level: int) -> DataFrame:
    """Cells of side ``radius / 2 ** level`` with their distinct points and the rows at them."""
    return points.groupBy(market, *cell_at(level)).agg(
        F.count(F.lit(1)).alias("_points"), F.sum("_here").alias("_rows"))


def cell_at(level: int | str) -> list[Column]:
    """The cell of a point at a level. Coordinates are scaled by powers of two, so cells nest exactly."""
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else F.col(level))
    return [F.floor(F.col(u) * scale).alias(c) for u, c in (("_u", "_cx"), ("_v", "_cy"))]


def _sides(cells: DataFrame, market: str) -> tuple[DataFrame, DataFrame]:
    """Cells as targets (``_t``) and as sources (``_s``) of a pair."""
    target = cells.select(
        F.col(market).alias("_m"), F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"),
        F.col("_points").alias("_t_points"))
    source = cells.select(
        F.col(market).alias("_sm"), F.col("_cx").alias("_sx"), F.col("_cy").alias("_sy"),
        F.col("_points").alias("_s_points"), F.col("_rows").alias("_s_rows"))
    return target, source


def _judged(pairs: DataFrame, level: int, leaf_points: int) -> DataFrame:
    """Pairs of cells with what becomes of them: all within the radius, few enough to compare, or to be cut.

    Pairs with nothing within the radius are gone. Cells are half-open, so two points differ by more than
    the cells between theirs and by less than one cell more on each side.
    """
    dx, dy = F.abs(F.col("_tx") - F.col("_sx")), F.abs(F.col("_ty") - F.col("_sy"))
    zero = F.lit(0).cast("long")
    nearest = F.pow(F.greatest(dx - 1, zero), F.lit(2)) + F.pow(F.greatest(dy - 1, zero), F.lit(2))
    farthest = F.pow(dx + 1, F.lit(2)) + F.pow(dy + 1, F.lit(2))
    few = (F.col("_t_points") <= leaf_points) & (F.col("_s_points") <= leaf_points)
    fate = F.when(farthest <= 4**level, "whole").when(few | F.lit(level >= DEEPEST), "leaf").otherwise("cut")
    return session.stage(pairs.filter(nearest < 4**level).select(
        "_m", F.lit(level).alias("_level"), "_tx", "_ty", "_sx", "_sy", "_s_rows", fate.alias("_fate")))


def cell_pairs(points: DataFrame, market: str, leaf_points: int) -> list[DataFrame]:
    """Every pair of places within the radius is in exactly one pair of cells: a table per level.

    Both cells of a pair are cut into quarters until one lies within the radius of all of the other or
    both hold at most ``leaf_points`` points. Where points are sparse the first level does; a dense
    place is cut as often as it takes, and only there.
    """
    target, source = _sides(cells_of(points, market, 0), market)
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = (target.withColumn("_dx", steps).withColumn("_dy", steps))
    pairs = around.join(
        source, F.col("_m").eqNullSafe(F.col("_sm")) & (F.col("_tx") + F.col("_dx") == F.col("_sx"))
        & (F.col("_ty") + F.col("_dy") == F.col("_sy")))
    tables = [_judged(pairs, 0, leaf_points)]
    while not tables[-1].filter("_fate = 'cut'").isEmpty():
        level = len(tables)
        cut = tables[-1].filter("_fate = 'cut'").select(
            F.col("_m").alias("_pm"), F.col("_tx").alias("_ptx"), F.col("_ty").alias("_pty"),
            F.col("_sx").alias("_psx"), F.col("_sy").alias("_psy"))
        target, source = _sides(session.stage(cells_of(points, market, level)), market)
        pairs = cut.join(
            target, F.col("_pm").eqNullSafe(F.col("_m")) & (F.shiftright("_tx", 1) == F.col("_ptx"))
            & (F.shiftright("_ty", 1) == F.col("_pty"))
        ).join(
            source, F.col("_pm").eqNullSafe(F.col("_sm")) & (F.shiftright("_sx", 1) == F.col("_psx"))
            & (F.shiftright("_sy", 1) == F.col("_psy")))
        tables.append(_judged(pairs, level, leaf_points))
    return tables


def density(
    df: DataFrame,
    market: str = "city",
    lat: str = "latitude",
    lon: str = "longitude",
    radius_km: float = DENSITY_RADIUS_KM,
    name: str | None = None,
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """How many other rows of the market lie within ``radius_km`` of each row.

    Rows at one point collapse to a count first, so a point holding a third of the table is a single
    row here. The plane is cut by an adaptive quadtree (see :func:`cell_pairs`): pairs of cells that lie
    wholly within the radius contribute counts, and points meet only in pairs of small cells along it. Rows
    without a position have no density (null).
    """
    name = name or f"density_{radius_km:g}km"
    points = (
        df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(market, lat, lon)
        .agg(F.count(F.lit(1)).alias("_here"))
    )
    weighted = F.sum(F.col(lat) * F.col("_here")) / F.sum("_here")
    points = ordering.with_group_stats(points, [market], [weighted.alias("_ref")])
    points = points.withColumns(
        {"_x": east_km(F.col(lon), F.col("_ref")), "_y": north_km(F.col(lat))}
    ).withColumns({"_u": F.col("_x") / F.lit(radius_km), "_v": F.col("_y") / F.lit(radius_km)})
    points, rows = session.measured(points.drop("_ref").withColumn("_id", F.monotonically_increasing_id()))

    tables = cell_pairs(points, market, leaf_points)
    pairs = tables[0]
    for table in tables[1:]:
        pairs = pairs.unionByName(table)
    levels = F.sequence(F.lit(0), F.lit(len(tables) - 1))
    # A point stands in one cell of each level that there are pairs of.
    placed = session.spread(points, rows * len(tables), "_id").withColumn("_at", F.explode(levels))
    placed = placed.select("_id", market, "_x", "_y", "_u", "_v", "_here", "_at", *cell_at("_at"))

    def inside(side: str) -> Column:
        return (F.col(market).eqNullSafe(F.col("_m")) & (F.col("_at") == F.col("_level"))
                & (F.col("_cx") == F.col(f"_{side}x")) & (F.col("_cy") == F.col(f"_{side}y")))

    whole = pairs.filter("_fate = 'whole'").groupBy("_m", "_level", "_tx", "_ty").agg(F.sum("_s_rows").alias("_n"))
    counted = placed.join(whole, inside("t")).select("_id", "_n")
    leaf = pairs.filter("_fate = 'leaf'").select("_m", "_level", "_tx", "_ty", "_sx", "_sy")
    # A point and a cell that it is too far from do not meet: least distance to the cell, in radii.
    side = F.pow(F.lit(2.0), -F.col("_level"))
    off = [F.greatest(F.col(c) * side - F.col(u), F.col(u) - (F.col(c) + 1) * side, F.lit(0.0))
           for u, c in (("_u", "_sx"), ("_v", "_sy"))]
    met = placed.join(leaf, inside("t")).filter(off[0] * off[0] + off[1] * off[1] <= 1.0 + 1e-9).select(
        "_id", "_x", "_y", "_m", "_level", "_sx", "_sy")
    others = placed.select(
        market, "_at", "_cx", "_cy", F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), F.col("_here").alias("_n"))
    dx, dy = F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy")
    compared = met.join(others, inside("s")).filter(dx * dx + dy * dy <= F.lit(radius_km * radius_km))
    near = counted.unionByName(compared.select("_id", "_n")).groupBy("_id").agg(
        (F.sum("_n") - 1).cast("long").alias(name))
    of_points = points.join(near, "_id").select(market, lat, lon, name, F.col("_here").alias("_size"))
    return ordering.attach(df, of_points, [market, lat, lon], size="_size").drop("_size")


def spatial_features(
    df: DataFrame,
    anchors: Mapping[str, Sequence[tuple[str, float, float]]] = ANCHORS,
    radius_km: float = DENSITY_RADIUS_KM,
) -> DataFrame:
    """All three spatial columns."""
    out = nearest_anchor(df, anchors)
    out = centroid_distance(out)
    return density(out, radius_km=radius_km)


def market_extent(
    df: DataFrame, market: str = "city", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """North-south and east-west size of each market in km."""
    return df.groupBy(market).agg(
        ((F.max(lat) - F.min(lat)) * 111.0).alias("lat_km"),
        ((F.max(lon) - F.min(lon)) * 111.0 * F.cos(F.radians(F.avg(lat)))).alias("lon_km"),
    )


def point_columns(key: Column) -> dict[str, Column]:
    """Spread an integer key over a fixed square of coordinates (for tables without any)."""
    return {
        "latitude": F.lit(37.0) + F.pmod(key * 7919, F.lit(10_000)) / F.lit(20_000.0),
        "longitude": F.lit(23.0) + F.pmod(key * 104_729, F.lit(10_000)) / F.lit(20_000.0),
    }
