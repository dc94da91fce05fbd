"""Labels, grades, cascades, windows and spatial features on hand-built frames."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import cascade, filters, label, ordering, reviews, spatial
from rankloom.operators.quality import CheckFailed
from tests.conftest import rows

DAY0 = datetime.date(2026, 6, 29)


def calendar(spark, available, days=365, key="a"):
    data = [(key, DAY0 + datetime.timedelta(days=i), i < available) for i in range(days)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "listing_id string, date date, available boolean")


def test_label_counts_the_first_ninety_days(spark):
    frames = {"a": 0, "b": 45, "c": 90, "d": 9}
    df = None
    for key, n in frames.items():
        part = calendar(spark, n, key=key)
        df = part if df is None else df.unionByName(part)
    out = rows(label.occupancy_label(df), "listing_id")
    assert [out[k]["blocked_fraction_90"] for k in "abcd"] == [1.0, 0.5, 0.0, 0.9]
    assert out["a"]["T"] == DAY0 and out["a"]["calendar_days"] == out["a"]["calendar_span"] == 365
    assert out["b"]["blocked_fraction_calendar"] == pytest.approx(1 - 45 / 365)


def test_short_window_stops_the_run(spark):
    with pytest.raises(CheckFailed, match="a"):
        label.occupancy_label(calendar(spark, 10, days=80))


def test_crosscheck(spark):
    labels = spark.createDataFrame([("a", 45), ("b", 10)], "listing_id string, avail_90 int")
    items = spark.createDataFrame([("a", "x", 45), ("b", "x", 12), ("z", "x", 1)], "id string, city string, availability_90 int")
    out = label.crosscheck_availability(labels, items, "listing_id", "id", ["city"]).first()
    assert (out.n, out.exact_agreement, out.n_mismatched, out.mean_abs_diff) == (2, 0.5, 1, 1.0)


def graded(spark, cells, **options):
    data = [(i, c, r, v) for i, (c, r, v) in enumerate(cells)]
    df = spark.createDataFrame(data, "id int, city string, room_type string, blocked_fraction_90 double")
    return label.assign_grades(df, **options)


def test_grades_reserve_the_zero_atom_and_share_equal_labels(spark):
    values = [0.0] * 5 + [i / 90 for i in range(1, 81)]
    out, report = graded(spark, [("x", "home", v) for v in values])
    grades = {}
    for r in out.collect():
        grades.setdefault(r.blocked_fraction_90, set()).add(r.grade)
    assert grades[0.0] == {0} and all(len(g) == 1 for g in grades.values())
    assert all(min(g) > 0 for v, g in grades.items() if v > 0)
    ordered = [min(grades[v]) for v in sorted(grades)]
    assert ordered == sorted(ordered) and set(ordered) == {0, 1, 2, 3, 4}
    assert report.first().level == "partition"


def test_small_cells_take_the_whole_pool(spark):
    cells = [("x", "home", i / 100) for i in range(1, 101)] + [("x", "room", 0.01), ("x", "room", 0.99), ("x", "flat", 0.0)]
    out, report = graded(spark, cells)
    levels = {r.room_type: r.level for r in report.collect()}
    assert levels == {"home": "partition", "room": "fallback", "flat": "empty"}
    room = {r.blocked_fraction_90: r.grade for r in out.filter("room_type = 'room'").collect()}
    assert room == {0.01: 1, 0.99: 4}


def test_concentrated_cell_falls_back_and_uncuttable_pool_fails(spark):
    cells = [("x", "home", 0.5)] * 40 + [("x", "room", i / 200) for i in range(1, 201)]
    _, report = graded(spark, cells)
    assert {r.room_type: r.level for r in report.collect()}["home"] == "fallback"
    with pytest.raises(CheckFailed, match="pool"):
        graded(spark, [("x", "home", 0.5)] * 40)
    with pytest.raises(CheckFailed):
        graded(spark, [("x", "home", 1.5)])
    with pytest.raises(CheckFailed):
        graded(spark, [("x", "home", None)])


def test_grades_ignore_row_order(spark):
    cells = [("x", "home", (i * 37 % 90) / 90) for i in range(200)]
    a = {r.blocked_fraction_90: r.grade for r in graded(spark, cells)[0].collect()}
    b = {r.blocked_fraction_90: r.grade for r in graded(spark, cells[::-1])[0].collect()}
    assert a == b


def ranked_frame(spark, blocks):
    data, i = [], 0
    for count, overrides in blocks:
        for _ in range(count):
            base = {"city": "x", "neighbourhood_cleansed": "n", "room_type": "home", "accommodates": 2}
            base.update(overrides)
            data.append((i, *base.values()))
            i += 1
    df = spark.createDataFrame(data, "id int, city string, neighbourhood_cleansed string, room_type string, accommodates int")
    return cascade.with_capacity_tier(df)


def test_query_groups_pool_the_small_ones_only(spark):
    df = ranked_frame(spark, [(6, {}), (2, {"neighbourhood_cleansed": "p"}), (3, {"neighbourhood_cleansed": "q"}),
                              (1, {"room_type": "cave"}), (7, {"neighbourhood_cleansed": None})])
    out, report = cascade.query_group(df, partition=("city", "room_type"))
    groups = {}
    for r in out.collect():
        groups.setdefault(r.query_group, []).append(r)
    assert sorted(len(g) for g in groups.values()) == [1, 5, 6, 7]
    assert sorted(groups) == list(range(4))
    pooled = next(g for g in groups.values() if len(g) == 5)
    assert {r.neighbourhood_cleansed for r in pooled} == {"p", "q"}
    table = {r.rung: r for r in report.collect()}
    assert (table["nbhd_room_tier"].groups, table["city_room_tier"].groups, table["city_room"].singletons) == (2, 1, 1)


def test_a_rung_must_keep_the_partition(spark):
    with pytest.raises(CheckFailed, match="room_type"):
        cascade.settle_groups(ranked_frame(spark, [(1, {})]), (("bad", ("city",)),), partition=("city", "room_type"))
    with pytest.raises(CheckFailed):
        cascade.settle_groups(ranked_frame(spark, [(1, {})]), ())


def test_price_cascade_uses_original_values_and_reports(spark):
    data = [(1, "x", "a", 10.0), (2, "x", "a", 20.0), (3, "x", "a", None), (4, "x", "b", None), (5, "x", None, None), (6, "y", "a", 7.0)]
    df = spark.createDataFrame(data, "id int, city string, nbhd string, price double")
    rungs = (("nbhd", ("city", "nbhd")), ("city", ("city",)))
    out, report = cascade.impute_price(df, rungs)
    assert {r.id: r.price for r in out.collect()} == {1: 10.0, 2: 20.0, 3: 15.0, 4: 15.0, 5: 15.0, 6: 7.0}
    row = rows(report, "city")["x"]
    assert (row["n"], row["missing"], row["filled_nbhd"], row["filled_city"]) == (5, 3, 1, 2)
    with pytest.raises(CheckFailed):
        cascade.impute_price(df.filter("id = 4"), rungs)


def test_clusters_match_rounded_points_and_null_hosts(spark):
    data = [(1, "h", 40.60001, 22.9, 2), (2, "h", 40.60004, 22.9, 2), (3, "h", 40.61, 22.9, 2), (4, None, 40.6, 22.9, 2), (5, None, 40.6, 22.9, 2)]
    df = spark.createDataFrame(data, "id int, host_id string, latitude double, longitude double, accommodates int")
    out = {r.id: (r.cluster_id, r.n) for r in cascade.cluster_id(df, size="n").collect()}
    assert out[1] == out[2] and out[1][1] == 2 and out[3][1] == 1 and out[4] == out[5]


def test_filters_are_independent_and_count_overlap(spark):
    data = [("a", "x", 0, 1.0, 1.0, 60, None), ("b", "x", 0, 0.5, 0.5, 1, 50.0), ("c", "x", 3, 1.0, 0.989, 1, 50.0),
            ("d", "x", 3, 1.0, 0.99, 30, 50.0), ("e", "x", 3, 0.1, 0.1, 31, 5000.0), ("f", "x", 1, 0.1, 0.1, 1, 50.0)]
    df = spark.createDataFrame(data, "id string, city string, number_of_reviews int, blocked_fraction_90 double, "
                                     "blocked_fraction_calendar double, minimum_nights int, price double")
    df = df.withColumns({"room_type": F.lit("home"), "accommodates": F.lit(2)})
    kept, counts = filters.filter_listings(df)
    assert sorted(r.id for r in kept.collect()) == ["b", "c", "f"]
    row = counts.first()
    assert (row.n, row.inactive, row.long_term, row.dormant, row.extreme_price) == (6, 1, 2, 2, 1)
    assert (row.multi_rule, row.removed, row.kept) == (2, 3, 3)


def test_review_windows_are_half_open_and_never_null(spark):
    t = datetime.date(2026, 6, 29)
    back = lambda d: t - datetime.timedelta(days=d)
    events = spark.createDataFrame([("a", back(365)), ("a", back(276)), ("a", back(275)), ("a", back(366)), ("zz", back(300))],
                                   "listing_id string, date date")
    anchors = spark.createDataFrame([("a", t), ("b", t)], "listing_id string, T date")
    out = rows(reviews.same_season_last_year(events, anchors), "listing_id")
    assert (out["a"]["reviews_same_season_ly"], out["b"]["reviews_same_season_ly"]) == (2, 0)
    with pytest.raises(CheckFailed, match="duplicate"):
        reviews.reviews_in_window(events, anchors.unionByName(anchors))
    with pytest.raises(CheckFailed, match="resolves"):
        reviews.reviews_in_window(events, anchors.withColumn("listing_id", F.lit("q")).limit(1))


def test_rating_shrinks_to_the_other_ratings(spark):
    data = [("a", "x", 20, 5.0), ("b", "x", 0, None), ("c", "x", 20, 4.0), ("d", "y", 3, 4.5)]
    df = spark.createDataFrame(data, "id string, city string, number_of_reviews int, review_scores_rating double")
    out = {r.id: r.rating_shrunk for r in reviews.rating_shrunk(df).collect()}
    assert out["a"] == pytest.approx((20 * 5 + 20 * 4) / 40) and out["b"] == pytest.approx(4.5) and out["d"] is None


@pytest.mark.parametrize("leaf_points", [1, 8, 1000])
def test_density_equals_brute_force(spark, leaf_points):
    source = random.Random(3)
    points = [(i, "x" if i % 4 else "y", 37.9 + source.random() / 20, 23.7 + source.random() / 20) for i in range(400)]
    points += [(1000 + i, "x", 37.92, 23.72) for i in range(50)]
    df = spark.createDataFrame(points, "id int, city string, latitude double, longitude double")
    out = {r.id: r.density_1km for r in spatial.density(df, leaf_points=leaf_points).collect()}
    for city in ("x", "y"):
        mine = [p for p in points if p[1] == city]
        ref = math.radians(sum(p[2] for p in mine) / len(mine))
        xy = {p[0]: (math.radians(p[3]) * 6371.0088 * math.cos(ref), math.radians(p[2]) * 6371.0088) for p in mine}
        for i, (x, y) in xy.items():
            near = sum((x - a) ** 2 + (y - b) ** 2 <= 1.0 for a, b in xy.values()) - 1
            assert out[i] == near


def test_density_of_one_crowded_cell(spark):
    """Half of all points within 200 m: the crowd is counted by cells, and no place compares many points."""
    import numpy as np

    source = np.random.default_rng(1)
    lat = np.concatenate([37.9 + source.random(1500) / 10, 37.95 + source.random(1500) / 500])
    lon = np.concatenate([23.7 + source.random(1500) / 10, 23.75 + source.random(1500) / 500])
    df = spark.createDataFrame(
        [(i, "x", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(-1, "x", None, 23.7), (-2, None, 37.9, 23.7)],
        "id int, city string, latitude double, longitude double")
    out = {r.id: r.density_1km for r in spatial.density(df, leaf_points=16).collect()}
    x = np.radians(lon) * 6371.0088 * np.cos(np.radians(lat.mean()))
    y = np.radians(lat) * 6371.0088
    near = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 1.0).sum(axis=1) - 1
    assert [out[i] for i in range(3000)] == near.tolist() and out[-1] is None and out[-2] == 0
    points = df.filter("id >= 0").select(
        F.col("city"), F.lit(1).alias("_here"), (F.radians("longitude") * 6371.0 * math.cos(math.radians(lat.mean()))).alias("_u"),
        (F.radians("latitude") * 6371.0).alias("_v"))
    tables = spatial.cell_pairs(points, "city", 16)
    assert len(tables) > 3
    rows = sum(t.filter("_fate = 'whole'").agg(F.sum("_s_rows")).first()[0] or 0 for t in tables)
    assert rows > 0 and sum(t.filter("_fate = 'leaf'").count() for t in tables) < 3000 * 40


def test_anchor_and_centroid(spark):
    df = spark.createDataFrame([("crete", "n", 35.5138, 24.018), ("athens", "m", 37.9755, 23.7348), ("athens", "m", 37.98, 23.74)],
                               "city string, neighbourhood_cleansed string, latitude double, longitude double")
    out = spatial.centroid_distance(spatial.nearest_anchor(df)).collect()
    assert [r.km_to_nearest_anchor for r in out][:2] == [0.0, 0.0]
    assert out[0].km_to_neighbourhood_centroid is None and out[1].km_to_neighbourhood_centroid == out[2].km_to_neighbourhood_centroid > 0
    with pytest.raises(CheckFailed):
        spatial.nearest_anchor(df.withColumn("city", F.lit("paris")))


def test_nearest_anchor_of_a_table_equals_brute_force(spark):
    """Clustered anchors, a seam at 180 degrees, a pole, repeats, nulls and a market without anchors."""
    import numpy as np

    source = np.random.default_rng(3)
    rows, anchors = [], []
    for market, lat, lon in (("town", 37.9, 23.7), ("seam", -17.0, 179.95), ("pole", 89.9, 0.0)):
        for held, n in ((rows, 700), (anchors, 500)):
            spread = source.random(n) / 10
            north = np.minimum(lat + spread, 90.0)
            east = (lon + source.random(n) * (360 if market == "pole" else 0.1) + 180) % 360 - 180
            tight = source.random(n) < 0.5
            held += [(market, float(lat + 0.03 if t else a), float(b)) for a, b, t in zip(north, east, tight)]
    rows += rows[:50] + [("none", 1.0, 1.0), (None, 37.9, 23.7), ("town", None, 23.7), ("town", float("nan"), 23.7)]
    anchors += anchors[:50] + [(None, 37.9, 23.7), ("town", None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, m string, lat double, lon double")
    table = spark.createDataFrame(anchors, "am string, alat double, alon double")
    out = spatial.nearest_of_table(df, table, "m", "am", "lat", "lon", "alat", "alon", "km", leaf_anchors=8)
    assert out.columns == ["id", "m", "lat", "lon", "km"]
    found = {r.id: r.km for r in out.collect()}
    assert len(found) == len(rows) and [found[i] for i in range(len(rows) - 4, len(rows))] == [None] * 4
    for i, (market, lat, lon) in enumerate(rows[:-4]):
        near = np.radians([(a, b) for m, a, b in anchors if m == market and a is not None])
        half = np.sin((near - np.radians((lat, lon))) / 2) ** 2
        inner = half[:, 0] + math.cos(math.radians(lat)) * np.cos(near[:, 0]) * half[:, 1]
        assert found[i] == pytest.approx(2 * 6371.0088 * math.asin(math.sqrt(inner.min())), abs=0.00501)


def test_nearest_anchor_meets_few_anchors(spark):
    grid = spark.range(4096).select(
        F.lit("a").alias("_m"), (F.col("id") % 64 / 64).alias("_u"), (F.floor(F.col("id") / 64) / 64).alias("_v"), F.lit(0.0).alias("_w"))
    tables = spatial.nearest_candidates(grid, grid.withColumn("_u", F.col("_u") + 0.001), 8)
    leaves = sum(t.filter("_leaf").count() for t in tables)
    assert len(tables) > 4 and leaves * 8 < 4096 * 64


def test_nearest_anchor_of_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "m string, lat double, lon double")
    for left, right in ((df, df.limit(0)), (df.limit(0), df)):
        out = spatial.nearest_of_table(left, right, "m", "m", "lat", "lon", "lat", "lon", "km").collect()
        assert [r.km for r in out] == [None] * left.count()


def test_canonical_strings_of_every_alphabet(spark):
    from rankloom.operators import amenities

    texts = ["Wi\u2011Fi \uff37\uff29\uff26\uff29", "HDTV 42 inch", "caf\u00e9", "cafe\u0301", None, "", "host\u2019s  \ufb01re"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = {r.id: r.c for r in df.select("id", amenities.canonical(F.col("t")).alias("c")).collect()}
    assert [out[i] for i in range(1, 7)] == ["hdtv", "caf\u00e9", "caf\u00e9", None, "", "host's fire"]
    assert out[0] == "wi\u2010fi wifi"


def test_group_median_of_empty_group(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert ordering.group_median(df, ["g"], "v").count() == 0
