"""Parsing, anonymisation and gates on hand-built rows."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions import bins, hashing, parsing
from rankloom.operators import amenities, anonymise, cleaning, quality
from rankloom.operators.quality import CheckFailed
from rankloom.sources import schemas, sinks


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize("text, value", [("$50.00", 50.0), ("$1,712.00", 1712.0), (None, None), ("abc", None)])
def test_price(spark, text, value):
    assert one(spark, parsing.parse_price(F.col("c")), c=text) == value


@pytest.mark.parametrize(
    "numeric, text, count, shared",
    [(1.0, "1 bath", 1.0, False), (None, "1.5 shared baths", 1.5, True), (None, "Half-bath", 0.5, False),
     (None, "Shared half-bath", 0.5, True), (2.0, None, 2.0, None), (3.0, "bath", 3.0, False)],
)
def test_bathrooms(spark, numeric, text, count, shared):
    df = spark.createDataFrame([(numeric, text)], "n double, t string")
    row = df.select(parsing.bathroom_count(F.col("n"), F.col("t")).alias("c"),
                    parsing.bathroom_shared(F.col("t")).alias("s")).first()
    assert (row.c, row.s) == (count, shared)


@pytest.mark.parametrize("text, items, lost", [('["Wifi", "Kitchen"]', ["Wifi", "Kitchen"], False), ("[]", [], False),
                                               (None, [], False), ("{}", [], True), ("oops", [], True)])
def test_string_list(spark, text, items, lost):
    df = spark.createDataFrame([(text,)], "c string")
    row = df.select(parsing.parse_string_list(F.col("c")).alias("x"), parsing.lost_list(F.col("c")).alias("l")).first()
    assert row.x == items and bool(row.l) == lost


def test_dates_flags_and_tenure(spark):
    assert one(spark, parsing.parse_date(F.col("c")), c="2026-06-29") == datetime.date(2026, 6, 29)
    assert one(spark, parsing.parse_date(F.col("c")), c="29/06/2026") is None
    assert one(spark, parsing.lost_date(F.col("c")), c="29/06/2026")
    assert [one(spark, parsing.parse_flag(F.col("c")), c=x) for x in ("t", "f", None)] == [True, False, None]
    assert one(spark, parsing.unknown_flag(F.col("c")), c="unknown")
    df = spark.createDataFrame([(3, 4), (0, 0), (10, 11)], "y int, m int")
    assert [r[0] for r in df.select(parsing.tenure_months(F.col("y"), F.col("m"))).collect()] == [40, 0, 131]


@pytest.mark.parametrize("guests, tier", [(1, "1-2"), (2, "1-2"), (3, "3-4"), (4, "3-4"), (5, "5-7"), (7, "5-7"), (8, "8+"), (16, "8+")])
def test_capacity_tier(spark, guests, tier):
    df = spark.createDataFrame([(guests,)], "a int")
    assert df.select(bins.capacity_tier(F.col("a"))).first()[0] == tier


def test_capacity_outside_and_choices(spark):
    df = spark.createDataFrame([(0,), (101,), (None,)], "a int")
    assert [r[0] for r in df.select(bins.capacity_tier(F.col("a"))).collect()] == [None] * 3
    choices = {}
    for row in bins.party_sizes(spark).collect():
        choices.setdefault(row.tier, []).append(row.guests)
    assert choices == {"1-2": [1, 2], "3-4": [3, 4], "5-7": [5, 6, 7], "8+": [8, 10, 12, 16]}


def test_hash_is_stable_across_types_and_keeps_null(spark):
    df = spark.createDataFrame([(12345, 12345.0, "12345"), (None, None, None)], "a bigint, b double, c string")
    out = df.select(*[hashing.salted_hash(F.col(c), "s", df.schema[c].dataType).alias(c) for c in "abc"]).collect()
    import hashlib

    expected = hashlib.sha256(b"s:12345").hexdigest()
    assert list(out[0]) == [expected] * 3 and list(out[1]) == [None] * 3
    with pytest.raises(ValueError):
        hashing.salted_hash(F.col("a"), "  ", T.LongType())


def test_anonymise_listings(spark):
    names = [*schemas.PII_DROP, "id", "host_id", "host_location", "host_about", "license"]
    values = ["x"] * len(schemas.PII_DROP)
    rows = [(*values, 1, 901, "Athens, Greece", "hi", "0206K13000181400"),
            (*values, 2, 901, "Paris, France", "  ", "Exempt"), (*values, 3, 902, None, None, None)]
    kinds = ", ".join(f"{n} {'bigint' if n in ('id', 'host_id') else 'string'}" for n in names)
    out = anonymise.anonymise_listings(spark.createDataFrame(rows, kinds), "salt").collect()
    assert [r.host_is_local for r in out] == ["local", "foreign", "unknown"]
    assert [r.host_has_about for r in out] == [True, False, False]
    assert [r.license_status for r in out] == ["registered", "exempt", "missing"]
    assert out[0].host_id == out[1].host_id != out[2].host_id and out[2].license_hash is None
    assert not set(out[0].asDict()) & {*schemas.PII_DROP, "license", "host_about"}


def test_every_listings_column_has_one_disposition(spark):
    header = schemas.schema(schemas.LISTINGS).fieldNames()
    assert len(header) == 90
    present = spark.createDataFrame([(c,) for c in header], "column string")
    assert schemas.audit_columns(present, schemas.dispositions(spark)).count() == 0
    extra = present.unionByName(spark.createDataFrame([("new_column",)], "column string"))
    assert schemas.audit_columns(extra, schemas.dispositions(spark)).first().problem == "no disposition"
    counts = {r.disposition: r["count"] for r in schemas.dispositions(spark).groupBy("disposition").count().collect()}
    assert counts == {"all_null": 13, "pii_drop": 6, "derived_from": 8, "redundant": 14, "label_adjacent": 9, "keep": 40}


def test_gates_fire_and_stay_silent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, city string")
    quality.require_columns(df, ["id"], "listings")
    with pytest.raises(CheckFailed, match="listings.*missing"):
        quality.require_columns(df, ["missing"], "listings")
    assert [r.id for r in quality.ids_in_several(df, "id", "city").collect()] == [2]
    quality.require(df, {"negative": F.col("id") < 0})
    with pytest.raises(CheckFailed, match="large: 2"):
        quality.require(df, {"large": F.col("id") > 1})
    with pytest.raises(CheckFailed):
        quality.union_checked({"x": df, "y": df.select("city", "id")})
    parent = spark.createDataFrame([(1,)], "pid int")
    quality.require_join_integrity(df, "id", parent, "pid", 0.3)
    with pytest.raises(CheckFailed):
        quality.require_join_integrity(df, "id", parent, "pid")


def test_label_gain_check(spark):
    grades = lambda *v: spark.createDataFrame([(float(x),) for x in v], "g double")
    quality.check_label_gain(grades(0, 4), "g")
    for bad in (grades(5), grades(-1), grades(0.5), grades().filter("false")):
        with pytest.raises(CheckFailed):
            quality.check_label_gain(bad, "g")


def test_sealed_guard(spark):
    df = spark.createDataFrame([(0,), (0,)], "fold int")
    quality.require_sealed(df, "fold")
    with pytest.raises(CheckFailed):
        quality.require_sealed(df.unionByName(spark.createDataFrame([(1,)], "fold int")), "fold")
    with pytest.raises(CheckFailed):
        quality.require_sealed(df.filter("false"), "fold")


def test_broken_runs(spark):
    good = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "g string, p int")
    bad = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "g string, p int")
    assert quality.group_runs(good, "g", "p").count() == 0
    assert [r.g for r in quality.group_runs(bad, "g", "p").collect()] == ["a"]


def test_unique_first_row_is_kept(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only")], "id string, o int, v string")
    out = quality.drop_duplicates_keep_first(df, ["id"], [F.col("o")])
    assert sorted(r.v for r in out.collect()) == ["early", "only"]


def test_canonical_and_bucket_traps(spark):
    cases = {
        "Pool table": "entertainment", "Pool view": "view", "Private pool": "pool_spa", "Outdoor kitchen": "outdoor_space",
        "Coffee maker: Nespresso": "kitchen", "43 inch HDTV with Netflix": "entertainment", "Fast wifi – 500 Mbps": "connectivity_work",
        "Crib - available upon request": None, "Children’s dinnerware": "kitchen", "Something else": None,
        "Free parking on premises": "parking_private", "Free street parking": "parking_street",
    }
    df = spark.createDataFrame([(k,) for k in cases], "item string")
    out = {r.item: r for r in amenities.bucket_map(df).collect()}
    assert {k: r.bucket for k, r in out.items()} == cases
    assert out["43 inch HDTV with Netflix"].canonical == "hdtv with netflix"
    assert amenities.slug_text("Clothing storage: wardrobe") == "clothing_storage_wardrobe"


def test_amenity_schemes(spark):
    df = spark.createDataFrame([("a", ["Wifi", "Wifi", "Oven"]), ("b", [])], "id string, amenities array<string>")
    wide = {r.id: r for r in amenities.amenity_features(df).collect()}
    assert (wide["a"].amenity_count, wide["a"].amenity_connectivity_work, wide["a"].amenity_kitchen) == (3, 2, 1)
    assert wide["b"].amenity_count == 0 and wide["b"].amenity_kitchen == 0
    flags = {r.id: r for r in amenities.amenity_features(df, "flags", ["Wifi", "TV"]).collect()}
    assert (flags["a"].amenity_has_wifi, flags["a"].amenity_has_tv) == (1, 0)
    for call in (("odd", None), ("flags", None)):
        with pytest.raises(CheckFailed):
            amenities.amenity_features(df, *call)


def test_vocabulary_criteria_differ(spark):
    rows = [("a", 1, ["x", "y"]), ("b", 1, ["x"]), ("c", 2, ["x", "y"]), ("d", 2, ["x"])]
    df = spark.createDataFrame(rows, "id string, g int, items array<string>")
    assert amenities.fit_vocabulary(df, "items", 1).first().item == "x"
    best = amenities.fit_vocabulary(df, "items", 2, "within_group_variance", "g").collect()
    assert best[0].item == "y" and best[0].score == pytest.approx(0.5) and best[1].score == 0.0


def test_digest_ignores_row_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    a, b = sinks.table_digest(df).first(), sinks.table_digest(df.orderBy(F.desc("id"))).first()
    assert a == b and a.digest != sinks.table_digest(df.withColumn("v", F.col("v") + 1)).first().digest


def test_cache_scores_only_what_is_missing(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    cached = spark.createDataFrame([(1, "old")], "id int, s string")
    asked = []

    def score(df):
        asked.append(sorted(r.id for r in df.collect()))
        return df.withColumn("s", F.lit("new"))

    out = {r.id: r.s for r in sinks.read_through(wanted, cached, ["id"], score).collect()}
    assert out == {1: "old", 2: "new", 3: "new"} and asked == [[2, 3]]
    fresh = sinks.read_through(wanted, cached, ["id"], score, refresh=True)
    assert {r.s for r in fresh.collect()} == {"new"}


def test_clean_rules_name_what_they_count(spark):
    assert len(cleaning.counted_listing_rules()) == 6 and len(cleaning.fatal_listing_rules()) == 5


def test_one_to_one_join_proves_its_keys(spark):
    from rankloom.operators import quality

    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    right = spark.createDataFrame([(1, 1.0), (3, 3.0), (None, 0.0)], "k int, y double")
    pick = lambda how: sorted(map(str, map(tuple, quality.join_one_to_one(left, right, ["k"], how).collect())))
    assert pick("inner") == ["(1, 'a', 1.0)", "(None, 'n', 0.0)"]
    assert pick("left") == ["(1, 'a', 1.0)", "(2, 'b', None)", "(None, 'n', 0.0)"]
    assert len(pick("full")) == 4 and "(3, None, 3.0)" in pick("full")
    for a, b, side in ((left.union(left.limit(1)), right, "left side"), (left, right.union(right), "right side")):
        with pytest.raises(Exception, match=f"{side}: more than one row with"):
            quality.join_one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="more than one row"):  # no column of the right side is read
        quality.join_one_to_one(left, right.union(right), ["k"], "left").count()
    with pytest.raises(quality.CheckFailed, match="both sides have y"):
        quality.join_one_to_one(left.withColumn("y", left.k), right, ["k"])
    empty = quality.join_one_to_one(left.limit(0), right, ["k"])
    assert empty.columns == ["k", "x", "y"] and empty.count() == 0
