"""Positions, quantiles and joins: the piecewise route must equal the plain one."""

import statistics

import pytest
from pyspark.sql import functions as F

from rankloom.operators import neighbourhood, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one value a third of that group."""
    df = spark.range(3_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40))
        .alias("g"),
        F.when(F.col("id") % 9 == 0, F.lit(5.0)).otherwise((F.col("id") * 7919 % 211) / 10.0)
        .alias("v"),
    )
    return ordering.session.stage(df)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("group", [["g"], []])
def test_rank_in_pieces_equals_window(skewed, group):
    order = [F.desc("v"), F.asc("id")]
    plain = ordering.group_rank(skewed, group, order, "r")
    assert same(plain, ordering.group_rank(skewed, group, order, "r", hot_rows=50))


def test_running_total_in_pieces_with_total(skewed):
    order = [F.asc("v"), F.asc("id")]
    weighted = skewed.withColumn("w", F.col("id") % 5)
    plain = ordering.running_total(weighted, ["g"], order, "w", "b", "t")
    assert same(plain, ordering.running_total(weighted, ["g"], order, "w", "b", "t", hot_rows=20))


def test_rank_does_not_depend_on_partitioning(skewed):
    order = [F.desc("v"), F.asc("id")]
    a = ordering.group_rank(skewed.repartition(7), ["g"], order, "r", hot_rows=50)
    assert same(a, ordering.group_rank(skewed.coalesce(1), ["g"], order, "r"))


def test_quantiles_equal_builtin_percentile(skewed):
    mine = ordering.group_quantiles(skewed, ["g"], "v", {"q": 0.25, "m": 0.5}, hot_rows=5)
    theirs = skewed.groupBy("g").agg(
        F.percentile("v", F.lit(0.25)).alias("q"), F.percentile("v", F.lit(0.5)).alias("m")
    )
    left = {r.g: (round(r.q, 9), round(r.m, 9)) for r in mine.collect()}
    assert left == {r.g: (round(r.q, 9), round(r.m, 9)) for r in theirs.collect()}


def test_interpolated_value_between_equal_neighbours_is_exact(spark):
    df = spark.createDataFrame([(0.7,), (0.7,), (0.7,)], "v double")
    assert ordering.group_quantiles(df, [], "v", {"q": 0.3}).first().q == 0.7


def test_average_rank_matches_hand_count_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None)], "id int, v double")
    out = {r.id: (r.rank, r.share) for r in ordering.average_rank(df, [], "v", share="share").collect()}
    assert out == {1: (1.0, 1 / 3), 2: (2.5, 2.5 / 3), 3: (2.5, 2.5 / 3), 4: (None, None)}


def test_only_hot_keys_are_salted(skewed, monkeypatch):
    stats = skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    small = ordering.attach(skewed, stats, ["g"])
    assert same(small, ordering.attach(skewed, stats, ["g"], broadcast_rows=0, size="n"))
    monkeypatch.setattr(ordering.session, "HOT_ROWS", 200)
    hot = ordering.attach(skewed, stats, ["g"], broadcast_rows=0, size="n")
    assert same(small, hot)
    assert "SortMergeJoin" in hot._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_broadcast_join_and_matches_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, "x")], "id int, k string")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = ordering.attach(df, stats, ["k"])
    salted = ordering.attach(df, stats, ["k"], broadcast_rows=0)
    assert same(small, salted)
    assert {r.id: r.n for r in small.collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_leave_one_out_median_equals_recomputation(skewed, hot_rows):
    out = neighbourhood.leave_one_out_median(skewed, ["g"], "v", count="n", hot_rows=hot_rows)
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.g, []).append((r.id, r.v))
    for r in out.collect():
        others = [v for i, v in groups[r.g] if i != r.id]
        assert r.n == len(others)
        assert r.loo_median == pytest.approx(statistics.median(others), abs=1e-12)


def test_leave_one_out_of_a_lone_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double")
    out = sorted((r.g, r.loo_median) for r in neighbourhood.leave_one_out_median(df, ["g"], "v").collect())
    assert out == [("a", None), ("b", 2.0), ("b", 4.0)]
    counts = neighbourhood.leave_one_out_count(df, ["g"])
    assert sorted(r.others for r in counts.collect()) == [0, 1, 1]


def test_top_k_is_limited_before_the_shuffle(skewed):
    top = ordering.top_k(skewed, ["g"], [F.desc("v"), F.asc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_dense_ids_keep_null_keys(spark):
    df = spark.createDataFrame([("b", 1), (None, 1), ("a", 1), ("b", 1)], "k string, x int")
    assert {r.k: r.i for r in ordering.dense_ids(df, ["k"], "i").collect()} == {None: 0, "a": 1, "b": 2}
