"""Results that do not depend on how many rows there are or in which order they are added."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom import catalog, session
from rankloom.operators import amenities, comparability, exposure, metrics, ordering, ranker, report, stats
from tests.conftest import rows


def test_ties_take_their_first_place(spark):
    table = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    found = stats.correlation_matrix(table, ["a", "b"], "spearman_min", min_periods=2).first()
    a, b = [1, 1, 3, 4], [1, 2, 3, 3]
    ma, mb = sum(a) / 4, sum(b) / 4
    top = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    r = top / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert found["r"] == pytest.approx(r)


def test_equal_means_tie_in_any_order_of_rows(spark, tmp_path):
    draw = random.Random(3)
    prices = [draw.randrange(90_000, 10_000_000) / 100 for _ in range(200)]
    lines = []
    for line in range(1, 13):  # four copies of three configurations, each in an order of its own
        kind = line % 3
        own = [(line, p + kind, draw.randrange(0, 9) / 100, float(1 + i % (20 + kind))) for i, p in enumerate(prices)]
        own = [(a, b, round((i % 9 + kind) / 100, 2), d) for i, (a, b, _, d) in enumerate(own)]
        draw.shuffle(own)
        lines += own
    spark.createDataFrame(lines, "l_linenumber int, l_extendedprice double, l_tax double, l_quantity double").coalesce(
        1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = rows(catalog.queries()["hyperparameter_correlation"](spark, str(tmp_path)), "b")
    # Three levels of four tied rows each: price and tax rise with the kind, and so do the leaves.
    assert found["rate"]["r"] == 1.0
    assert abs(found["leaves"]["r"]) in (0.5, 1.0)


def scored_rows(spark, count=6000, groups=2, seed=5):
    draw = random.Random(seed)
    data = [(i, None if i % 7 == 0 else f"g{draw.randrange(groups)}", draw.randrange(3), f"p{draw.randrange(8)}",
             draw.randrange(5), None if draw.random() < 0.02 else float(draw.randrange(400)), draw.random() < 0.1)
            for i in range(count)]
    return session.stage(spark.createDataFrame(
        data, "id int, g string, h int, place string, grade int, score double, cold boolean"))


def first_ids(df, group, k=10):
    return {(*(r[c] for c in group), r["id"], r["rank"])
            for r in metrics.first_rows(df, group, "score", ["id"], k).collect()}


def test_contenders_hold_the_first_rows_and_few_others(spark):
    df = scored_rows(spark)
    kept = ordering.contenders(df, ["g"], ["score"], ["id"], 10)
    assert first_ids(kept, ["g"]) == first_ids(df, ["g"])
    assert kept.count() < 300
    small = df.withColumn("g", F.col("id") % 1000)
    assert ordering.score_bounds(small, ["g"], ["score"], ["id"], 10) is None
    blank = df.withColumn("score", F.when(F.col("id") < 5, F.col("score")))
    assert first_ids(ordering.contenders(blank, ["h"], ["score"], ["id"], 10), ["h"]) == first_ids(blank, ["h"])


def test_scores_are_stacked_for_few_rows(spark):
    df = scored_rows(spark)
    scores = {"up": F.col("score"), "down": -F.col("score")}
    long = session.stage(ordering.stacked_contenders(df, ["g", "id"], ["g"], scores, ["id"], 10))
    assert long.count() < 600
    for name, score in scores.items():
        own = first_ids(long.filter(F.col("ranker") == name), ["g"])
        assert own == first_ids(df.withColumn("score", score), ["g"])


def test_widening_equals_every_rung_by_itself(spark):
    df = scored_rows(spark)
    cascade = (("both", ("g", "h")), ("one", ("g",)), ("other", ("h",)))
    found = rows(exposure.widening_table(df, cascade, "place", "score", "cold", ["id"], 10), "rung")
    for rung, keys in cascade:
        one = df.withColumn("key", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys]))
        spread = exposure.geographic_concentration(one, ["key"], "place", "score", ["id"], 10)
        reach = exposure.cohort_reach(one, ["key"], "score", ["id"], "cold", 10).first()
        mean = spread.agg(F.count("*").alias("n"), F.avg("entropy").alias("e"), F.avg("coverage").alias("c")).first()
        assert found[rung]["groups"] == mean["n"]
        assert found[rung]["entropy"] == pytest.approx(mean["e"])
        assert found[rung]["coverage"] == pytest.approx(mean["c"])
        assert found[rung]["cold_reach"] == pytest.approx(reach["reach_rate"])
        assert found[rung]["cold_random"] == pytest.approx(reach["random_rate"])


def test_floor_does_not_depend_on_the_line(spark, monkeypatch):
    df = scored_rows(spark, 1500).filter("g IS NOT NULL")
    floors = []
    for margin in (4.0, 1e9, 0.5):  # lined, every row ordered, nearly every group done again
        monkeypatch.setattr(report, "FLOOR_MARGIN", margin)
        found = report.random_floor(df, ["g", "h"], "grade", ["id"], draws=5)
        floors.append({(r.g, r.h): r.floor for r in found.collect()})
    assert len(floors[0]) == 6
    for other in floors[1:]:
        assert other == pytest.approx(floors[0])


def test_labels_of_one_size_share_their_draws(spark, monkeypatch):
    data = [(label, i, float(i * i % (31 + len(label)))) for label, n in (("a", 40), ("bb", 40), ("c", 25)) for i in range(n)]
    df = session.stage(spark.createDataFrame(data, "label string, id int, value double"))
    args = (df, ["label"], ["value"], ["id"], 30)
    shared = rows(metrics.bootstrap_means(*args), "label", "draw")
    monkeypatch.setattr(metrics, "SHARED_DRAWS", 0)
    own = rows(metrics.bootstrap_means(*args), "label", "draw")
    assert len(shared) == 90 and shared.keys() == own.keys()
    assert all(shared[k]["value"] == pytest.approx(own[k]["value"]) for k in own)


def test_pair_gradients_equal_every_pair_and_keep_groups_without_gain(spark):
    draw = random.Random(8)
    data = [(i, f"g{i % 4}", 0 if i % 4 == 3 else draw.randrange(5), None if i == 20 else draw.random()) for i in range(200)]
    df = session.stage(spark.createDataFrame(data, "id int, g string, grade int, s double"))
    settings = ranker.Settings(group="g", grade="grade", ids=("id",), truncation=6)
    found = rows(ranker.pair_gradients(df, settings, "s"), "id")
    expected = {d[0]: [0.0, 0.0] for d in data}
    for g in range(3):
        own = sorted((d for d in data if d[1] == f"g{g}"), key=lambda d: (-math.inf if d[3] is None else d[3], -d[0]), reverse=True)
        best = sorted((d[2] for d in own), reverse=True)[:6]
        ideal = sum((2 ** v - 1) / math.log2(i + 2) for i, v in enumerate(best))
        for i, a in enumerate(own[:6]):
            for j, b in enumerate(own[i + 1:], i + 1):
                if a[2] == b[2] or a[3] is None or b[3] is None:
                    continue
                sign = 1 if a[2] > b[2] else -1
                p = 1 / (1 + math.exp(sign * (a[3] - b[3])))
                d = abs(2 ** a[2] - 2 ** b[2]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / ideal
                for row, way in ((a, 1), (b, -1)):
                    expected[row[0]][0] += way * sign * p * d
                    expected[row[0]][1] += p * (1 - p) * d
    assert found.keys() == expected.keys()
    for i, (gradient, hessian) in expected.items():
        assert found[i]["gradient"] == pytest.approx(gradient, abs=1e-12)
        assert found[i]["hessian"] == pytest.approx(hessian, abs=1e-12)


def test_rule_and_table_give_the_same_buckets(spark):
    df = spark.createDataFrame([(1, ["a.b", "axb", "wifi", "wifi"]), (2, []), (3, None), (4, ["tv (hd)", "none"])],
                               "id int, items array<string>")
    names = {"dot": ("a.b", "(hd)"), "net": ("wifi",)}
    rule = amenities.bucket(F.col("item"), names)
    table = amenities.vocabulary(df, "items").withColumn("bucket", rule)
    found = [rows(amenities.bucket_counts(df, ["id"], "items", m, list(names)), "id") for m in (rule, table)]
    assert found[0] == found[1]
    assert found[0][1] == {"id": 1, "dot": 1, "net": 2} and found[0][3] == {"id": 3, "dot": 0, "net": 0}


def test_coverage_sums_strings_that_fold_alike(spark):
    vocab = spark.createDataFrame([("WiFi  fast", 3), ("wifi fast", 2), ("qqq", 1)], "item string, mentions long")
    found = amenities.map_coverage(vocab).first()
    assert (found["distinct_strings"], found["mentions"]) == (2, 6)
    assert (found["mapped_strings"], found["mapped_mentions"]) == (1, 5)


def test_large_counted_tables_are_dealt_by_rows(spark, monkeypatch):
    df = scored_rows(spark, 2000).filter("score IS NOT NULL")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    placed = ordering.group_rank(df, ["place"], [F.desc("score"), F.asc("id")], at_most=2000)
    plain = ordering.group_rank(df, ["place"], [F.desc("score"), F.asc("id")])
    assert placed.rdd.getNumPartitions() == 20
    assert {r.id: r.rank for r in placed.collect()} == {r.id: r.rank for r in plain.collect()}


def test_pair_counts_copy_no_row_per_grade(spark, monkeypatch):
    df = scored_rows(spark, 1500)
    pieces = rows(comparability.pair_counts(df, ["g", "place"], "score", "grade", hot_rows=10), "g", "place")
    monkeypatch.setattr(ordering, "running_total", None)  # the window of all grades does without
    whole = rows(comparability.pair_counts(df, ["g", "place"], "score", "grade"), "g", "place")
    assert whole == pieces and len(whole) == 24


def test_rank_correlation_of_repeated_pairs(spark):
    draw = random.Random(2)
    data = [(draw.randrange(6), draw.randrange(4), 1.0) for _ in range(400)] + [(None, 2, 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(data, "a int, b int, flat double")
    both = [d for d in data if d[0] is not None and d[1] is not None]

    def ranks(values):
        return [sum(v < w for v in values) + (sum(v == w for v in values) + 1) / 2 for w in values]

    a, b = ranks([d[0] for d in both]), ranks([d[1] for d in both])
    mean = (len(both) + 1) / 2
    top = sum((x - mean) * (y - mean) for x, y in zip(a, b))
    r = top / math.sqrt(sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b))
    found = rows(stats.correlation_matrix(df, ["a", "b", "flat"], "spearman"), "a", "b")
    assert found["a", "b"]["n"] == 400 and found["a", "b"]["r"] == pytest.approx(r)
    assert found["a", "flat"]["r"] is None
    # Ranked are distinct pairs, of which there are 24, and not the rows.
    joint = df.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("w"))
    ranked = ordering.average_rank(joint, [], "a", "rank", weight="w")
    assert {x.a: x.rank for x in ranked.collect()} == {d[0]: x for d, x in zip(both, a)}
