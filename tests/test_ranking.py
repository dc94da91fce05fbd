"""Metrics, comparison, exposure, fairness and split on hand-built frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import comparability, exposure, fairness, metrics, ordering, report, split, stats
from rankloom.operators.quality import CheckFailed
from tests.conftest import rows

SCHEMA = "id int, g string, grade int, score double"


def frame(spark, grades, scores=None, g="a"):
    scores = scores or [float(-i) for i in range(len(grades))]
    return spark.createDataFrame([(i, g, v, s) for i, (v, s) in enumerate(zip(grades, scores))], SCHEMA)


def ndcg(df, **options):
    return metrics.ndcg_at_k(df, ["g"], "grade", "score", ["id"], **options).first().ndcg


def test_ndcg_by_hand(spark):
    assert ndcg(frame(spark, [3, 2, 1])) == pytest.approx(1.0)
    expected = (1 + 3 / math.log2(3) + 7 / 2) / (7 + 3 / math.log2(3) + 1 / 2)
    assert ndcg(frame(spark, [1, 2, 3])) == pytest.approx(expected)


def test_ndcg_ignores_what_lies_below_the_cut(spark):
    tail = [0] * 10
    assert ndcg(frame(spark, [1] + tail[1:] + [0])) == pytest.approx(1.0)
    low = ndcg(frame(spark, tail + [4]))
    assert low == 0.0


def test_ties_follow_the_id_never_the_grade(spark):
    worst = frame(spark, [0, 0, 4], [1.0, 1.0, 1.0])
    assert ndcg(worst) == pytest.approx((15 / 2) / 15)


@pytest.mark.parametrize("grades, plain, included", [([2, 2], None, 1.0), ([0, 0], None, None)])
def test_degenerate_groups(spark, grades, plain, included):
    assert ndcg(frame(spark, grades)) == plain
    assert ndcg(frame(spark, grades), include_degenerate=True) == included


def test_recall(spark):
    df = frame(spark, [4, 0, 3, 3])
    assert metrics.recall_at_k(df, ["g"], "grade", "score", ["id"], k=2).first().recall == pytest.approx(1 / 3)
    assert metrics.recall_at_k(frame(spark, [0, 1]), ["g"], "grade", "score", ["id"]).first().recall is None


def many(spark, groups=40, size=12, noise=0.5, seed=0):
    source = random.Random(seed)
    data, i = [], 0
    for g in range(groups):
        for _ in range(size):
            grade = source.randrange(5)
            data.append((i, f"g{g}", grade, grade + source.gauss(0, noise), source.random()))
            i += 1
    df = spark.createDataFrame(data, SCHEMA + ", dull double")
    return ordering.session.stage(df)


def test_bootstrap_brackets_the_mean_and_pairing_is_tighter(spark):
    df = many(spark, noise=4.0)
    a = metrics.ndcg_at_k(df, ["g"], "grade", "score", ["id"])
    b = metrics.ndcg_at_k(df.withColumn("score", F.col("score") + F.col("dull") / 50), ["g"], "grade", "score", ["id"])
    ci = metrics.bootstrap_ci(a, [], ["ndcg"], ["g"], 300).first()
    assert ci.ndcg_low < ci.ndcg < ci.ndcg_high
    paired = report.paired_difference(b, a, ["g"], iterations=300).first()
    loose = report.unpaired_difference(b, a, ["g"], iterations=300).first()
    assert paired.difference == pytest.approx(loose.difference)
    assert paired.difference_high - paired.difference_low < loose.difference_high - loose.difference_low


def test_bootstrap_is_the_same_in_pieces(spark):
    df = metrics.ndcg_at_k(many(spark), ["g"], "grade", "score", ["id"])
    a = metrics.bootstrap_means(df, [], ["ndcg"], ["g"], 50)
    b = metrics.bootstrap_means(df, [], ["ndcg"], ["g"], 50, hot_rows=5)
    one, two = ({r.draw: round(r.ndcg, 12) for r in x.collect()} for x in (a, b))
    assert one == two


def test_random_floor_approaches_its_expectation(spark):
    df = many(spark, groups=10)
    drawn = report.random_floor(df, ["g"], "grade", ["id"], draws=300)
    exact = report.expected_floor(df, ["g"], "grade")
    a, b = (x.agg(F.avg("floor")).first()[0] for x in (drawn, exact))
    assert a == pytest.approx(b, abs=0.01)


def test_comparison_table_and_sentence(spark):
    df = many(spark, groups=20, size=12).unionByName(many(spark, groups=5, size=4, seed=9).withColumn("g", F.concat(F.lit("s"), "g")))
    table = report.comparison_table(df, ["g"], "grade", {"good": "score", "dull": "dull"}, ["id"], "dull", iterations=100)
    out = rows(table, "slice", "ranker")
    assert {s for s, _ in out} == {"overall", "n>10", "n<=10"}
    assert out["overall", "good"]["vs_low"] > 0 and out["overall", "dull"]["vs_dull"] == 0
    assert out["overall", "good"]["groups"] == out["n>10", "good"]["groups"] + out["n<=10", "good"]["groups"]
    sentence = report.headline(table, "good", "dull").first().sentence
    assert sentence.startswith("NDCG@10 0.") and "paired" in sentence
    with pytest.raises(KeyError):
        report.comparison_table(df, ["g"], "grade", {"good": "score"}, ["id"], "missing")


def test_seed_summary_flags_zero_spread(spark):
    data = [("overall", f"model_seed{i}", 10, 0.7, 0.5) for i in range(3)]
    df = spark.createDataFrame(data, "slice string, ranker string, groups int, ndcg double, floor double")
    row = report.summarise_seeds(df).first()
    assert row.deterministic and row.seeds == 3 and row.ndcg_sd == 0.0


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_pair_accuracy_equals_all_pairs(spark, hot_rows):
    data = [(i, f"c{i % 2}", f"g{i % 3}", i * 7 % 5, None if i == 11 else float(i * 11 % 6)) for i in range(40)]
    data += [(90, "lone", "g0", 2, 1.0)]
    df = spark.createDataFrame(data, "id int, cell string, g string, grade int, score double")
    out = rows(comparability.pair_accuracy(df, ["cell"], "g", "score", "grade", min_pairs=1, hot_rows=hot_rows), "cell")
    for cell in ("c0", "c1"):
        judged = {True: [], False: []}
        for x in data:
            for y in data:
                if x[1] == y[1] == cell and x[3] > y[3] and None not in (x[4], y[4]):
                    judged[x[2] == y[2]].append((x[4] > y[4]) + (x[4] == y[4]) / 2)
        for side, name in ((True, "within"), (False, "cross")):
            assert out[cell][name] == pytest.approx(sum(judged[side]) / len(judged[side]))
    assert out["lone"]["within"] is None and out["lone"]["cross"] is None


def test_pair_accuracy_thresholds_and_unknown_grades(spark):
    df = many(spark, groups=6, size=30, noise=0.01).withColumn("cell", F.lit("c"))
    per_cell = comparability.pair_accuracy(df, ["cell"], "g", "score", "grade")
    acc = per_cell.first()
    assert acc["within"] > 0.99 and acc["cross"] > 0.99
    few = comparability.pair_accuracy(df, ["cell"], "g", "score", "grade", min_pairs=10**6).first()
    assert few["within"] is None and few["cross"] is None
    assert set(rows(comparability.comparability(per_cell, ["cell"], 20), "pairs")) == {"within", "cross", "difference"}
    with pytest.raises(Exception, match="grade outside the scale"):
        comparability.pair_accuracy(df, ["cell"], "g", "score", "grade", grades=(0, 1)).collect()


def test_positions_and_displacement(spark):
    df = frame(spark, [0, 4, 2], [3.0, 1.0, 2.0]).unionByName(frame(spark, [1], g="lone"))
    out = {(r.g, r.id): r.displacement for r in fairness.displacement(df, ["g"], "score", "grade", ["id"]).collect()}
    assert out["a", 0] == 1.0 and out["a", 1] == -1.0 and out["a", 2] == 0.0 and out["lone", 0] is None


def test_cohort_gap_needs_members_on_both_sides(spark):
    data = [(i, "a", i < 3, 0.2 if i < 3 else -0.1) for i in range(6)] + [(9, "b", True, 0.5), (10, "b", False, 0.1)]
    df = spark.createDataFrame(data, "id int, g string, c boolean, displacement double")
    out = rows(fairness.cohort_gap(df, ["g"], "c"), "g")
    assert list(out) == ["a"] and out["a"]["cohort_gap"] == pytest.approx(0.3)


def test_cohort_reach_reference_is_exact(spark):
    df = frame(spark, [0] * 20).withColumn("c", F.col("id") >= 15)
    row = exposure.cohort_reach(df, ["g"], "score", ["id"], "c").first()
    assert (row.cohort, row.reached, row.random_rate, row.lift) == (5, 0, 0.5, -0.5)
    assert row.reach_rate == 0.0


def test_concentration(spark):
    data = [(i, "a", "p" if i < 10 else "q", float(-i)) for i in range(12)] + [(i, "b", "p", 0.0) for i in range(3)]
    df = spark.createDataFrame(data, "id int, g string, geo string, score double")
    out = rows(exposure.geographic_concentration(df, ["g"], "geo", "score", ["id"]), "g")
    assert (out["a"]["geos_in_top_k"], out["a"]["coverage"], out["a"]["entropy"]) == (1, 0.5, 0.0)
    assert out["b"]["coverage"] == 1.0 and out["b"]["entropy"] is None


def test_unseen_place_takes_the_city_mean(spark):
    train = spark.createDataFrame([("x", "p", 4), ("x", "q", 0)], "city string, geo string, grade int")
    prior = exposure.demand_prior(train, "city", "geo")
    cand = spark.createDataFrame([("s", "x", "p"), ("s", "x", "q"), ("s", "x", "new")], "search string, city string, geo string")
    kept = exposure.select_geographies(cand, prior, ["search"], "city", "geo", 2)
    assert sorted(r.geo for r in kept.collect()) == ["new", "p"]


def test_long_chain_is_one_component_in_few_rounds(spark):
    n = 1000
    edges = spark.range(1, n).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    shuffled = edges.select((F.col("u") * 7919 % 100_003).alias("a"), (F.col("v") * 7919 % 100_003).alias("b"))
    shuffled = shuffled.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    labels = split.component_labels(shuffled, max_rounds=25)
    assert labels.select("component").distinct().count() == 1 and labels.count() == n - 1


def test_null_unit_stops_the_split(spark):
    df = spark.createDataFrame([(1, None)], "query_group int, cluster_id string")
    with pytest.raises(CheckFailed):
        split.split_component(df)


def components(spark, n=30):
    source = random.Random(5)
    data, i = [], 0
    for c in range(n):
        for _ in range(source.randrange(4, 30)):
            data.append((i, c, f"c{c}_{source.randrange(6)}", "xyz"[c % 3]))
            i += 1
    data.append((i, 0, "bridge", "x"))
    data.append((i + 1, 1, "bridge", "y"))
    return spark.createDataFrame(data, "id int, query_group int, cluster_id string, city string")


def test_folds_keep_units_whole_and_balanced(spark):
    df = components(spark)
    out, report_table = split.assign_folds(df, folds=4)
    fold = {}
    for r in out.collect():
        fold.setdefault(r.query_group, set()).add(r.fold)
        fold.setdefault(r.cluster_id, set()).add(r.fold)
    assert all(len(f) == 1 for f in fold.values()) and fold[0] == fold[1]
    report_rows = report_table.collect()
    assert len(report_rows) == 4 and sum(r.rows for r in report_rows) == df.count()
    assert max(r.row_share for r in report_rows) < 0.4
    again, _ = split.assign_folds(df.repartition(5), folds=4)
    assert {r.id: r.fold for r in again.collect()} == {r.id: r.fold for r in out.collect()}


def test_too_few_components(spark):
    df = spark.createDataFrame([(1, "a", "x")], "query_group int, cluster_id string, city string")
    with pytest.raises(CheckFailed):
        split.assign_folds(df, folds=2)


def test_retrieval_arms_equal_screens_of_filtered_candidates(spark):
    source = random.Random(4)
    data = [(i, f"s{i % 5}", None if source.random() < 0.1 else f"p{source.randrange(6)}", source.randrange(5),
             source.random() < 0.3, float(source.randrange(20))) for i in range(600)]
    df = spark.createDataFrame(data, "id int, s string, p string, grade int, cold boolean, score double").withColumn("c", F.lit("x"))
    prior = exposure.demand_prior(df, "c", "p")
    out = {(r.k_geo, r.arm): r for r in exposure.simulate_arms(
        df, prior, ["s"], "c", "p", "grade", "cold", "score", ["id"], (1, 3), 10).collect()}
    assert len(out) == 4 and out[1, "control"].mean_grade == out[3, "control"].mean_grade
    places = {(r.s, r.p): r.geo_rank for r in exposure.ranked_geographies(df, prior, ["s"], "c", "p").collect()}
    for width, arm in out:
        kept = [d for d in data if arm == "control" or places[d[1], d[2]] <= width]
        screens = [sorted((d for d in kept if d[1] == f"s{i}"), key=lambda d: (-d[5], d[0]))[:10] for i in range(5)]
        row = out[width, arm]
        assert row.searches == 5
        assert row.mean_grade == pytest.approx(sum(sum(d[3] for d in x) / len(x) for x in screens) / 5)
        assert row.distinct_geos == pytest.approx(sum(len({d[2] for d in x}) for x in screens) / 5)
        assert row.median_candidates == sorted(sum(d[1] == f"s{i}" for d in kept) for i in range(5))[2]


def test_p_values_of_known_samples(spark):
    """Published values: r = 0.8 over 10 pairs, chi-square of a 2 x 3 table, ANOVA of three groups of five."""
    x = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    df = spark.createDataFrame(list(zip(x, [2, 1, 4, 3, 7, 5, 10, 6, 9, 8], [5] * 10)), "x int, y int, c int")
    out = {(r.a, r.b): r for r in stats.correlation_significance(df, ["x", "y", "c"], min_periods=3).collect()}
    r = out["x", "y"].r
    dof, t = 8, r * math.sqrt(8 / (1 - r * r))
    # Student's distribution with eight degrees of freedom has a closed form.
    u = t / math.sqrt(dof + t * t)
    inside = u * (1 + (1 - u * u) / 2 * (1 + 3 / 4 * (1 - u * u) * (1 + 5 / 6 * (1 - u * u))))
    assert out["x", "y"].p_value == pytest.approx(1 - inside, abs=1e-9) and out["x", "c"].p_value is None
    both = stats.numeric_relation(df, "x", "y").first()
    assert both.pearson_p == pytest.approx(both.spearman_p) and both.significant
    cells = [("a", "p")] * 10 + [("a", "q")] * 20 + [("a", "r")] * 30 + [("b", "p")] * 20 + [("b", "q")] * 20 + [("b", "r")] * 20
    found = stats.chi_square(spark.createDataFrame(cells, "f string, s string"), "f", "s").first()
    assert found.dof == 2 and found.p_value == pytest.approx(math.exp(-found.chi2 / 2), abs=1e-9)  # two degrees of freedom
    square = stats.chi_square(spark.createDataFrame([c for c in cells if c[1] != "r"], "f string, s string"), "f", "s").first()
    assert square.p_value == pytest.approx(math.erfc(math.sqrt(square.chi2 / 2)))
    rows = [("a", v) for v in (6, 8, 4, 5, 3, 4)] + [("b", v) for v in (8, 12, 9, 11, 6, 8)] + [("c", v) for v in (13, 9, 11, 8, 7, 12)]
    tested = stats.category_effect(spark.createDataFrame(rows, "g string, v int"), "g", "v").first()
    assert tested.statistic == pytest.approx(9.2647, abs=1e-3) and tested.p_value == pytest.approx(0.0024, abs=1e-4)
    two = stats.category_effect(spark.createDataFrame(rows[:12], "g string, v int"), "g", "v").first()
    assert two.test.startswith("Welch") and two.p_value is None and 0 < two.levene_p <= 1


def test_low_expected_cells_counted_with_empty_cells(spark):
    data = [("a", "x")] * 30 + [("b", "y")] * 4 + [("b", "x")] * 1
    df = spark.createDataFrame(data, "p string, q string")
    out = stats.chi_square(df, "p", "q").first()
    assert out.n == 35 and out.low_expected_cells == 3 and out.dof == 1
