"""Ranker fits, batch scoring, counterfactuals and search on the driver's tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from rankloom import session
from rankloom.catalog.common import (
    GRADED_SQL,
    TIES,
    TIES_SQL,
    bootstrap_sql,
    draws_sql,
    graded_lines,
    ndcg_sql,
    r_sql,
    rnd,
    rounded,
    table,
)
from rankloom.catalog.features import PART_CASCADE, PART_GROUPS_SQL, tiered_parts
from rankloom.operators import cascade, metrics, ordering, ranker, scoring, split

QUERIES, SQL = {}, {}
PRICE = "l_extendedprice"


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


PARTS = ranker.Settings(
    group="p_brand", grade="grade", ids=("p_partkey",), numeric=("p_size", "key_mod", "p_partkey"),
    categorical=("p_type", "p_name"), rounds=3, depth=4, min_rows=5,
)


def graded_parts(spark, folder):
    """Parts graded by price within their type, with a fold per brand."""
    parts = table(spark, folder, "part").withColumns(
        {"key_mod": F.col("p_partkey") % 100, "fold": F.crc32("p_brand") % 3}
    )
    edges = ordering.group_quantiles(
        parts, ["p_type"], "p_retailprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    )
    steps = " + ".join(f"CAST(p_retailprice > {q} AS INT)" for q in ("q1", "q2", "q3"))
    out = ordering.attach(parts, edges, ["p_type"]).withColumn("grade", F.expr(steps))
    return ordering.session.stage(out.drop("q1", "q2", "q3"))


@register()
def boosted_ranker(spark, folder):
    """Fit on two folds, score the third: NDCG of the model against a baseline order."""
    parts = graded_parts(spark, folder)
    model = ranker.fit(parts.filter("fold <> 0"), PARTS)
    scored = ordering.session.stage(model.score(parts.filter("fold = 0")))
    return scored.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).join(
        metrics.ndcg_at_k(scored, ["p_brand"], "grade", "score", ["p_partkey"]).select(
            "p_brand", rnd("ndcg").alias("ndcg")
        ),
        "p_brand",
    )


@register()
def ranker_importance(spark, folder):
    """Feature importance of a fitted ranker."""
    parts = graded_parts(spark, folder)
    return rounded(ranker.fit(parts, replace(PARTS, rounds=2)).importance(spark), "gain")


@register()
def ranker_cross_validation(spark, folder):
    """Out-of-fold scores of every development fold."""
    parts = graded_parts(spark, folder)
    oof, _ = ranker.cross_validate(parts, "fold", replace(PARTS, rounds=2), folds=3)
    return oof.select("p_partkey", "fold", rnd("score").alias("score"))


STUMP = replace(PARTS, numeric=("p_size", "key_mod"), categorical=(), rounds=1, depth=1)
_PART_GRADES = """
edges AS (SELECT p_type, quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.5) AS q2,
    quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY ALL),
parts AS (SELECT part.*, p_partkey % 100 AS key_mod,
    CAST(p_retailprice > q1 AS INT) + CAST(p_retailprice > q2 AS INT) + CAST(p_retailprice > q3 AS INT) AS grade
  FROM part JOIN edges USING (p_type))"""


@register("WITH" + _PART_GRADES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rk FROM parts),
i AS (SELECT p_brand, sum((pow(2, grade) - 1) / log2(ir + 1)) AS ideal FROM (SELECT *, row_number() OVER (
    PARTITION BY p_brand ORDER BY grade DESC) AS ir FROM parts) WHERE ir <= 30 GROUP BY ALL),
p AS (SELECT a.p_brand, a.rk AS ra, b.rk AS rb, CASE WHEN a.grade > b.grade THEN 1 ELSE -1 END AS sg,
    abs(pow(2, a.grade) - pow(2, b.grade)) * abs(1 / log2(a.rk + 1) - 1 / log2(b.rk + 1)) / ideal AS d
  FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.rk <= 30 AND b.rk > a.rk AND a.grade <> b.grade JOIN i ON i.p_brand = a.p_brand),
t AS (SELECT p_brand, rk, sum(g) AS g, sum(h) AS h FROM (SELECT p_brand, ra AS rk, sg * d / 2 AS g, d / 4 AS h FROM p
  UNION ALL SELECT p_brand, rb, -sg * d / 2, d / 4 FROM p) GROUP BY ALL HAVING sum(h) > 1e-12),
x AS (SELECT p_size, key_mod, g, h FROM r JOIN t USING (p_brand, rk)),
v AS (SELECT 'p_size' AS feature, CAST(p_size AS DOUBLE) AS v, g, h FROM x UNION ALL SELECT 'key_mod', key_mod, g, h FROM x),
d AS (SELECT feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT feature, (v + lead(v) OVER up) / 2 AS threshold, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(n) OVER up AS nl,
    sum(g) OVER every AS g, sum(h) OVER every AS h, sum(n) OVER every AS n
  FROM d WINDOW up AS (PARTITION BY feature ORDER BY v), every AS (PARTITION BY feature))
SELECT feature, threshold, """ + r_sql("gl / hl") + " AS left_value, " + r_sql("(g - gl) / (h - hl)") + """ AS right_value
FROM c WHERE threshold IS NOT NULL AND nl >= 5 AND n - nl >= 5 ORDER BY gl * gl / hl + (g - gl) * (g - gl) / (h - hl) DESC LIMIT 1""")
def boosted_stump(spark, folder):
    """One boosted tree of one split: of all splits of all features the one with the largest Newton gain."""
    nodes = ranker.fit(graded_parts(spark, folder), STUMP).nodes(spark)
    value = {side: F.max(F.when(F.col("node") == n, F.col("value"))) for side, n in (("left", 2), ("right", 3))}
    return nodes.agg(
        F.max("feature").alias("feature"), F.max("threshold").alias("threshold"),
        rnd(value["left"]).alias("left_value"), rnd(value["right"]).alias("right_value"))


SERVED = replace(PARTS, numeric=("p_size", "key_mod"), categorical=("p_type",), rounds=2)


@register("""
WITH asked AS (SELECT p_brand, CASE WHEN p_partkey % 401 = 0 THEN 'NEW ' || p_type ELSE p_type END AS p_type FROM part),
known AS (SELECT DISTINCT p_type FROM part WHERE CAST(right(p_brand, 1) AS INT) % 3 <> 0),
facts AS (SELECT p_brand, count(*) AS n, min(p_type) FILTER (p_type NOT IN (SELECT p_type FROM known)) AS odd FROM asked GROUP BY ALL)
SELECT p_brand, 'new_level: p_type = ' || odd AS reason, CASE WHEN odd IS NULL THEN n ELSE 0 END AS ranked,
  CASE WHEN odd IS NULL THEN n ELSE 0 END AS same_score, CASE WHEN odd IS NULL THEN n ELSE 0 END AS last_rank FROM facts""")
def stored_ranker(spark, folder):
    """A ranker is fitted, written and read back; it then scores every brand's parts as one request.

    A request with a level that training did not have is refused. The rest are scored by the model in memory
    and by the one read back, and all scores have to be the same.
    """
    parts = graded_parts(spark, folder)
    fitted = ranker.fit(parts.filter("CAST(right(p_brand, 1) AS INT) % 3 <> 0"), SERVED)
    path = f"{session.stage_root(spark)}/rankloom/model-{uuid.uuid4().hex}"
    fitted.save(path)
    odd = F.when(F.col("p_partkey") % 401 == 0, F.concat(F.lit("NEW "), "p_type")).otherwise(F.col("p_type"))
    requests = parts.select("p_brand", "p_partkey", "p_size", "key_mod", odd.alias("p_type"))
    ranked, refused = scoring.score_requests(
        ranker.RankModel.load(spark, path), requests, "p_brand", "p_partkey")
    before = fitted.score(requests, "before").select("p_partkey", "before")
    scored = ranked.join(before, "p_partkey").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("ranked"), F.count_if(F.col("score") == F.col("before")).alias("same_score"),
        F.max("rank").alias("last_rank"))
    every = parts.select("p_brand").distinct().join(refused, "p_brand", "left").join(scored, "p_brand", "left")
    return every.select("p_brand", "reason", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ranked", "same_score", "last_rank")))


@register()
def ranker_search(spark, folder):
    """Two configurations compared on the same out-of-fold groups."""
    parts = graded_parts(spark, folder)
    results, _ = ranker.run_search(
        parts, "fold", replace(PARTS, rounds=1), n_configs=2, iterations=100, margin=None, folds=3
    )
    return rounded(results, "first_fold", "oof_ndcg", "vs_default", "vs_low", "vs_high")


@register()
def ranker_ablation(spark, folder):
    """What the ranker loses without a block of features."""
    parts = graded_parts(spark, folder)
    sets = {"full (5)": PARTS.features, "minus keys": ["p_size", "p_type", "p_name"]}
    out = ranker.run_ablations(
        parts, "fold", replace(PARTS, rounds=1), sets, folds=3, iterations=100
    )
    return out.select("ranker", "groups", rnd("ndcg").alias("ndcg"))


@register("WITH" + GRADED_SQL + """,
r AS (SELECT *, l_quantity / 50.0 AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity / 50.0 DESC, """ + TIES_SQL + """) AS rk FROM graded),
i AS (SELECT l_suppkey, sum((pow(2, grade) - 1) / log2(ir + 1)) AS ideal FROM (SELECT *, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY grade DESC) AS ir FROM graded) WHERE ir <= 30 GROUP BY ALL),
p AS (SELECT a.l_suppkey, a.rk AS ra, b.rk AS rb, abs(pow(2, a.grade) - pow(2, b.grade)) * abs(1 / log2(a.rk + 1) - 1 / log2(b.rk + 1)) / ideal AS d,
    CASE WHEN a.grade > b.grade THEN 1 ELSE -1 END AS sg, 1 / (1 + exp(CASE WHEN a.grade > b.grade THEN a.s - b.s ELSE b.s - a.s END)) AS pr
  FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.rk <= 30 AND b.rk > a.rk AND a.grade <> b.grade JOIN i ON i.l_suppkey = a.l_suppkey),
g AS (SELECT l_suppkey, ra AS rk, sg * pr * d AS g, pr * (1 - pr) * d AS h FROM p UNION ALL SELECT l_suppkey, rb, -sg * pr * d, pr * (1 - pr) * d FROM p),
t AS (SELECT l_suppkey, rk, sum(g) AS g, sum(h) AS h FROM g GROUP BY ALL)
SELECT """ + ", ".join(f"r.{c}" for c in TIES) + ", " + r_sql("coalesce(g, 0)", 9) + " AS gradient, " + r_sql("coalesce(h, 0)", 9)
          + " AS hessian FROM r LEFT JOIN t USING (l_suppkey, rk)")
def pair_gradients(spark, folder):
    """Pairwise gradients and hessians of one boosting round."""
    lines = graded_lines(spark, folder).withColumn("s", F.col("l_quantity") / F.lit(50.0))
    settings = ranker.Settings(group="l_suppkey", grade="grade", ids=tuple(TIES), truncation=30)
    out = ranker.pair_gradients(lines, settings, "s")
    return rounded(out.select(*TIES, "gradient", "hessian"), "gradient", "hessian", places=9)


@register("WITH" + GRADED_SQL + ", a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY " + TIES_SQL + """) AS p FROM graded),
b AS (SELECT l_suppkey, grade, row_number() OVER (PARTITION BY l_suppkey ORDER BY """
          + draws_sql("5", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber") + ", " + TIES_SQL + """) AS p FROM graded)
SELECT """ + ", ".join(f"a.{c}" for c in TIES) + ", b.grade FROM a JOIN b USING (l_suppkey, p)")
def permuted_grades(spark, folder):
    """Grades shuffled inside each group, for the leakage test."""
    lines = graded_lines(spark, folder)
    by_id = ranker.permuted_grades(
        lines, ["l_suppkey"], "grade", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 5
    )
    return by_id.select(*TIES, "grade")


# Ties in the four-column id are broken by the remaining columns in SQL; none exist at this scale.


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL, prefix="p") + ","
          + ndcg_sql("graded", "l_suppkey", "grade", "l_quantity", TIES_SQL, prefix="q") + """,
s AS (SELECT 0 AS config, l_suppkey, p.ndcg, 0.0 AS vs_default FROM p_ndcg p WHERE ndcg IS NOT NULL UNION ALL
  SELECT 1, l_suppkey, q.ndcg, q.ndcg - p.ndcg FROM q_ndcg q JOIN p_ndcg p USING (l_suppkey)),""" + bootstrap_sql(
    "s", "config", "vs_default", "l_suppkey", 200) + """
SELECT config, """ + r_sql("avg(s.ndcg)") + " AS oof_ndcg, count(s.ndcg) AS groups, " + ", ".join(
    r_sql(f"min(b_ci.{c})") + f" AS {n}" for n, c in (("vs_default", "vs_default"), ("vs_low", "vs_default_low"), ("vs_high", "vs_default_high")))
          + " FROM s JOIN b_ci USING (config) GROUP BY config")
def config_comparison(spark, folder):
    """Score sets of several configurations compared in one job."""
    return rounded(_configs(spark, folder), "oof_ndcg", "vs_default", "vs_low", "vs_high")


def _configs(spark, folder):
    lines = graded_lines(spark, folder)
    settings = ranker.Settings(group="l_suppkey", grade="grade", ids=tuple(TIES))
    stacked = None
    for i, column in enumerate((PRICE, "l_quantity")):
        one = lines.select(*TIES, "grade", F.lit(i).alias("config"), F.col(column).alias("score"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return ranker.compare_configs(stacked, settings, iterations=200)


@register("WITH" + GRADED_SQL + "," + ndcg_sql("graded", "l_suppkey", "grade", PRICE, TIES_SQL, prefix="p") + ","
          + ndcg_sql("graded", "l_suppkey", "grade", "l_quantity", TIES_SQL, prefix="q") + """,
s AS (SELECT l_suppkey, q.ndcg - p.ndcg AS d FROM q_ndcg q JOIN p_ndcg p USING (l_suppkey)),""" + bootstrap_sql("s", "", "d", "l_suppkey", 200)
          + "SELECT CAST(CASE WHEN d_low > 0 THEN 1 ELSE 0 END AS INT) AS config, d_low > 0 AS accepted FROM b_ci")
def accepted_config(spark, folder):
    """The acceptance rule: the interval must clear zero."""
    results = _configs(spark, folder).withColumn(
        "status", F.when(F.col("config") == 0, "default").otherwise("complete")
    )
    return ranker.accept(results)


@register("""
SELECT 'p_type' AS "column", p_type AS level FROM part GROUP BY ALL UNION ALL SELECT 'p_brand', p_brand FROM part GROUP BY ALL""")
def serving_levels(spark, folder):
    """Known levels per categorical input."""
    return scoring.serving_levels(table(spark, folder, "part"), ["p_type", "p_brand"])


@register("""
WITH known AS (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))
SELECT c_nationkey, 'c_mktsegment' AS "column", c_mktsegment AS level FROM customer
WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM known) GROUP BY ALL""")
def unseen_levels(spark, folder):
    """Levels in requests that training never had."""
    customers = table(spark, folder, "customer")
    trained = customers.filter("c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
    levels = scoring.serving_levels(trained, ["c_mktsegment"])
    return scoring.unseen_levels(customers, levels, "c_nationkey", ["c_mktsegment"])


# A request is an order, its candidates are the parts on it: repeats break the contract.
_REQUEST_SQL = """per_id AS (SELECT l_suppkey, CASE WHEN l_quantity > 1 OR l_tax > 0 THEN l_orderkey END AS id, count(*) AS n FROM lineitem GROUP BY ALL),
facts AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (id IS NULL), 0) AS BIGINT) AS no_id,
    count(*) FILTER (id IS NOT NULL AND n > 1) AS repeated FROM per_id GROUP BY ALL),
problems AS (SELECT l_suppkey, CASE WHEN rows > 640 THEN 'too_many: ' || rows || ' rows, 640 allowed'
    WHEN no_id > 0 THEN 'no_id: ' || no_id || ' rows' WHEN repeated > 0 THEN 'repeated_id: ' || repeated || ' ids' END AS reason FROM facts)"""


def _requests(spark, folder):
    named = F.when((F.col("l_quantity") > 1) | (F.col("l_tax") > 0), F.col("l_orderkey"))
    return table(spark, folder, "lineitem").withColumn("id", named)


@register("WITH " + _REQUEST_SQL + " SELECT l_suppkey, reason FROM problems WHERE reason IS NOT NULL")
def request_problems(spark, folder):
    """Candidate sets that break the contract, with the reason."""
    return scoring.request_problems(_requests(spark, folder), "l_suppkey", "id", cap=640)


@register("""
WITH c AS (SELECT l_suppkey, l_partkey AS id, sum(l_quantity) AS score FROM lineitem GROUP BY ALL)
SELECT l_suppkey, id, score, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, id) AS rank FROM c""")
def ranked_requests(spark, folder):
    """Contract-checked candidate sets, scored and ordered."""
    lines = table(spark, folder, "lineitem", "l_suppkey", F.col("l_partkey").alias("id"), "l_quantity")
    # Few lines repeat a candidate: dealt first, a task adds up its share and not what a large split holds.
    candidates, rows = session.measured(
        session.spread(lines, lines.count(), "l_suppkey", "id").groupBy("l_suppkey", "id").agg(
            F.sum("l_quantity").alias("score"))
    )
    kept, _ = scoring.reject(candidates, "l_suppkey", "id", numeric=["score"])
    out = scoring.rank_scored(kept, "l_suppkey", "id", at_most=rows)
    return out.select("l_suppkey", "id", "score", "rank")


@register("""
SELECT l_suppkey, count(*) AS n_listings, 2 AS n_features_supplied, 1 AS n_features_missing FROM lineitem GROUP BY ALL""")
def supplied_features(spark, folder):
    """Candidates and features per request."""
    return scoring.supplied_features(
        table(spark, folder, "lineitem"), "l_suppkey", ["l_quantity", "l_tax", "beds"]
    )


@register("""
SELECT l_suppkey, l_orderkey, l_quantity, l_tax, CAST(NULL AS DOUBLE) AS beds FROM lineitem""")
def built_requests(spark, folder):
    """Requests without the withheld truth; absent features are null."""
    return scoring.build_requests(
        table(spark, folder, "lineitem"), "l_suppkey", "l_orderkey", ["l_quantity", "l_tax", "beds"]
    )


_RANKED_PARTS = """ranked AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part)"""


def _ranked_parts(spark, folder):
    parts = table(spark, folder, "part", "p_brand", "p_partkey", "p_size")
    return scoring.rank_scored(parts, "p_brand", "p_partkey", "p_size")


@register("WITH " + _RANKED_PARTS + " SELECT r.*, p_retailprice, p_type, rank <= 10 AS in_top_k FROM ranked r JOIN part USING (p_partkey)")
def explained_ranking(spark, folder):
    """An ordering with the truth joined back."""
    ranked = _ranked_parts(spark, folder).select("p_brand", "p_partkey", "rank")
    truth = table(spark, folder, "part")
    return scoring.explain(ranked, truth, "p_partkey", ["p_retailprice", "p_type"])


@register("WITH " + _RANKED_PARTS + " SELECT p_brand, p_partkey, rank FROM ranked WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def ranks_of(spark, folder):
    """The ranks given to wanted candidates."""
    wanted = table(spark, folder, "lineitem").filter("l_quantity = 50").select(
        F.col("l_partkey").alias("p_partkey")
    ).distinct().join(table(spark, folder, "part", "p_partkey", "p_brand"), "p_partkey")
    return scoring.rank_of(_ranked_parts(spark, folder), wanted, "p_brand", "p_partkey")


@register("""
WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey % 5 AS grade, p_retailprice, p_partkey % 7 AS reviews, CAST(p_partkey % 11 AS DOUBLE) AS rating FROM part),
b AS (SELECT *, 0.5 * (rank() OVER (PARTITION BY p_brand ORDER BY rating) + (count(*) OVER (PARTITION BY p_brand, rating) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand)
  - 0.5 * (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) AS pr FROM p),"""
          + ",".join(ndcg_sql("b", "p_brand", "grade", c, "p_partkey", prefix=n) for n, c in (("e", "p_size"), ("v", "reviews"), ("w", "pr"))) + """,
chance AS (SELECT p_brand, CASE WHEN min(grade) < max(grade) THEN avg(gain) * sum(1 / log2(ir + 1)) FILTER (ir <= 10)
    / sum(gain / log2(ir + 1)) FILTER (ir <= 10) END AS random FROM e_ranked GROUP BY ALL)
SELECT p_brand, e.size AS n_listings, """ + r_sql("e.ndcg") + " AS endpoint, " + r_sql("v.ndcg") + " AS reviews, " + r_sql("w.ndcg")
          + " AS price_rating, " + r_sql("chance.random") + """ AS random, (SELECT count(*) FROM p WHERE p.p_brand = e.p_brand AND grade >= 3) AS n_relevant
FROM e_ndcg e JOIN v_ndcg v USING (p_brand) JOIN w_ndcg w USING (p_brand)
  JOIN chance USING (p_brand)""")
def query_quality(spark, folder):
    """Per request: NDCG of the scores, of both baselines and expected of a random order."""
    parts = table(spark, folder, "part").withColumns(
        {
            "grade": (F.col("p_partkey") % 5).cast("int"),
            "n_reviews": F.col("p_partkey") % 7,
            "rating": (F.col("p_partkey") % 11).cast("double"),
        }
    )
    out = scoring.query_quality(
        parts, "p_brand", "p_partkey", "grade", "p_size", "p_retailprice", "rating", "n_reviews",
    )
    return rounded(out, "endpoint", "reviews", "price_rating", "random")


@register("WITH " + _RANKED_PARTS + """,
w AS (SELECT p_brand, p_partkey FROM ranked WHERE rank = 1),
after AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN w.p_partkey IS NULL THEN p_size ELSE 0 END DESC, p_partkey) AS rank
  FROM part LEFT JOIN w USING (p_brand, p_partkey))
SELECT p_brand, p_partkey, b.rank AS rank_before, a.rank AS rank_after, b.rank - a.rank AS moved FROM ranked b JOIN after a USING (p_brand, p_partkey)""")
def counterfactual_movement(spark, folder):
    """Blank the leader of every request and watch the ranks move."""
    before = _ranked_parts(spark, folder)
    leaders = before.filter("rank = 1").select("p_brand", "p_partkey", F.lit(0).alias("p_size"))
    changed = scoring.perturb(
        before.drop("rank"), leaders, "p_brand", "p_partkey", ["p_size"]
    )
    after = scoring.rank_scored(changed, "p_brand", "p_partkey", "p_size")
    return scoring.rank_movement(before, after, "p_brand", "p_partkey")


@register("""
SELECT l_suppkey, count(*) AS n, CAST(sum(CASE WHEN l_tax = 0 THEN 0 ELSE l_linenumber END) AS BIGINT) AS number_of_reviews,
  count(*) FILTER (l_tax <> 0 AND l_discount > 0.05) AS has_reviews FROM lineitem GROUP BY ALL""")
def blanked_history(spark, folder):
    """Review history removed from a cohort's candidates."""
    lines = table(spark, folder, "lineitem").withColumns(
        {"number_of_reviews": F.col("l_linenumber"), "has_reviews": F.col("l_discount") > 0.05}
    )
    out = scoring.blank_columns(lines, scoring.COUNTERFACTUAL_BLANKS, F.col("l_tax") == 0)
    return out.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("number_of_reviews").alias("number_of_reviews"),
        F.count(F.when(F.col("has_reviews"), 1)).alias("has_reviews"),
    )


_INDEX_SQL = PART_GROUPS_SQL + """,
width AS (SELECT rung, group_key, count(*) AS group_size, count(DISTINCT p_brand) AS neighbourhoods, count(DISTINCT tier) AS tiers FROM part_groups GROUP BY ALL),
idx AS (SELECT p_type, p_brand, tier, rung, group_key, count(*) AS matching FROM part_groups GROUP BY ALL)"""


def _part_groups(spark, folder):
    grouped, _ = cascade.query_group(
        tiered_parts(spark, folder), PART_CASCADE, partition=("p_type",)
    )
    return grouped


@register("WITH " + _INDEX_SQL + " SELECT p_type, p_brand, tier, matching, group_size, neighbourhoods, tiers FROM idx JOIN width USING (rung, group_key)")
def search_index(spark, folder):
    """Every answerable search and the width of its group."""
    out = scoring.search_index(
        _part_groups(spark, folder), ["p_type", "p_brand", "tier"], "query_group", "p_brand", "tier"
    )
    return out.drop("query_group")


@register("WITH " + _INDEX_SQL + """, s AS (SELECT DISTINCT p_type, p_brand, '3-4' AS tier FROM part)
SELECT p_type, p_brand, tier, matching, group_size, neighbourhoods, tiers, neighbourhoods > 1 AS pooled FROM s JOIN idx USING (p_type, p_brand, tier) JOIN width USING (rung, group_key)""")
def resolved_searches(spark, folder):
    """A table of searches resolved to groups."""
    index = scoring.search_index(
        _part_groups(spark, folder), ["p_type", "p_brand", "tier"], "query_group", "p_brand", "tier"
    )
    searches = table(spark, folder, "part").select("p_type", "p_brand", F.lit("3-4").alias("tier"))
    answers, _ = scoring.resolve_searches(index, searches.distinct(), ["p_type", "p_brand", "tier"])
    return answers.drop("query_group")


@register("WITH " + PART_GROUPS_SQL + """
SELECT min(p_partkey) AS first_member, min(p_type) AS city, min(p_name) AS room_type, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS neighbourhood,
  count(DISTINCT p_brand) AS neighbourhoods, CASE WHEN count(DISTINCT tier) = 1 THEN min(tier) END AS capacity_tier, count(DISTINCT tier) AS tiers
FROM part_groups GROUP BY rung, group_key""")
def group_keys(spark, folder):
    """What each group holds, in search terms."""
    grouped = ordering.session.stage(_part_groups(spark, folder))
    first = grouped.groupBy("query_group").agg(F.min("p_partkey").alias("first_member"))
    out = scoring.group_key(grouped, "query_group", "p_type", "p_name", "p_brand", "tier")
    return out.join(first, "query_group").drop("query_group")


@register("""
WITH c AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS place, count(*) AS rows, count(*) FILTER (l_suppkey % 5 = 0) AS sealed FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS places, count(*) FILTER (sealed > 0) AS searchable, count(*) FILTER (sealed = 0) AS hidden,
  CAST(coalesce(sum(rows) FILTER (sealed = 0), 0) AS BIGINT) AS hidden_rows, CAST(sum(rows) AS BIGINT) AS rows,
  (SELECT place FROM c d WHERE d.l_returnflag = c.l_returnflag AND sealed = 0 ORDER BY rows DESC, place LIMIT 1) AS biggest_hidden
FROM c GROUP BY l_returnflag""")
def hidden_places(spark, folder):
    """What a sealed-only search cannot offer."""
    lines = table(spark, folder, "lineitem").withColumns(
        {"fold": F.col("l_suppkey") % 5, "place": F.date_format("l_shipdate", "yyyy-MM-dd")}
    )
    coverage = split.geography_coverage(lines, "fold", "l_returnflag", "place")
    return scoring.hidden_places(coverage, "l_returnflag", "place")
