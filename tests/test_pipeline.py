"""Raw files to a trained, scored ranker on a small synthetic snapshot."""

import csv
import datetime
import gzip
import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rankloom.operators import assemble, ranker, scoring, split
from rankloom.operators.quality import CheckFailed
from rankloom.plans import features, processed, training
from rankloom.sources import raw, schemas, sinks

DAY0 = datetime.date(2026, 6, 29)
CITIES = {"athens": (37.9, 23.7), "crete": (35.3, 25.1)}


def write(path, header, data):
    with gzip.open(path, "wt", newline="") as handle:
        out = csv.writer(handle)
        out.writerow(header)
        out.writerows(data)


@pytest.fixture(scope="module")
def snapshot(tmp_path_factory):
    """Two markets of 60 listings: busy listings have more reviews and a lower price."""
    root = tmp_path_factory.mktemp("raw")
    source = random.Random(7)
    header = schemas.schema(schemas.LISTINGS).fieldNames()
    paths = {}
    for c, (city, (lat, lon)) in enumerate(CITIES.items()):
        listings, calendar, reviews = [], [], []
        for i in range(60):
            key = 2**60 + 1000 * c + i
            demand = source.random()
            n_reviews = 0 if i % 9 == 0 else 1 + int(40 * demand)
            row = dict.fromkeys(header, "")
            row |= {
                "id": key, "host_id": 5000 + i // 3 + 100 * c, "last_scraped": "2026-06-29",
                "host_location": "Athens, Greece" if i % 2 else "", "host_about": "hi" if i % 3 else "",
                "license": "00123" if i % 4 else "Exempt", "host_is_superhost": "t" if i % 5 == 0 else "f",
                "host_has_profile_pic": "t", "host_identity_verified": "t", "hosts_time_as_user_years": 3,
                "hosts_time_as_user_months": 4, "hosts_time_as_host_years": 2, "hosts_time_as_host_months": 1,
                "name": 'A "quoted"\nname', "neighbourhood_cleansed": f"n{i % 3}",
                "latitude": lat + source.random() / 50, "longitude": lon + source.random() / 50,
                "property_type": "Entire rental unit" if i % 2 else "Private room in home",
                "room_type": "Entire home/apt" if i % 2 else "Private room", "accommodates": 2 + i % 4,
                "bathrooms_text": "1.5 shared baths", "bedrooms": "" if i % 7 == 0 else 1, "beds": 2,
                "amenities": json.dumps(["Wifi", "Kitchen", "Pool view"][: 1 + i % 3]),
                "price": "" if i % 11 == 0 else f"${120 - 60 * demand:,.2f}", "minimum_nights": 2, "maximum_nights": 60,
                "availability_90": 0, "number_of_reviews": n_reviews, "number_of_reviews_ltm": n_reviews // 2,
                "reviews_per_month": n_reviews / 10 if n_reviews else "", "calculated_host_listings_count": 3,
                "calculated_host_listings_count_entire_homes": 1, "calculated_host_listings_count_private_rooms": 2,
                "calculated_host_listings_count_shared_rooms": 0, "host_listings_count": 3,
            }
            if n_reviews:
                row |= {"first_review": "2024-01-05", "last_review": "2026-06-01"}
                row |= {f"review_scores_{k}": 4 + demand for k in ("rating", "accuracy", "cleanliness", "checkin",
                                                                   "communication", "location", "value")}
            listings.append([row[h] for h in header])
            blocked = min(90, max(0, int(90 * (0.1 + 0.8 * demand))))
            for d in range(365):
                calendar.append([key, DAY0 + datetime.timedelta(days=d), "f" if d < blocked else "t", 2, 60])
            for k in range(n_reviews):
                when = DAY0 - datetime.timedelta(days=300 + k)
                reviews.append([key, 10**6 * (c + 1) + 100 * i + k, when, 1, "someone", "nice, really"])
        listings.append(listings[0])  # a repeated scrape row
        calendar += [[2**60 + 999_999, DAY0 + datetime.timedelta(days=d), "t", 1, 2] for d in range(365)]
        folder = root / city
        folder.mkdir()
        files = {"listings": (header, listings), "calendar": (schemas.schema(schemas.CALENDAR).fieldNames(), calendar),
                 "reviews": (schemas.schema(schemas.REVIEWS).fieldNames(), reviews)}
        paths[city] = {}
        for entity, (columns, data) in files.items():
            paths[city][entity] = str(folder / f"{entity}.csv.gz")
            write(paths[city][entity], columns, data)
    return root, paths


@pytest.fixture(scope="module")
def table(spark, snapshot):
    root, paths = snapshot
    # Orphan calendars are 1 of 61 keys per market: just over the default limit.
    with pytest.raises(CheckFailed, match="resolve"):
        processed.build(spark, paths, str(root / "strict"), "salt")
    out = str(root / "processed")
    known = spark.read.parquet(str(root / "strict/listings"))
    assert known.count() == 120 and known.select("id").distinct().count() == 120
    known.write.partitionBy("city").parquet(f"{out}/listings")
    for entity, process in (("calendar", processed.process_calendar), ("reviews", processed.process_reviews)):
        frames = [process(raw.load_raw(spark, files[entity], entity), "salt") for files in paths.values()]
        union = frames[0].unionByName(frames[1])
        union.join(known.select("id"), union.listing_id == known.id, "left_semi").write.parquet(f"{out}/{entity}")
    return features.build(spark, out, str(root / "features"))


def test_processed_listings_are_typed_and_anonymous(spark, snapshot, table):
    listings = spark.read.parquet(str(snapshot[0] / "strict/listings"))
    kinds = dict(listings.dtypes)
    assert kinds["price"] == "double" and kinds["amenities"] == "array<string>" and kinds["first_review"] == "date"
    assert kinds["id"] == "string" and "host_name" not in kinds and "license" not in kinds
    row = listings.filter("city = 'athens'").orderBy("id").first()
    assert len(row.id) == 64 and row.user_tenure_months == 40 and row.name == 'A "quoted"\nname' and row.bathrooms == 1.5
    assert set(schemas.ALL_NULL) & set(kinds) == set()


def test_null_id_stops_the_read(spark, tmp_path):
    path = str(tmp_path / "calendar.csv.gz")
    write(path, schemas.schema(schemas.CALENDAR).fieldNames(), [["", DAY0, "t", 1, 2], ["NA", DAY0, "t", 1, 2]])
    with pytest.raises(CheckFailed, match="null ids"):
        raw.require_ids(raw.load_raw(spark, path, "calendar"), "calendar")
    assert raw.raw_path("r", "crete", "reviews") == "r/crete/2026-06-29/reviews.csv.gz"
    with pytest.raises(CheckFailed):
        raw.raw_path("r", "paris", "reviews")


def test_feature_table_contract(spark, table):
    counts = assemble.check_feature_table(table)
    assert counts["rows"] == table.count() > 100
    inputs = assemble.feature_columns(table.columns)
    assert len(inputs) == counts["features"] == 61 and "grade" not in inputs and "query_group" not in inputs
    assert table.filter("price IS NULL OR nbhd_listings IS NULL OR density_1km IS NULL").count() == 0
    assert {r.grade for r in table.select("grade").distinct().collect()} >= {1, 2, 3, 4}
    assert table.filter("NOT has_reviews AND listing_age_days IS NOT NULL").count() == 0
    with pytest.raises(CheckFailed, match="label-adjacent"):
        assemble.check_feature_table(table.withColumn("availability_90", F.lit(1)))
    with pytest.raises(CheckFailed, match="diagnostic"):
        assemble.check_feature_table(table.withColumn("T", F.lit(1)))
    with pytest.raises(CheckFailed, match="repeated"):
        assemble.check_feature_table(table.unionByName(table))


def test_written_table_keeps_groups_together(spark, snapshot, table):
    files = spark.read.parquet(str(snapshot[0] / "features")).withColumn("_f", F.input_file_name())
    order = files.groupBy("_f").agg(F.min("query_group").alias("a"), F.max("query_group").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(order, order[1:]))


def settings_for(table):
    from rankloom.operators.listing import CATEGORICAL

    inputs = assemble.feature_columns(table.columns)
    return ranker.Settings(
        ids=("id",), numeric=tuple(c for c in inputs if c not in CATEGORICAL), categorical=CATEGORICAL,
        rounds=2, depth=3, min_rows=3, step=0.5, patience=2,
    )


def test_protocol_end_to_end(spark, table):
    settings = settings_for(table)
    out = training.run(table, settings, folds=3, seeds=(0,), iterations=20)
    sealed = {(r.slice, r.ranker): r for r in out["sealed"].collect()}
    model = sealed["overall", "model_seed0"]
    assert model.ndcg > model.floor and model.groups > 0
    assert {r.ranker for r in out["oof"].collect()} == {"model_oof", "reviews", "price_rating"}
    assert out["seeds"].first().deterministic is not None and out["importance"].count() == 61
    assert 1 <= out["rounds"] <= 2
    # The saved model scores a request table the same way.
    fitted = out["models"][0]
    candidates = table.select(F.col("query_group").alias("request"), "id", *settings.features)
    levels = scoring.serving_levels(table, settings.categorical)
    odd = candidates.filter("request = 0").withColumn("room_type", F.lit("Houseboat")).withColumn("request", F.lit(10**6).cast("long"))
    kept, rejects = scoring.reject(candidates.unionByName(odd), "request", "id", levels, settings.numeric, settings.categorical)
    assert [r.reason for r in rejects.collect()] == ["new_level: room_type = Houseboat"]
    ranked = scoring.rank_scored(fitted.score(kept), "request", "id")
    assert ranked.count() == table.count()
    blank = scoring.blank_columns(kept)
    moved = scoring.rank_movement(ranked, scoring.rank_scored(fitted.score(blank), "request", "id"), "request", "id")
    assert moved.count() == table.count()


def test_ablation_blocks(table):
    inputs = assemble.feature_columns(table.columns)
    sets = ranker.feature_sets(inputs)
    assert next(iter(sets)) == "full (61)" and len(sets["minus establishment"]) == 53
    assert len(sets["amenities: count"]) == 61 - 19 and sets["establishment only"] == ranker.block_members(inputs, "establishment")
    with pytest.raises(KeyError):
        ranker.block_members(inputs, "odd")
    with pytest.raises(CheckFailed):
        ranker.block_members(["a"], "establishment")
    with pytest.raises(CheckFailed):
        ranker.block_members(["a"], "spatial")


def test_withheld_columns_are_never_sent(spark, table):
    with pytest.raises(CheckFailed, match="grade"):
        scoring.build_requests(table, "query_group", "id", ["price", "grade"])


def test_ranker_learns_and_permuted_grades_do_not(spark):
    source = random.Random(2)
    data, i = [], 0
    for g in range(60):
        for _ in range(15):
            x = source.gauss(0, 1)
            data.append((i, g, g % 3, min(4, max(0, round(2 + x + source.gauss(0, 0.4)))), x, source.random()))
            i += 1
    df = spark.createDataFrame(data, "id int, query_group int, fold int, grade int, x double, junk double")
    settings = ranker.Settings(numeric=("x", "junk"), rounds=3, depth=3, min_rows=5, step=0.5)
    out = {r.trial: r.ndcg for r in training.leakage_test(df, settings, trials=1).collect()}
    assert out["real labels"] > out["random floor"] + 0.2
    assert abs(out["permuted 0"] - out["random floor"]) < 0.15
    same = ranker.permuted_grades(df, ["query_group"], "grade", ["id"], hot_rows=4)
    count = lambda d: sorted((r.query_group, r.grade, r["count"]) for r in d.groupBy("query_group", "grade").count().collect())
    assert count(same) == count(df)


def test_gradients_are_the_same_in_pieces(spark):
    df = spark.range(300).select(
        F.col("id"), (F.col("id") % 2).alias("query_group"), (F.col("id") * 7 % 5).cast("int").alias("grade"),
        (F.col("id") * 31 % 17 / 17.0).alias("score"),
    )
    a = ranker.pair_gradients(df, ranker.Settings())
    b = ranker.pair_gradients(df, ranker.Settings(), hot_rows=20)
    pick = lambda d: {r.id: (round(r.gradient, 9), round(r.hessian, 9)) for r in d.collect()}
    assert pick(a) == pick(b)
    total = a.groupBy("query_group").agg(F.sum("gradient").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in total)


def ranked_rows(spark):
    source = random.Random(4)
    rows = [(i, i // 12, i % 3, source.randrange(5), source.random(), f"level {min(i % 50, source.randrange(60))}", None if i % 9 == 0 else f"x{i}")
            for i in range(600)]
    return spark.createDataFrame(rows, "id int, query_group int, fold int, grade int, x double, kind string, name string")


def test_saved_model_scores_the_same(spark, tmp_path):
    df = ranked_rows(spark)
    settings = ranker.Settings(numeric=("x",), categorical=("kind", "name"), rounds=3, depth=3, min_rows=5, max_bins=16)
    for own in (settings, replace(settings, feature_share=0.5)):
        model = ranker.fit(df.filter("fold <> 0"), own, df.filter("fold = 0"))
        model.save(str(tmp_path / "model"))
        model.save(str(tmp_path / "model"))  # replaces what is there
        read = ranker.RankModel.load(spark.newSession(), str(tmp_path / "model"))
        assert read.settings == own and read.curve == model.curve and len(read.trees) == model.best_round
        pick = lambda m: sorted((r.id, r.score) for r in m.score(df).collect())
        assert pick(read) == pick(model) and len({s for _, s in pick(read)}) > 3
    odd = df.withColumn("kind", F.when(F.col("id") == 7, "never seen").otherwise(F.col("kind"))).drop("name")
    ranked, refused = scoring.score_requests(read, odd, "query_group", "id")
    unseen = [r.query_group for r in refused.collect()]
    assert 0 in unseen and ranked.filter(F.col("query_group").isin(unseen)).isEmpty()
    assert ranked.count() == 600 - 12 * len(unseen)


def test_levels_beyond_the_bins_share_a_code(spark):
    df = ranked_rows(spark)
    settings = ranker.Settings(categorical=("kind", "name"), max_bins=16)
    levels, codes = ranker.learned_levels(df, settings)
    assert codes == {"kind": 16, "name": 16}  # as many as bins, of 50 and 533 levels
    assert levels.filter("column = 'name'").count() == 533 and levels.filter("column = 'name' AND code > 1").count() == 14
    most = {r.level for r in df.groupBy(F.col("kind").alias("level")).count().orderBy(F.desc("count"), "level").limit(14).collect()}
    assert {r.level for r in levels.filter("column = 'kind' AND code > 1").collect()} == most
    vectors = ranker.encoded(df.withColumn("kind", F.lit("new")), settings, levels, codes).select("_features").distinct().collect()
    assert {v[0][0] for v in vectors} == {1.0} and {v[0][1] for v in vectors} >= {0.0, 1.0}


def test_rounds_move_and_write_no_features(spark):
    df = ranked_rows(spark)
    for c in range(30):
        df = df.withColumn(f"f{c}", F.rand(c))
    rows = ranker.matrix(df, ranker.Settings(numeric=tuple(f"f{c}" for c in range(30))))
    scores = ranker.session.stage_bucketed(rows.table.select("row", F.rand(1).alias("score")), "row", rows.buckets)
    assert scores.columns == ["row", "score"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.scored(scores, "_features")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "Bucketed: true" in plan
    narrow = rows.scored(scores, "grade")._jdf.queryExecution().executedPlan().toString()
    assert "_features" not in narrow


def test_search_configs_and_acceptance(spark):
    configs = ranker.sample_configs(5, seed=1)
    assert configs[0] == {} and len(configs) == 5 and configs == ranker.sample_configs(5, seed=1)
    assert ranker.sample_configs(9, seed=1)[:5] == configs and ranker.sample_configs(5, seed=2)[1:] != configs[1:]
    assert all(5 <= c["min_rows"] <= 100 and 0.05 <= c["step"] <= 0.5 and c["depth"] in (4, 5, 6, 7) for c in configs[1:])
    with pytest.raises(ValueError):
        ranker.sample_configs(0)
    schema = "config int, status string, vs_default double, vs_low double"
    good = spark.createDataFrame([(0, "default", 0.0, 0.0), (1, "complete", 0.02, 0.001), (2, "complete", 0.01, 0.005)], schema)
    assert tuple(ranker.accept(good).first()) == (1, True)
    bad = spark.createDataFrame([(0, "default", 0.0, 0.0), (1, "complete", 0.02, -0.001)], schema)
    assert tuple(ranker.accept(bad).first()) == (0, False)
    none = spark.createDataFrame([(0, "default", 0.0, 0.0), (3, "pruned", None, None)], schema)
    assert tuple(ranker.accept(none).first()) == (0, False)


def test_sealed_fold_is_in_no_cv_pair(spark):
    df = spark.range(50).withColumn("fold", F.col("id") % 5)
    for held, train, valid in split.dev_cv_splits(df, "fold"):
        assert {r.fold for r in valid.select("fold").distinct().collect()} == {held}
        assert {0, held} & {r.fold for r in train.select("fold").distinct().collect()} == set()


def test_manifest_reads_each_file(spark, snapshot):
    import hashlib
    import pathlib

    out = raw.manifest(spark, str(snapshot[0] / "athens")).collect()
    assert len(out) == 3
    for r in out:
        data = pathlib.Path(r.path.removeprefix("file:")).read_bytes()
        assert (r.size_bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_manifest_of_files_larger_than_a_task_reads(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    from rankloom.sources import chained

    rng = random.Random(4)
    noise = rng.randbytes(300_000)
    contents = {"noise.parquet": noise, "ended.csv": noise + b"\n", "mark [1] é.txt": b"\xef\xbb\xbf" + noise, "marked": b"\xef\xbb\xbfab\n" * 9_000,
                "ends": b"\n" * 70_000, "returns": b"\r\n\r" * 30_000, "one_line": b"x" * 80_000, "packed.gz": noise, "small": b"ab"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rounds = []
    monkeypatch.setattr(chained, "ROUND_BYTES", 1 << 16)
    monkeypatch.setattr(chained, "PIECE_BYTES", 1000)
    sets = chained.Chain.__init__
    monkeypatch.setattr(chained.Chain, "__init__", lambda self, state=None: (rounds.append(1), sets(self, state))[1])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in raw.manifest(spark, str(tmp_path), 50_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
    assert len(rounds) == 2 * 7  # seven files went from task to task: begun and ended on the driver


def test_pruned_scan(spark, snapshot):
    narrow = sinks.read_columns(spark, str(snapshot[0] / "strict/listings"), ["id"])
    assert "ReadSchema: struct<id:string>" in narrow._jdf.queryExecution().executedPlan().toString()
