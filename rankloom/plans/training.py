"""The training protocol: split, cross-validate, refit, score the sealed fold once, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators import baseline, metrics, ordering, ranker, report, split


def run(
    table: DataFrame,
    settings: ranker.Settings,
    folds: int = split.DEFAULT_FOLDS,
    seeds: Sequence[int] = (0, 1, 2, 3, 4),
    split_seed: int = 0,
    city: str = "city",
    iterations: int = metrics.ITERATIONS,
    price: str = "price",
    rating: str = "rating_shrunk",
    reviews: str = "number_of_reviews",
) -> dict:
    """Every table of the protocol: ``folds, cv, oof, oof_band, sealed, sealed_vs_price_rating,
    seeds, importance``, plus the fitted ``models``.

    The sealed fold is scored once, by models refit on the whole development pool for the median
    number of rounds cross-validation chose.
    """
    group, ids = settings.group, list(settings.ids)
    folded, fold_report = split.assign_folds(
        table, group, "cluster_id", (city,), folds, split_seed
    )
    scored = baseline.rank_by_reviews(folded, reviews, "_reviews")
    scored = baseline.rank_by_price_and_rating(
        scored, [group], price, rating, name="_price_rating"
    )
    scored = session.stage(split.group_size_band(scored, group))
    floor = session.stage(report.expected_floor(scored, [group], settings.grade, settings.k))

    oof, cv = ranker.cross_validate(scored, "fold", settings, folds)
    rounds = ranker.median_round(cv)
    development = scored.filter(F.col("fold") != split.SEALED_FOLD)
    models = ranker.refit(development, settings, rounds, seeds)

    def compare(rows, rankers, reference, breakdown):
        return report.comparison_table(
            rows, [group], settings.grade, rankers, ids, reference, settings.k, breakdown,
            floor, iterations,
        )

    baselines = {"reviews": "_reviews", "price_rating": "_price_rating"}
    oof_rankers = {"model_oof": "score", **baselines}
    sealed = scored.filter(F.col("fold") == split.SEALED_FOLD)
    sealed_rankers = {}
    for seed, model in models.items():
        sealed = session.stage(model.score(sealed, f"_seed{seed}"))
        sealed_rankers[f"model_seed{seed}"] = f"_seed{seed}"
    sealed_rankers |= baselines
    sealed_table = compare(sealed, sealed_rankers, "reviews", city)
    return {
        "folds": fold_report,
        "cv": cv,
        "oof": compare(oof, oof_rankers, "reviews", city),
        "oof_band": compare(oof, oof_rankers, "reviews", "group_size_band"),
        "sealed": sealed_table,
        "sealed_vs_price_rating": compare(sealed, sealed_rankers, "price_rating", city),
        "seeds": report.summarise_seeds(sealed_table),
        "importance": models[seeds[0]].importance(table.sparkSession),
        "models": models,
        "oof_rows": oof,
        "rounds": rounds,
    }


def leakage_test(
    table: DataFrame, settings: ranker.Settings, trials: int = 3, fold: str = "fold"
) -> DataFrame:
    """Refit on grades shuffled inside each group: sealed NDCG should fall to the floor."""
    spark = table.sparkSession
    group, ids = settings.group, list(settings.ids)
    development = table.filter(F.col(fold) != split.SEALED_FOLD)
    sealed = ordering.session.stage(table.filter(F.col(fold) == split.SEALED_FOLD))
    rows = []
    for trial in range(trials):
        shuffled = ranker.permuted_grades(development, [group], settings.grade, ids, trial)
        model = ranker.fit(ordering.session.stage(shuffled), replace(settings, seed=trial))
        rows.append((f"permuted {trial}", ranker.mean_ndcg(model.score(sealed), settings)))
    control = ranker.fit(development, settings)
    rows.append(("real labels", ranker.mean_ndcg(control.score(sealed), settings)))
    floor = report.expected_floor(sealed, [group], settings.grade, settings.k)
    rows.append(("random floor", floor.agg(F.avg("floor")).first()[0]))
    return spark.createDataFrame(rows, "trial string, ndcg double")
