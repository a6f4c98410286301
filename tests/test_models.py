import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quayside.operators import evaluation, explain, features, learners, trials
from quayside.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def train(spark):
    df = spark.range(2_000).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("strong"),
        (F.pmod(F.xxhash64("id", F.lit("w")), F.lit(1000)) / 1000).alias("weak"),
        (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(1000)) / 1000).alias("noise"))
    df = df.withColumn("y", 10 * F.col("strong") + F.col("weak"))
    return features.assemble(df, ["strong", "weak", "noise"], "y").cache()


def test_target_cannot_be_a_feature(spark):
    with pytest.raises(ValueError):
        features.assemble(spark.range(1), ["id"], "id")


def test_dummies_equal_the_ml_encoding(spark):
    df = spark.createDataFrame([(v,) for v in "bacab"], "c string")
    levels = features.fit_levels(df, "c")
    assert levels == {"c": ["a", "b", "c"]}
    columns = sorted(tuple(r) for r in features.dummy_encode(df, levels).collect())
    assert columns == sorted([(1, 0), (0, 0), (0, 1), (0, 0), (1, 0)])
    model = features.dummy_pipeline(["c"]).fit(df)
    encoded = {r.c: sorted(r.v) for r in model.transform(df).select("c", vector_to_array("c_dummies").alias("v")).collect()}
    assert encoded == {"a": [0, 0], "b": [0, 1], "c": [0, 1]}


def test_levels_have_a_bound(spark):
    with pytest.raises(ValueError):
        features.fit_levels(spark.range(50).select(F.col("id").cast("string").alias("c")), "c", most=10)


def test_scaling_uses_training_bounds_only(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(20.0, 5.0), (None, 7.0)], "x double, c double")
    bounds = features.minmax_fit(df, ["x", "c"])
    assert [tuple(r) for r in features.minmax_apply(test, bounds, ["x", "c"]).collect()] == [(2.0, 0.0), (None, 0.0)]
    assert [r.x for r in features.inverse_scale(features.minmax_apply(df, bounds, ["x"]), bounds, "x", ["x"]).collect()] == [0.0, 10.0]


def test_question_dataset_keeps_the_target(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, "x")], "year int, y double, driver string")
    assert features.question_dataset(df, "y", ["year"], ["driver"]).columns == ["y", "driver"]
    with pytest.raises(ValueError):
        features.question_dataset(df, "y", ["y"], [])


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.normal(size=100), rng.normal(size=100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    got = evaluation.regression_metrics(df, "y", "p").first()
    assert got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("fit", [
    lambda d: learners.fit_linear(d, "y", 1.0, 1e-4), lambda d: learners.fit_linear(d, "y", 0.5, 1e-4),
    lambda d: learners.fit_random_forest(d, "y", trees=10, depth=6), lambda d: learners.fit_boosted(d, "y", maxIter=5)])
def test_learners_beat_the_mean(train, fit):
    errors = learners.score(fit(train), "y", train=train).first()
    assert errors.n == 2_000 and 0.8 < errors.r2 <= 1.0


def test_a_forest_of_many_rows_grows_in_groups_that_fit_a_cache(train, monkeypatch):
    few = learners.fit_random_forest(train, "y", trees=3, depth=3)
    monkeypatch.setattr(learners, "FOREST_ROWS", 2_000)
    many = learners.fit_random_forest(train, "y", trees=3, depth=3)
    assert many.getMaxMemoryInMB() <= 8 < few.getMaxMemoryInMB()
    assert many.getNumTrees == 3 and learners.score(many, "y", train=train).first().n == 2_000


def test_lasso_shrinks_with_the_penalty(train):
    small, large = (learners.fit_linear(train, "y", 1.0, a).coefficients.toArray() for a in (1e-4, 0.5))
    assert np.abs(large).sum() < np.abs(small).sum() and large[2] == 0


def test_folds_cover_all_rows(train):
    out = learners.kfold_error(train, lambda: learners.boosted("y", maxIter=3, maxDepth=3), "y", ["id"]).collect()
    assert sum(r.n for r in out) == 2_000 and {r.fold for r in out} == {0, 1, 2}


def test_grid_search_table(train):
    model, table = learners.grid_search(train, learners.linear("y"), {"regParam": [1e-4, 10.0]}, "y", ["id"])
    losses = {json.loads(r.params)["regParam"]: r.loss for r in table.collect()}
    assert losses[1e-4] < losses[10.0] and model.getRegParam() == 1e-4


def test_draws_follow_their_space_and_seed():
    drawn = [learners.draw_params(learners.BOOSTED_SPACE, 42, t) for t in range(50)]
    assert drawn == [learners.draw_params(learners.BOOSTED_SPACE, 42, t) for t in range(50)]
    for name, (kind, low, high) in learners.BOOSTED_SPACE.items():
        assert all(low <= d[name] <= high for d in drawn)


def test_search_resumes_from_its_log(train, tmp_path):
    log, made = str(tmp_path / "trials"), []

    def make(target, **params):
        made.append(params)
        return learners.linear(target, **params)

    space = {"alpha": ("uniform", 0.0, 1.0)}
    first = learners.random_search(train, train, "y", space, trials=2, log=log, make=make).collect()
    both = learners.random_search(train, train, "y", space, trials=4, log=log, make=make).collect()
    assert len(first) == 2 and len(made) == 4
    assert sorted(r.iteration for r in both) == [1, 2, 3, 4]


def test_importances_find_the_strong_feature(spark, train):
    forest = learners.fit_random_forest(train, "y", trees=10, depth=5)
    table = explain.impurity_importance(spark, forest, ["strong", "weak", "noise"]).collect()
    assert table[0].variable == "strong" and sum(r.feature_importance for r in table) == pytest.approx(1)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_permutation_importance(train, buckets):
    model = learners.fit_linear(train, "y", 1.0, 1e-6)
    table = {r.feature: r for r in explain.permutation_importance(
        model, train, "y", ["id"], ["strong", "weak", "noise"], buckets=buckets).collect()}
    # shuffling the feature that makes up almost all of y doubles its variance as error
    assert table["strong"].weight == pytest.approx(2, abs=0.15)
    assert abs(table["noise"].weight) < 0.01 < table["weak"].weight < 0.05


def test_shuffle_is_a_permutation(spark, train):
    out = explain.shuffled_features(train, ["id"], 2, 42, "features", 7).collect()
    for repeat in (1, 2):
        part = [r for r in out if r.repeat == repeat]
        assert sorted(tuple(r._f) for r in part) == sorted(tuple(r._other) for r in part)
        assert sum(tuple(r._f) == tuple(r._other) for r in part) < 10


def test_model_roundtrip(train, tmp_path):
    from pyspark.ml import Pipeline
    model = Pipeline(stages=[learners.linear("y")]).fit(train)
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert again.stages[0].coefficients == model.stages[0].coefficients


def test_params_with_single_quotes(spark):
    log = spark.createDataFrame([(0.5, "{'max_depth': 5, 'booster': 'dart', 'rate': 0.1}", 1), (0.4, "broken", 2)],
                                "loss double, params string, iteration int")
    out = trials.trials_to_columns(log, numeric=["max_depth", "rate"], text=["booster"]).orderBy("iteration").collect()
    assert (out[0].max_depth, out[0].rate, out[0].booster) == (5.0, 0.1, "dart")
    assert out[1].max_depth is None
    assert {r.parameter for r in trials.trials_to_rows(log).collect()} == {"max_depth", "booster", "rate"}
