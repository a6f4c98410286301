import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import series, windows


def monthly_frame(spark, values, key="a", first=datetime.date(2010, 1, 1)):
    rows = [(key, datetime.date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1), float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, month date, x double")


def test_undiff_of_diff_is_the_series(spark):
    x = np.exp(np.random.default_rng(1).normal(size=40))
    df = monthly_frame(spark, x)
    changed = series.log_diff(df, ["k"], "month", "x")
    back = windows.undiff(changed.withColumn("start", F.lit(math.log(x[0]))), ["k"], "month", "log_change", "start", "level")
    assert [r.level for r in back.orderBy("month").collect()] == pytest.approx(list(x[1:]))


def test_expanding_windows(spark):
    df = monthly_frame(spark, range(36))
    out = series.expanding_windows(df, "month", [2011, 2012, 2030])
    assert {r.window: r["count"] for r in out.groupBy("window").count().collect()} == {2011: 12, 2012: 24, 2030: 36}


def test_dickey_fuller_against_least_squares(spark):
    y = np.cumsum(np.random.default_rng(2).normal(size=60))
    got = series.dickey_fuller(monthly_frame(spark, y), ["k"], "month", "x").first()
    x = np.column_stack([np.ones(59), y[:-1]])
    beta, rss, *_ = np.linalg.lstsq(x, np.diff(y), rcond=None)
    error = math.sqrt(rss[0] / 57 * np.linalg.inv(x.T @ x)[1, 1])
    assert (got.n, got.slope, got.statistic) == (59, pytest.approx(beta[1]), pytest.approx(beta[1] / error))


def test_augmented_dickey_fuller_tells_noise_from_walk(spark):
    rng = np.random.default_rng(3)
    noise = monthly_frame(spark, rng.normal(size=120), "noise")
    walk = monthly_frame(spark, np.cumsum(rng.normal(size=120)), "walk")
    got = {r.k: r for r in series.augmented_dickey_fuller(noise.union(walk), ["k"], "month", "x").collect()}
    assert got["noise"].lags == 4
    assert got["noise"].p_value <= 0.05 < got["walk"].p_value


def test_difference_order(spark):
    rng = np.random.default_rng(4)
    frames = monthly_frame(spark, rng.normal(size=120), "0").union(
        monthly_frame(spark, np.cumsum(rng.normal(size=120) + 0.5), "1"))
    got = {r.k: r.differences for r in series.difference_order(frames, ["k"], "month", "x").collect()}
    assert got == {"0": 0, "1": 1}


def slow_loglik(y, ma, alpha, beta, nu):
    mu, var = y.mean(), y.var()
    omega, e, s2, total = var * (1 - alpha - beta), 0.0, var, 0.0
    for t, v in enumerate(y):
        if t:
            s2 = omega + alpha * e * e + beta * s2
        e = v - mu - ma * e
        z = e / math.sqrt(s2 * (nu - 2) / nu)  # plain Student's t
        total += (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
                  - (nu + 1) / 2 * math.log1p(z * z / nu) - 0.5 * math.log(s2 * (nu - 2) / nu))
    return total, e, s2


def test_loglik_against_a_plain_loop():
    y = np.random.default_rng(5).standard_t(5, size=50)
    grid = np.array([(0.0, 0.1, 0.8, 5.0), (-0.4, 0.2, 0.3, 8.0)])
    loglik, residual, sigma2 = series.garch_loglik(y, grid)
    for i, row in enumerate(grid):
        assert (loglik[i], residual[i], sigma2[i]) == pytest.approx(slow_loglik(y, *row))


def test_grid_takes_the_best_row(spark):
    y = np.random.default_rng(6).standard_t(5, size=60)
    grid = {"ma": [0.0, -0.4], "alpha": [0.05, 0.2], "beta": [0.3, 0.7], "nu": [4.0, 10.0]}
    both = monthly_frame(spark, y).union(monthly_frame(spark, [1.0, 2.0], "short"))
    got = {r.k: r for r in series.garch_grid(both, ["k"], "month", "x", grid).collect()}
    best = max(slow_loglik(y, m, a, b, n)[0] for m in grid["ma"] for a in grid["alpha"] for b in grid["beta"] for n in grid["nu"])
    assert got["a"].loglik == pytest.approx(best)
    assert got["short"].mu is None and got["short"].n == 2


@pytest.fixture()
def params(spark):
    return spark.createDataFrame(
        [("a", 0.01, -0.3, 0.002, 0.1, 0.8, 6.0, 0.05, 0.03, 5.0), ("b", None, None, None, None, None, None, None, None, 1.0)],
        "k string, mu double, ma double, omega double, alpha double, beta double, nu double, "
        "last_residual double, last_variance double, start double")


def test_forecast_recursion(params):
    got = series.garch_forecast(params, ["k"], 12).orderBy("step").collect()
    s2 = 0.002 + 0.1 * 0.05**2 + 0.8 * 0.03
    for i, r in enumerate(got):
        assert (r.step, r.sigma) == (i + 1, pytest.approx(math.sqrt(s2)))
        assert r.mean == pytest.approx(0.01 + (-0.3 * 0.05 if i == 0 else 0))
        assert r["var"] == pytest.approx(r.mean + r.sigma * 1.943180 * math.sqrt(4 / 6), rel=1e-5)
        s2 = 0.002 + 0.9 * s2
    assert len(got) == 12


def test_paths_do_not_depend_on_partitioning(spark, params):
    take = lambda df: {(r.path_id, r.step): r.level for r in df.collect()}
    one = take(series.simulate_paths(params, ["k"], 50, steps=3))
    other = take(series.simulate_paths(params.repartition(5).coalesce(2), ["k"], 50, steps=3))
    assert one == other and len(one) == 150
    blocks = take(series.simulate_paths(params, ["k"], 50, steps=3, block=7))
    assert set(blocks) == set(one) and len(set(blocks.values())) == 150


def test_paths_have_the_moments_of_the_model(params):
    paths = series.simulate_paths(params, ["k"], 20_000, steps=4)
    first = paths.filter("step = 1").agg(F.avg("change"), F.stddev("change"), F.count_distinct("change"), F.first("sigma")).first()
    assert first[0] == pytest.approx(0.01 - 0.3 * 0.05, abs=0.005)
    assert first[1] == pytest.approx(first[3], rel=0.05)
    assert first[2] == 20_000
    levels = paths.groupBy("path_id").agg(F.sum("change").alias("c"), F.max_by("level", "step").alias("l"))
    assert levels.filter(F.abs(F.log("l") - 5 - F.col("c")) > 1e-9).count() == 0


def test_paths_to_levels(params):
    paths = series.simulate_paths(params, ["k"], 20, steps=5).withColumnRenamed("level", "expected")
    out = series.paths_to_levels(paths.withColumn("start", F.lit(5.0)), ["k"], "start")
    assert out.filter(F.abs(F.col("level") / F.col("expected") - 1) > 1e-12).count() == 0 and out.count() == 100


def test_path_intervals(params):
    paths = series.simulate_paths(params, ["k"], 500, steps=2)
    got = series.path_intervals(paths, ["k"]).filter("step = 2").first()
    levels = [r.level for r in paths.filter("step = 2").collect()]
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(levels, [0.025, 0.975])))


def test_path_intervals_gather_no_group_in_python(params):
    paths = series.simulate_paths(params, ["k"], 300, steps=3)
    got = series.path_intervals(paths, ["k"])
    assert "FlatMapGroupsIn" not in got._jdf.queryExecution().toString()
    rows = {r.step: r for r in got.collect()}
    assert got.columns == ["k", "step", "low", "high", "mean"] and sorted(rows) == [1, 2, 3]
    for step, r in rows.items():
        levels = [p.level for p in paths.filter(F.col("step") == step).collect()]
        assert (r.low, r.high, r["mean"]) == pytest.approx((*np.quantile(levels, [0.025, 0.975]), np.mean(levels)))


def test_student_quantile():
    # published table values
    assert series.student_quantile(0.95, 10) == pytest.approx(1.812461, abs=1e-4)
    assert series.student_quantile(0.975, 30) == pytest.approx(2.042272, abs=1e-4)
