"""Monthly time series: windows, unit roots, ARMA-GARCH by grid, simulated paths.

A series has one row per month, so grouping by series never makes a group longer than the
calendar. Only the recursions over a whole series run in Python, per series and with
numpy; the grid of parameters is a vector there, not rows.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quayside.fixed_values import FORECAST_STEPS, INTERVAL_PROBS, SEED, WINDOW_CUTOFF_YEARS
from quayside.operators.joins import enrich, measured
from quayside.operators.quantiles import quantiles
from quayside.operators.windows import diff, undiff


def log_diff(series: DataFrame, keys: list[str], month: str, value: str, log: str = "log_value",
             out: str = "log_change") -> DataFrame:
    """Log level and its first difference, per series of positive monthly totals."""
    return diff(series.withColumn(log, F.log(value)), keys, month, log, out)


def expanding_windows(series: DataFrame, month: str, cutoff_years: list[int] = WINDOW_CUTOFF_YEARS) -> DataFrame:
    """Each row once per training window that ends after it; ``window`` is the year it ends before."""
    windows = F.explode(F.array(*(F.lit(y) for y in cutoff_years)))
    return series.withColumn("window", windows).filter(F.year(month) < F.col("window"))


def dickey_fuller(series: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Dickey-Fuller regression without lags: the change on the level before it."""
    changed = diff(series.select(*keys, month, value), keys, month, value, "_dy") \
        .select(*keys, "_dy", (F.col(value) - F.col("_dy")).alias("_y"))
    fitted = changed.groupBy(*keys).agg(
        F.regr_slope("_dy", "_y").alias("slope"), F.regr_count("_dy", "_y").alias("n"),
        F.regr_sxx("_dy", "_y").alias("_sxx"), F.regr_syy("_dy", "_y").alias("_syy"))
    residual = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    error = F.sqrt(F.try_divide(residual, (F.col("n") - 2) * F.col("_sxx")))
    return fitted.withColumn("statistic", F.try_divide(F.col("slope"), error)).select(*keys, "n", "slope", "statistic")


# Published critical values of the Dickey-Fuller statistic with constant and
# trend; one row per sample size, one column per probability.
DF_PROBS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
DF_SIZES = [25, 50, 100, 250, 500, 100_000]
DF_TABLE = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]
# Fixed value: 5 % critical value of the KPSS statistic around a level.
KPSS_CRITICAL = 0.463


def _sorted_values(pdf: pd.DataFrame, month: str, value: str) -> np.ndarray:
    return pdf.sort_values(month)[value].to_numpy(dtype=float)


def _per_series(df: DataFrame, keys: list[str], fn, out: str) -> DataFrame:
    """Applies ``fn(group) -> dict`` to every series; ``out`` are the result columns."""
    schema = T.StructType([df.schema[k] for k in keys] + T.StructType.fromDDL(out).fields)

    def run(key, pdf):
        return pd.DataFrame([{**dict(zip(keys, key)), **fn(pdf)}], columns=schema.names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def augmented_dickey_fuller(series: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """Dickey-Fuller statistic with constant, trend and ``(n - 1) ** (1/3)`` lagged changes,
    with its p-value interpolated in the published table."""
    def test(pdf):
        y = _sorted_values(pdf, month, value)
        lags = int((len(y) - 1) ** (1 / 3))
        k = lags + 1
        dy = np.diff(y)
        rows = len(dy) - k + 1
        empty = {"n": len(y), "lags": lags, "statistic": None, "p_value": None}
        x = [np.ones(rows), y[k - 1:-1], np.arange(k, len(dy) + 1)]
        x += [dy[k - 1 - i:len(dy) - i] for i in range(1, k)]
        x = np.column_stack(x)
        if rows <= x.shape[1]:
            return empty
        target = dy[k - 1:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        spread = np.sum((target - x @ beta) ** 2) / (rows - x.shape[1])
        error = math.sqrt(spread * np.linalg.pinv(x.T @ x)[1, 1])
        if error == 0:
            return empty
        statistic = float(beta[1] / error)
        critical = [np.interp(len(dy), DF_SIZES, column) for column in zip(*DF_TABLE)]
        return {**empty, "statistic": statistic, "p_value": float(np.interp(statistic, critical, DF_PROBS))}

    return _per_series(series.select(*keys, month, value), keys, test,
                       "n int, lags int, statistic double, p_value double")


def kpss_statistic(y: np.ndarray) -> float:
    """KPSS statistic around a level, Bartlett weights up to lag ``3 * sqrt(n) / 13``."""
    n = len(y)
    residual = y - y.mean()
    lags = int(3 * math.sqrt(n) / 13)
    variance = residual @ residual / n
    for s in range(1, lags + 1):
        variance += 2 / n * (1 - s / (lags + 1)) * (residual[s:] @ residual[:-s])
    return float(np.sum(np.cumsum(residual) ** 2) / n**2 / variance) if variance > 0 else 0.0


def difference_order(series: DataFrame, keys: list[str], month: str, value: str, most: int = 2) -> DataFrame:
    """Smallest number of differences after which the KPSS test accepts a level series."""
    def order(pdf):
        y = _sorted_values(pdf, month, value)
        d, statistic = 0, kpss_statistic(y)
        while statistic > KPSS_CRITICAL and d < most and len(y) > 2:
            y, d = np.diff(y), d + 1
            statistic = kpss_statistic(y)
        return {"differences": d, "statistic": statistic}

    return _per_series(series.select(*keys, month, value), keys, order, "differences int, statistic double")


# Candidate parameters; ``ma`` of 0 only is the ARMA(0,0) model.
GARCH_GRID = {
    "ma": [-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4],
    "alpha": [0.02, 0.05, 0.1, 0.2, 0.3],
    "beta": [0.1, 0.3, 0.5, 0.7, 0.8, 0.9],
    "nu": [4.0, 6.0, 10.0, 30.0],
}
FIT_COLUMNS = ("n int, mu double, ma double, omega double, alpha double, beta double, nu double, loglik double, "
               "last_residual double, last_variance double")


def garch_loglik(y: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of ARMA(0,1)-GARCH(1,1) with Student errors at every grid row
    ``(ma, alpha, beta, nu)``, with the last residual and variance. The mean is the sample
    mean; omega makes the long-run variance that of the sample."""
    ma, alpha, beta, nu = grid.T
    mu, variance = y.mean(), y.var()
    omega = variance * (1 - alpha - beta)
    gamma = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in nu])
    constant = gamma - 0.5 * np.log(np.pi * (nu - 2))
    residual, sigma2 = np.zeros(len(grid)), np.full(len(grid), variance)
    loglik = np.zeros(len(grid))
    for t, value in enumerate(y):
        if t:
            sigma2 = omega + alpha * residual**2 + beta * sigma2
        residual = value - mu - ma * residual
        loglik += constant - 0.5 * np.log(sigma2) - (nu + 1) / 2 * np.log1p(residual**2 / sigma2 / (nu - 2))
    return loglik, residual, sigma2


def garch_grid(series: DataFrame, keys: list[str], month: str, value: str,
               grid: dict[str, list[float]] = GARCH_GRID, least: int = 12) -> DataFrame:
    """Best parameters of every series among the grid, by likelihood. Series shorter than
    ``least`` or without variance get null parameters."""
    rows = np.array([r for r in product(grid["ma"], grid["alpha"], grid["beta"], grid["nu"]) if r[1] + r[2] < 1])

    def fit(pdf):
        y = _sorted_values(pdf, month, value)
        if len(y) < least or y.var() == 0:
            return {"n": len(y)}
        loglik, residual, sigma2 = garch_loglik(y, rows)
        best = int(np.argmax(loglik))
        ma, alpha, beta, nu = rows[best]
        return {"n": len(y), "mu": y.mean(), "ma": ma, "omega": y.var() * (1 - alpha - beta), "alpha": alpha,
                "beta": beta, "nu": nu, "loglik": loglik[best], "last_residual": residual[best],
                "last_variance": sigma2[best]}

    return _per_series(series.select(*keys, month, value), keys, fit, FIT_COLUMNS)


def student_quantile(p: float, nu: float) -> float:
    """Quantile of Student's t, by bisection on its distribution function."""
    grid = np.linspace(0.0, 1.0, 2001)
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)

    def cdf(x: float) -> float:
        density = scale * (1 + (grid * x) ** 2 / nu) ** (-(nu + 1) / 2)
        return 0.5 + float(np.trapezoid(density, grid * x))

    low, high = -1e3, 1e3
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def garch_forecast(params: DataFrame, keys: list[str], steps: int = FORECAST_STEPS, var_level: float = 0.95,
                   nus: list[float] = GARCH_GRID["nu"]) -> DataFrame:
    """Mean, volatility and value-at-risk for each coming step: ``keys, step, mean, sigma, var``."""
    first = F.col("omega") + F.col("alpha") * F.col("last_residual") ** 2 + F.col("beta") * F.col("last_variance")
    persistence = F.col("alpha") + F.col("beta")
    long_run = F.col("omega") / (1 - persistence)
    step = F.col("step")
    quantile = F
    for nu in nus:
        quantile = quantile.when(F.col("nu") == nu, student_quantile(var_level, nu) * math.sqrt((nu - 2) / nu))
    return (params.filter(F.col("mu").isNotNull())
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
            .withColumns({
                "mean": F.col("mu") + F.when(step == 1, F.col("ma") * F.col("last_residual")).otherwise(0.0),
                "sigma": F.sqrt(long_run + F.pow(persistence, step - 1) * (first - long_run))})
            .withColumn("var", F.col("mean") + F.col("sigma") * quantile.otherwise(None))
            .select(*keys, "step", "mean", "sigma", "var"))


def simulate_paths(params: DataFrame, keys: list[str], paths: int, start: str = "start",
                   steps: int = FORECAST_STEPS, seed: int = SEED, block: int = 1_000) -> DataFrame:
    """Simulated futures of every fitted series, one row per path and step:
    ``keys, path_id, step, change, sigma, level``; levels go on from the log level ``start``.

    Paths are dealt out in blocks, so one series alone still uses the whole cluster. A
    block is a small matrix of paths by steps, its levels are summed there, with no shuffle.
    The generator of a block is seeded by series and block number: the paths are the same
    however the blocks are spread and however often a block is run again.
    """
    blocks = -(-paths // block)
    numbers = ["mu", "ma", "omega", "alpha", "beta", "nu", "last_residual", "last_variance", start]
    dealt = (params.filter(F.col("mu").isNotNull())
             .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select(*keys, *numbers, "_block", F.xxhash64(*keys, "_block", F.lit(seed)).alias("_seed"))
             .repartition(*keys, "_block"))
    schema = T.StructType([params.schema[k] for k in keys] + T.StructType.fromDDL(
        "path_id int, step int, change double, sigma double, level double").fields)

    names = schema.names

    def one_block(row: dict) -> pa.RecordBatch:
        first = row["_block"] * block
        n = min(block, paths - first)
        rng = np.random.Generator(np.random.Philox(row["_seed"] % 2**63))
        nu, residual, variance = row["nu"], np.full(n, row["last_residual"]), np.full(n, row["last_variance"])
        change, sigma = np.empty((n, steps)), np.empty((n, steps))
        for step in range(steps):
            variance = row["omega"] + row["alpha"] * residual**2 + row["beta"] * variance
            drawn = np.sqrt(variance * (nu - 2) / nu) * rng.standard_t(nu, n)
            change[:, step] = row["mu"] + row["ma"] * residual + drawn
            sigma[:, step], residual = np.sqrt(variance), drawn
        level = np.exp(row[start] + np.cumsum(change, axis=1))
        path = np.repeat(np.arange(first, first + n, dtype=np.int32), steps)
        step = np.tile(np.arange(1, steps + 1, dtype=np.int32), n)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(row[k], n * steps) for k in keys]
            + [pa.array(x) for x in (path, step, change.ravel(), sigma.ravel(), level.ravel())], names=names)

    def run(batches):
        for batch in batches:
            # the key columns as Arrow scalars, so that they keep their types
            for i, row in enumerate(batch.to_pylist()):
                yield one_block({**row, **{k: batch.column(k)[i] for k in keys}})

    return dealt.mapInArrow(run, schema)


def paths_to_levels(paths: DataFrame, keys: list[str], start: str, change: str = "change", out: str = "level") -> DataFrame:
    """Levels of paths given as changes: each path goes on from its log level ``start``."""
    return undiff(paths, [*keys, "path_id"], "step", change, start, out)


def path_intervals(paths: DataFrame, keys: list[str], value: str = "level",
                   probs: list[float] = INTERVAL_PROBS) -> DataFrame:
    """Pointwise interval and mean per step: ``keys, step, low, high, mean``. The quantiles are
    exact; the paths are written once, and those of a series and step are gathered nowhere."""
    by = [*keys, "step"]
    paths = measured(paths.select(*by, value))  # read three times
    ends = quantiles(paths, value, [probs[0], probs[-1]], by).groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    means = paths.groupBy(*by).agg(F.avg(value).alias("mean"))
    return enrich(ends, means, {c: c for c in by}, "inner", null_safe=True).select(*by, "low", "high", "mean")
