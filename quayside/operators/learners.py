"""Regression learners on assembled features, and the search over their parameters.

Fits run as distributed Spark ML jobs; the driver only loops over parameter sets, as many
at once as asked for. Rows are cut into folds by a hash of their key, so a fold is the same
whenever the input is read again.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from quayside.fixed_values import SEED
from quayside.operators import trees, wide
from quayside.operators.evaluation import regression_metrics

# Penalties tried by the grid search.
ALPHAS = [0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0]

# Ranges of the parameter search, under the names of the learner's settings.
# ("int", low, high) draws whole numbers below high, ("uniform", low, high) real ones.
BOOSTED_SPACE = {
    "maxIter": ("int", 50, 700),
    "maxDepth": ("int", 6, 28),
    "subsamplingRate": ("uniform", 0.25, 0.95),
    "minInfoGain": ("uniform", 0.0, 15.0),
    "stepSize": ("uniform", 0.001, 0.3),
    "featureSubset": ("uniform", 0.3, 1.0),
    "minInstancesPerNode": ("int", 1, 30),
}


# Memory for split statistics per task: more lets one pass over the rows grow more nodes.
SPLIT_MEMORY_MB = 1024

# The same for forests of many rows, which :mod:`trees` grows: as much as a core's cache holds. With fewer rows the
# starts of its jobs cost more than they save, and Spark's own learners grow the trees.
FOREST_MEMORY_MB = 4
FOREST_ROWS = 500_000


def random_forest(target: str, trees: int = 100, depth: int = 10, seed: int = SEED,
                  memory_mb: int = SPLIT_MEMORY_MB) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed,
                                 maxMemoryInMB=memory_mb)


def linear(target: str, l1_ratio: float = 1.0, alpha: float = 0.001, max_iter: int = 100) -> LinearRegression:
    """Lasso at ``l1_ratio`` 1, elastic net below. The penalty applies to the features as
    they are, so they should be scaled."""
    return LinearRegression(labelCol=target, elasticNetParam=l1_ratio, regParam=alpha, maxIter=max_iter,
                            standardization=False)


def boosted(target: str, seed: int = SEED, **params) -> GBTRegressor:
    """Gradient boosted trees; ``featureSubset`` is the share of features tried per split."""
    if "featureSubset" in params:
        params["featureSubsetStrategy"] = str(params.pop("featureSubset"))
    return GBTRegressor(labelCol=target, seed=seed, maxMemoryInMB=SPLIT_MEMORY_MB, **params)


def fit_random_forest(train: DataFrame, target: str, **params) -> Model:
    """A forest on all rows. Rows and features are drawn at random, so trees differ with the learner that
    the number of rows calls for, as they do with the partitioning of the rows."""
    rows = train.count()
    many = rows >= FOREST_ROWS
    learner = random_forest(target, **{"memory_mb": FOREST_MEMORY_MB if many else SPLIT_MEMORY_MB, **params})
    if many and learner.getMaxDepth() > 0 and narrow(train):
        return trees.fit_forest(train, learner, rows)
    return learner.fit(train)


def fit_linear(train: DataFrame, target: str, l1_ratio: float = 1.0, alpha: float = 0.001) -> Model:
    return linear(target, l1_ratio, alpha).fit(train)


# Features up to which the normal equations are solved on the driver.
DRIVER_FEATURES = 4096


def fit_least_squares(train: DataFrame, target: str) -> Model | wide.LeastSquares:
    """Least squares without a penalty. Up to ``DRIVER_FEATURES`` features the normal equations are solved on the driver; beyond,
    they and the coefficients are tables."""
    first = train.select("features").first()
    if first is not None and first.features.size > DRIVER_FEATURES:
        return wide.fit_least_squares(train, target)
    return LinearRegression(labelCol=target, regParam=0.0, solver="normal" if first is not None else "l-bfgs", maxIter=1000, tol=1e-10,
                            standardization=True).fit(train)


def fit_boosted(train: DataFrame, target: str, **params) -> Model:
    rows = train.count()
    if rows >= FOREST_ROWS and binnable(params) and narrow(train):
        return trees.fit_boosted(train, boosted(target, **params), rows)
    return boosted(target, **params).fit(train)


def narrow(train: DataFrame) -> bool:
    """Whether a byte for every feature of every row is little."""
    first = train.select("features").first()
    return first is not None and first.features.size <= trees.WIDE


def binnable(settings: dict) -> bool:
    """Whether :mod:`trees` knows all these settings of boosted trees."""
    return set(settings) <= {*trees.BOOSTED_SETTINGS, "seed"} and settings.get("maxDepth") != 0


def score(model: Model, target: str, **sets: DataFrame) -> DataFrame:
    """Errors of a model on named sets of rows, in one job."""
    out = None
    for name, rows in sets.items():
        y = F.col(target).cast("double").alias("y")
        scored = trees.predicted(model, rows, y) if hasattr(model, "binned") else model.transform(rows).select(y, "prediction")
        part = scored.select(F.lit(name).alias("rows"), "y", "prediction")
        out = part if out is None else out.unionByName(part)
    return regression_metrics(out, "y", "prediction", ["rows"])


def fold_of(key: list[str], folds: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds)).cast("int")


def grid_search(train: DataFrame, estimator: Estimator, grid: dict[str, list], target: str, key: list[str],
                folds: int = 3, metric: str = "mae", parallelism: int = 4) -> tuple[Model, DataFrame]:
    """Best model refitted on all rows, and one row per parameter set with its mean error."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, numFolds=folds, foldCol="_fold",
                            evaluator=RegressionEvaluator(labelCol=target, metricName=metric),
                            parallelism=parallelism, seed=SEED)
    fitted = search.fit(train.withColumn("_fold", fold_of(key, folds)))
    rows = [(json.dumps({p.name: v for p, v in m.items()}), float(e)) for m, e in zip(maps, fitted.avgMetrics)]
    return fitted.bestModel, train.sparkSession.createDataFrame(rows, "params string, loss double")


def kfold_error(train: DataFrame, make: Callable[[], GBTRegressor], target: str, key: list[str],
                folds: int = 3) -> DataFrame:
    """Error of every fold. The fold held out also stops the boosting: rounds end once they
    no longer lower its error. Columns ``fold, rounds, n, mae, mse, rmse, r2``."""
    rows = train.withColumn("_fold", fold_of(key, folds))

    def one(fold: int) -> DataFrame:
        marked = rows.withColumn("_held_out", F.col("_fold") == fold)
        model = make().setValidationIndicatorCol("_held_out").fit(marked)
        held_out = model.transform(marked.filter("_held_out"))
        return regression_metrics(held_out, target, "prediction").select(
            F.lit(fold).alias("fold"), F.lit(model.getNumTrees).alias("rounds"), "*")

    out = one(0)
    for fold in range(1, folds):
        out = out.unionByName(one(fold))
    return out


def draw_params(space: dict[str, tuple], seed: int, trial: int) -> dict:
    """The parameters of one trial; they depend on seed and trial number only."""
    rng = random.Random(f"{seed}-{trial}")
    draws = {"int": lambda lo, hi: rng.randrange(lo, hi), "uniform": rng.uniform,
             "choice": lambda *values: rng.choice(values)}
    return {name: draws[kind](*args) for name, (kind, *args) in space.items()}


def random_search(train: DataFrame, valid: DataFrame, target: str, space: dict[str, tuple] = BOOSTED_SPACE,
                  trials: int = 100, seed: int = SEED, log: str | None = None, parallelism: int = 2,
                  make: Callable[..., Estimator] = boosted) -> DataFrame:
    """Trial table ``loss, params, iteration, train_time``; the loss is the mean absolute
    error on ``valid``. With ``log`` every trial is added there as it ends, in a folder of
    its own since trials end at the same time, and trials the log has are not run again.

    Boosted trees read rows that are binned once for all trials. Up to ``trees.TASK_ROWS`` rows a trial
    is one task, and as many run at once as there are cores; beyond, each is grown by all tasks."""
    spark = train.sparkSession
    schema = "loss double, params string, iteration int, train_time double"
    done: set[int] = set()
    if log:
        try:
            done = {r.iteration for r in spark.read.schema(schema).parquet(log).select("iteration").collect()}
        except AnalysisException as missing:  # no trial has been logged yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise

    todo = [t for t in range(1, trials + 1) if t not in done]
    loss_of = None
    if todo and make is boosted and binnable(space) and narrow(train):
        rows = train.count()
        blocks = trees.binned(train, target, held_out=valid, rows=rows)
        in_task = rows + valid.count() <= trees.TASK_ROWS
        parallelism = max(parallelism, spark.sparkContext.defaultParallelism) if in_task else parallelism
        loss_of = lambda params: trees.boosted_loss(blocks, boosted(target, **params), in_task)

    def one(trial: int):
        params = draw_params(space, seed, trial)
        start = time.time()
        if loss_of is not None:
            loss = loss_of(params)
        else:
            model = make(target, **params).fit(train)
            loss = regression_metrics(model.transform(valid), target, "prediction").first().mae
        row = spark.createDataFrame([(float(loss), json.dumps(params), trial, time.time() - start)], schema)
        if log:
            row.drop("iteration").coalesce(1).write.mode("overwrite").parquet(f"{log}/iteration={trial}")
        return row

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, todo))
    if log:
        return spark.read.schema(schema).parquet(log)
    if not rows:
        return spark.createDataFrame([], schema)
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
