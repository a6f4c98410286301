"""Parameter search that learns from its log: new trials are proposed where good ones lie
denser than bad ones, and trials that fall behind on few rows are not run on all."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.fixed_values import SEED
from quayside.operators.evaluation import regression_metrics
from quayside.operators.learners import boosted, fold_of

# A search space names settings: ("int", low, below), ("uniform", low, high), ("loguniform", low, high),
# ("choice", value, ...), and ("if", name, value, kind, ...), a setting that is there only when another has a value.
Space = dict[str, tuple]
Trial = tuple[float, dict]  # loss, parameters

LOG_SCHEMA = "loss double, params string, iteration int, train_time double, share double, finished boolean, losses string"


def _active(spec: tuple, params: dict) -> tuple | None:
    """A setting's own kind and range, or None where its condition does not hold."""
    while spec[0] == "if":
        if params.get(spec[1]) != spec[2]:
            return None
        spec = spec[3:]
    return spec


def draw(space: Space, rng: random.Random) -> dict:
    """One draw of all settings, conditions read in the order of the space."""
    out: dict = {}
    for name, given in space.items():
        spec = _active(given, out)
        if spec is not None:
            kind, *args = spec
            out[name] = (rng.randrange(*args) if kind == "int" else rng.uniform(*args) if kind == "uniform"
                         else math.exp(rng.uniform(*map(math.log, args))) if kind == "loguniform" else rng.choice(args))
    return out


class _Density:
    """How densely the values of one setting lie among some trials, smoothed: a kernel on each value and one over the whole range."""

    def __init__(self, spec: tuple, values: list):
        self.kind, *self.args = spec
        if self.kind == "choice":
            counts = [1 + sum(v == c for v in values) for c in self.args]
            self.weights = [c / sum(counts) for c in counts]
            return
        self.scale = math.log if self.kind == "loguniform" else float
        self.low, self.high = self.scale(self.args[0]), self.scale(self.args[1])
        self.points = [self.scale(v) for v in values]
        width = self.high - self.low
        self.sd = max(width / 50, width / (1 + len(values)) ** 0.5 / 2)

    def sample(self, rng: random.Random):
        if self.kind == "choice":
            return rng.choices(self.args, self.weights)[0]
        at = rng.randrange(len(self.points) + 1)
        x = rng.uniform(self.low, self.high) if at == len(self.points) else rng.gauss(self.points[at], self.sd)
        while not self.low <= x <= self.high:
            x = rng.gauss(self.points[at], self.sd)
        if self.kind == "int":
            return min(self.args[1] - 1, int(x))
        return math.exp(x) if self.kind == "loguniform" else x

    def log_density(self, value) -> float:
        if self.kind == "choice":
            return math.log(self.weights[self.args.index(value)])
        x = self.scale(value)
        kernels = sum(math.exp(-0.5 * ((x - p) / self.sd) ** 2) for p in self.points) / (self.sd * math.sqrt(2 * math.pi))
        return math.log((kernels + 1 / (self.high - self.low)) / (len(self.points) + 1))


def propose(space: Space, past: list[Trial], rng: random.Random, startup: int = 15, best: float = 0.25, candidates: int = 32) -> dict:
    """The next parameters to try. After ``startup`` plain draws the past is split into the
    ``best`` share and the rest; of some candidates drawn near the good ones, the one whose
    density there most exceeds that among the others is taken."""
    if len(past) < startup:
        return draw(space, rng)
    ranked = sorted(past, key=lambda t: t[0])
    cut = max(2, math.ceil(best * len(ranked)))
    good, bad = [p for _, p in ranked[:cut]], [p for _, p in ranked[cut:]]

    def candidate() -> tuple[float, dict]:
        out, gain = {}, 0.0
        for name, given in space.items():
            spec = _active(given, out)
            if spec is None:
                continue
            near, far = (_Density(spec, [p[name] for p in side if name in p]) for side in (good, bad))
            out[name] = near.sample(rng)
            gain += near.log_density(out[name]) - far.log_density(out[name])
        return gain, out
    return max((candidate() for _ in range(candidates)), key=lambda c: c[0])[1]


def read_log(spark: SparkSession, log: str) -> list:
    """The trials of a log in order; a log that is not there yet has none."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(log).orderBy("iteration").collect()  # a row per trial
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def sequential_search(spark: SparkSession, objective: Callable[[dict, float], float], space: Space, log: str, trials: int = 100,
                      shares: tuple[float, ...] = (1 / 9, 1 / 3, 1.0), keep: float = 0.5, seed: int = SEED, startup: int = 15) -> DataFrame:
    """Trials of ``objective(params, share of the rows)`` until the log has ``trials``; returns the log.

    A trial runs on growing shares of the rows and goes on only while its loss is among the
    best ``keep`` of all that reached the same share; one that stops keeps the loss it has,
    ``finished`` false. The log has the losses at all shares a trial reached. Proposals follow from the seed, the trial's number and the log alone,
    so a search that was broken off goes on as if it had not been. Each trial is added to the
    log as it ends; in a later run it only has to be read.
    """
    rows = read_log(spark, log)
    for number in range(len(rows) + 1, trials + 1):
        past = [(r.loss, json.loads(r.params)) for r in rows if r.finished] or [(r.loss, json.loads(r.params)) for r in rows]
        params = propose(space, past, random.Random(f"{seed}-{number}"), startup)
        start, losses = time.time(), []
        for at, share in enumerate(shares):
            losses.append(float(objective(params, share)))
            seen = sorted(x[at] for x in (json.loads(r.losses) for r in rows) if len(x) > at)
            if number > startup and seen and losses[at] > seen[math.floor(keep * (len(seen) - 1))]:
                break
        share = shares[len(losses) - 1]
        row = (losses[-1], json.dumps(params), number, time.time() - start, share, len(losses) == len(shares), json.dumps(losses))
        spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log)
        rows = read_log(spark, log)
    return spark.read.schema(LOG_SCHEMA).parquet(log) if rows else spark.createDataFrame([], LOG_SCHEMA)


def fit_objective(train: DataFrame, valid: DataFrame, target: str, key: list[str], make: Callable[..., Estimator] = boosted,
                  parts: int = 90) -> Callable[[dict, float], float]:
    """The mean absolute error on ``valid`` of a learner fitted on a share of ``train``; shares hold each other, by a hash of the key."""
    def objective(params: dict, share: float) -> float:
        rows = train if share >= 1 else train.filter(fold_of(key, parts) < max(1, round(share * parts)))
        return regression_metrics(make(target, **params).fit(rows).transform(valid), target, "prediction").first().mae
    return objective
