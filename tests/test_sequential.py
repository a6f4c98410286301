"""The sequential search: proposals, early stops, resuming."""

import json
import math
import random

import pytest

from quayside.operators import learners, sequential

SPACE = {"x": ("uniform", -5.0, 5.0), "n": ("int", 1, 20), "rate": ("loguniform", 1e-4, 1.0), "kind": ("choice", "a", "b", "c"),
         "depth": ("if", "kind", "b", "int", 1, 9)}


def loss(p):
    away = (p["x"] - 1.7) ** 2 + (p["n"] - 13) ** 2 / 20 + (math.log10(p["rate"]) + 2) ** 2
    return away + {"a": 3.0, "b": 0.3 * abs(p.get("depth", 1) - 4), "c": 5.0}[p["kind"]]


def test_draws_keep_to_the_space():
    rng, seen = random.Random(1), []
    for _ in range(300):
        p = sequential.draw(SPACE, rng)
        assert -5 <= p["x"] <= 5 and 1 <= p["n"] < 20 and 1e-4 <= p["rate"] <= 1
        assert ("depth" in p) == (p["kind"] == "b")
        seen.append(p)
    assert {p["kind"] for p in seen} == {"a", "b", "c"}
    assert 0.35 < sum(p["rate"] < 1e-2 for p in seen) / 300 < 0.65  # even on the logarithm


def best_of(seed, trials, learn):
    past = []
    for t in range(trials):
        rng = random.Random(f"{seed}-{t}")
        p = sequential.propose(SPACE, past, rng) if learn else sequential.draw(SPACE, rng)
        past.append((loss(p), p))
    return min(x for x, _ in past)


def test_it_beats_plain_draws_at_equal_budget():
    seeds = range(12)
    learnt, drawn = ([best_of(s, 60, learn) for s in seeds] for learn in (True, False))
    assert sum(a < b for a, b in zip(learnt, drawn, strict=True)) >= 9
    assert sum(learnt) < 0.7 * sum(drawn)


def test_proposals_follow_from_the_log_alone(spark, tmp_path):
    calls = []

    def objective(params, share):
        calls.append(share)
        return loss(params) + (1 - share)
    whole = sequential.sequential_search(spark, objective, SPACE, str(tmp_path / "whole"), trials=9, startup=4)
    sequential.sequential_search(spark, objective, SPACE, str(tmp_path / "parts"), trials=5, startup=4)
    parts = sequential.sequential_search(spark, objective, SPACE, str(tmp_path / "parts"), trials=9, startup=4)
    done = len(calls)
    again = sequential.sequential_search(spark, objective, SPACE, str(tmp_path / "parts"), trials=9, startup=4)
    assert len(calls) == done  # nothing is run again
    rows = [[(r.iteration, r.loss, r.params, r.share, r.finished) for r in df.orderBy("iteration").collect()] for df in (whole, parts, again)]
    assert rows[0] == rows[1] == rows[2] and [r[0] for r in rows[0]] == list(range(1, 10))


def test_trials_that_fall_behind_stop_early(spark, tmp_path):
    shares = []

    def objective(params, share):
        shares.append(share)
        return float(len(shares))  # each is worse than all before
    log = sequential.sequential_search(spark, objective, SPACE, str(tmp_path / "log"), trials=12, startup=2, shares=(0.25, 1.0))
    rows = log.orderBy("iteration").collect()
    assert all(r.finished for r in rows[:2]) and any(not r.finished and r.share == 0.25 for r in rows)


def test_a_learner_is_searched(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, x, 3 * x + rng.gauss(0, 0.1)) for i in range(300) for x in (rng.random(),)]
    from quayside.operators import features
    df = features.assemble(spark.createDataFrame(rows, "k long, x double, y double"), ["x"], "y").cache()
    objective = sequential.fit_objective(df.filter("k < 200"), df.filter("k >= 200"), "y", ["k"], make=lambda target, **p: learners.linear(target, 0.0, **p))
    space = {"alpha": ("loguniform", 1e-6, 100.0)}
    log = sequential.sequential_search(spark, objective, space, str(tmp_path / "log"), trials=6, startup=3, shares=(0.5, 1.0))
    best = min(log.collect(), key=lambda r: r.loss)
    assert best.loss < 0.2 and json.loads(best.params)["alpha"] < 1
    assert objective({"alpha": 1e-6}, 1.0) == pytest.approx(objective({"alpha": 1e-6}, 1.0))
