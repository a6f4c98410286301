"""Search logs: one row per trial with its loss, parameters as text, iteration and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayside.operators.windows import accumulate, row_numbers


def parse_params(c: Column | str) -> Column:
    """Map from a dict literal with single or double quotes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, "map<string,string>", {"allowSingleQuotes": "true"})


def trials_to_rows(log: DataFrame, params: str = "params") -> DataFrame:
    """One row per trial and parameter."""
    rest = [c for c in log.columns if c != params]
    return log.select(*rest, F.explode(parse_params(params)).alias("parameter", "setting"))


def trials_to_columns(log: DataFrame, numeric: list[str] = (), text: list[str] = (),
                      params: str = "params") -> DataFrame:
    """One column per named parameter. No pivot: the map is read by key, row by row."""
    parsed = log.withColumn("_m", parse_params(params))
    return parsed.withColumns({**{p: F.col("_m")[p].try_cast("double") for p in numeric},
                               **{p: F.col("_m")[p] for p in text}}).drop("_m", params)


def rank_trials(log: DataFrame, metric: str = "loss", tie: str = "iteration") -> DataFrame:
    """Trials with their position by metric, best first."""
    return row_numbers(log, [F.col(metric), F.col(tie)], "rank")


def best_so_far(log: DataFrame, metric: str = "loss", order: str = "iteration", seconds: str = "train_time") -> DataFrame:
    """Best metric and total time up to each trial."""
    return accumulate(log, [F.col(order)], {"best_so_far": ("min", metric), "total_time": ("sum", seconds)})
