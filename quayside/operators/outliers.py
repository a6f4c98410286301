"""z-score filters. Moments are computed first, one aggregate per pass, and enter as scalar
subqueries over a one-row table: no join, no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayside.fixed_values import OUTLIER_Z
from quayside.operators.aggregates import moments
from quayside.operators.columns import cap
from quayside.operators.joins import enrich, measured


def drop_outliers(df: DataFrame, col: str, k: float = OUTLIER_Z, by: list[str] | None = None) -> DataFrame:
    """Rows closer than ``k`` sample standard deviations to the mean, of all rows or of
    their group. A row at the mean is no outlier: groups of one value, where the deviation is
    0, and of one row, where there is none, keep their rows. Null values go."""
    stats = measured(moments(df, [col], by))
    if by:
        joined = enrich(df, stats, {c: c for c in by}, "inner", null_safe=True)
        return joined.filter(_near(F.col(col), F.col(f"{col}_mean"), F.col(f"{col}_sd"), k)).drop(f"{col}_mean", f"{col}_sd")
    s = stats.select(F.struct(f"{col}_mean", f"{col}_sd")).scalar()
    return df.filter(_near(F.col(col), s[f"{col}_mean"], s[f"{col}_sd"], k))


def _near(value: Column, mean: Column, sd: Column, k: float) -> Column:
    return (F.abs(value - mean) < k * sd) | (value.isNotNull() & (F.coalesce(sd, F.lit(0.0)) == 0))


def outlier_chain(df: DataFrame, steps: list[tuple[str, str, float]]) -> DataFrame:
    """Filters in order, each seeing only what the earlier ones left: ``("z", col, k)``
    takes fresh moments, ``("cap", col, limit)`` keeps values below the limit."""
    for kind, col, limit in steps:
        df = drop_outliers(df, col, limit) if kind == "z" else cap(df, col, limit)
    return df
