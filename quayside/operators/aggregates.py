"""Aggregations, all with map-side partial aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from quayside.functions.timekeys import month_key, week_ending_monday
from quayside.operators.joins import measured


def totals_over(df: DataFrame, key: str, measure: str, least: float, total: str = "total") -> DataFrame:
    """Entities whose summed measure is above ``least``; rows with a null key do not count."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum(measure).alias(total)).filter(F.col(total) > least))


def weekly_sum(df: DataFrame, keys: list[str], date: str, measures: dict[str, str], shift_back: int = 0,
               cumulative_by: list[str] | None = None) -> DataFrame:
    """Sums per key and week ending Monday, as ``{source column: output name}``.

    With ``cumulative_by`` the measures are running totals per those finer keys (say county):
    the week's value is then the sum over them of the highest total in the week.
    """
    week = week_ending_monday(date, shift_back).alias("week")
    if cumulative_by:
        df = df.groupBy(*keys, *cumulative_by, week).agg(*(F.max(c).alias(c) for c in measures))
        week = F.col("week")
    return df.groupBy(*keys, week).agg(*(F.sum(c).alias(name) for c, name in measures.items()))


def monthly_sum(df: DataFrame, keys: list[str], date: str, measure: str, total: str) -> DataFrame:
    return df.groupBy(*keys, month_key(date).alias("month")).agg(F.sum(measure).alias(total))


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation as ``<col>_mean`` and ``<col>_sd``."""
    return df.groupBy(*(by or [])).agg(*(e for c in cols for e in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"))))


def count_distinct(df: DataFrame, cols: list[str], approximate: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct non-null values per column in one row. The approximate form needs one pass
    and a fixed-size sketch, the exact one a shuffle of the distinct values."""
    if approximate:
        return df.agg(*(F.approx_count_distinct(c, rsd).alias(c) for c in cols))
    return df.agg(*(F.count_distinct(c).alias(c) for c in cols))


def profile(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing values, distinct values; most missing first."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    distinct = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))
    aggregated = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)),
                        *(distinct(c).alias(f"d_{i}") for i, c in enumerate(cols)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                              F.col(f"m_{i}").alias("count_missing"), F.col(f"d_{i}").alias("number_unique"))
                     for i, c in enumerate(cols)))
    return aggregated.select(F.inline(rows)).orderBy(F.desc("count_missing"), "column_name")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_counts(df: DataFrame, col: str, pct: bool = True) -> DataFrame:
    """Count per value, and its share of all rows in percent."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if not pct:
        return counts
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("pct", 100 * F.col("n") / total)


def pivot_min(df: DataFrame, index: str, columns: str, values: list, value: str) -> DataFrame:
    """Smallest ``value`` per index, one column for each of ``values``. The list is given,
    so no extra pass looks for it and the width is known."""
    return df.groupBy(index).pivot(columns, values).agg(F.min(value))


def first_nonzero(df: DataFrame, key: str, time: str, value: str, out: str = "first_time") -> DataFrame:
    """First time each entity has a nonzero value; its first time at all when it has none."""
    nonzero = F.min(F.when(F.coalesce(F.col(value), F.lit(0)) != 0, F.col(time)))
    return df.groupBy(key).agg(F.coalesce(nonzero, F.min(time)).alias(out))


def extremes(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Largest, mean and smallest actual and predicted value."""
    return df.groupBy(*(by or [])).agg(*(
        f(c).alias(f"{name}_{side}")
        for name, f in (("max", F.max), ("mean", F.avg), ("min", F.min))
        for side, c in (("actual", actual), ("predicted", predicted))))


def best_by(df: DataFrame, metric: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The row with the smallest metric, per group when ``by`` is given; ``tie`` decides
    among equals. An aggregate, so no group is ever sorted."""
    by = by or []
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(metric, tie)).alias("best")
    return df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(best).select(*by, "best.*")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the extremes; the last one is closed."""
    b = measured(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))).select(F.struct("lo", "hi")).scalar()
    lo, hi = b["lo"], b["hi"]
    # a column of one value has no width: everything is in bin 1
    bucket = F.when(lo == hi, 1).otherwise(
        F.least(F.floor((F.col(col) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins) + 1, F.lit(bins)))
    return (df.filter(F.col(col).isNotNull()).groupBy(bucket.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")))


def trend(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def composition(df: DataFrame, dims: list[str], measure: str, subtotals: str | None = None) -> DataFrame:
    """Rows and volume per dimension combination, with subtotals by ``rollup`` or ``cube``."""
    grouped = {None: df.groupBy, "rollup": df.rollup, "cube": df.cube}[subtotals](*dims)
    level = [F.grouping_id().alias("level")] if subtotals else []
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("volume"), *level)


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one row per pair, in one pass."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(rows))

