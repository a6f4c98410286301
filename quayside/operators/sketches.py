"""Profiles kept as small sketches per period, which add up without another look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Digits of the distinct sketch (relative error about 1.04 / sqrt(2 ** LOG_K)) and size of the
# quantile sketch (rank error about 1.3 % at 200, less for more).
LOG_K, KLL_K = 12, 800


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def period_sketches(df: DataFrame, cols: list[str], period: list[str], log_k: int = LOG_K, kll_k: int = KLL_K) -> DataFrame:
    """A row per period and column: ``(period..., column, n, missing, distinct_sketch, low, high, total, quantile_sketch)``.

    One pass, with sketches combined before the shuffle: what travels is a few kilobytes per
    period, column and task, whatever the rows. Numbers have bounds, a sum and a quantile
    sketch; other columns have none. Distinct values are told apart as text. A column of
    nulls only has sketches of nothing. Meant to be written by period, so that a new period
    is one more partition.
    """
    kinds = {c: df.schema[c].dataType for c in cols}
    numbers = [c for c in cols if _is_number(kinds[c])]
    measures = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        measures += [F.count_if(F.col(c).isNull()).alias(f"m{i}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(log_k)).alias(f"h{i}")]
        if c in numbers:
            value = F.col(c).cast("double")
            measures += [F.min(value).alias(f"a{i}"), F.max(value).alias(f"b{i}"), F.sum(value).alias(f"s{i}"),
                         F.kll_sketch_agg_double(value, F.lit(kll_k)).alias(f"q{i}")]
    none = lambda kind: F.lit(None).cast(kind)
    rows = [F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"m{i}").alias("missing"), F.col(f"h{i}").alias("distinct_sketch"),
                     *((F.col(f"{k}{i}") if c in numbers else none(kind)).alias(name) for k, name, kind in (
                         ("a", "low", "double"), ("b", "high", "double"), ("s", "total", "double"), ("q", "quantile_sketch", "binary"))))
            for i, c in enumerate(cols)]
    return df.groupBy(*period).agg(*measures).select(*period, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sketches of several periods as one per column, and per ``by`` if given: years from months, or all from years.
    Merging in any order or in steps gives what one pass over the rows would, within the same error."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def read_sketches(sketches: DataFrame, quantiles: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches as a profile: ``n, missing, distinct, low, high, mean`` and a column ``q_<percent>`` per quantile."""
    known = F.coalesce(F.kll_sketch_get_n_double("quantile_sketch"), F.lit(0)) > 0  # a sketch of nothing has no quantiles
    keep = [c for c in sketches.columns if c not in ("distinct_sketch", "quantile_sketch", "total")]

    def quantile(p: float) -> Column:
        return F.when(known, F.kll_sketch_get_quantile_double(F.when(known, F.col("quantile_sketch")), F.lit(float(p))))
    return sketches.select(*keep, F.hll_sketch_estimate("distinct_sketch").alias("distinct"),
                           F.try_divide("total", F.col("n") - F.col("missing")).alias("mean"),
                           *(quantile(p).alias(f"q_{round(100 * p)}") for p in quantiles))
