"""Exact quantiles without gathering a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quayside.operators.joins import enrich, measured
from quayside.operators.windows import accumulate

# Ranks of the sketch are right to within one part in this many.
SKETCH_ACCURACY = 10_000


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None,
              accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by..., prob, value``.

    A mergeable sketch first gives bounds that surely hold each wanted rank. One further
    pass counts the rows below the bounds and the rows at each distinct value between
    them, and takes the next value on either side; only those counts, a few parts in ``accuracy`` of
    the distinct values, are range-sorted and added up along many tasks. Equal values are
    summed before the shuffle, so a hot value costs nothing.
    """
    by = by or []
    df = df.select(*by, col).filter(F.col(col).isNotNull())
    pad = 3.0 / accuracy
    low = [max(0.0, p - pad) for p in probs]
    high = [min(1.0, p + pad) for p in probs]
    bounds = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(col, low + high, accuracy).alias("_p"))
    brackets = bounds.select(*by, F.array(*(
        F.struct(F.lit(p).alias("prob"), (F.lit(p) * (F.col("_n") - 1)).alias("_rank"),
                 F.col("_p")[i].alias("_lo"), F.col("_p")[len(probs) + i].alias("_hi"))
        for i, p in enumerate(probs))).alias("_b"))
    same = {c: c for c in by}
    rows = enrich(df, measured(brackets), same, "inner", null_safe=True) if by else df.withColumn("_b", brackets.scalar())
    rows = rows.select(*by, F.col(col).alias("_x"), F.explode("_b").alias("_e")).select(*by, "_x", "_e.*")
    side = F.when(F.col("_x") < F.col("_lo"), -1).when(F.col("_x") <= F.col("_hi"), 0).otherwise(1)
    keys = [*by, "prob", "_rank"]
    counted = rows.groupBy(*keys, side.alias("_side"), F.when(side == 0, F.col("_x")).alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")) \
        .withColumn("_value", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))).drop("_least", "_most")
    placed = accumulate(counted, [F.col("_side"), F.col("_v")], {"_upto": ("sum", "_c")}, keys)
    # value at 0-based rank k is the first whose running count exceeds k
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_value")))
    fraction = F.col("_rank") - F.floor("_rank")
    return (placed.groupBy(*keys)
            .agg(at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_z"))
            .select(*by, "prob", (F.col("_a") + (F.col("_z") - F.col("_a")) * fraction).alias("value")))


def five_number(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Smallest, quartiles, mean and largest value, in one row per group."""
    by = by or []
    q = quantiles(df, col, [0.25, 0.5, 0.75], by)
    quartile = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    wide = q.groupBy(*by).agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    ends = df.groupBy(*by).agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))
    if by:
        return enrich(ends, wide, {c: c for c in by}, "inner", null_safe=True)
    w = measured(wide).select(F.struct("q1", "median", "q3")).scalar()
    return ends.select("min", w["q1"].alias("q1"), w["median"].alias("median"), "mean", w["q3"].alias("q3"), "max")
