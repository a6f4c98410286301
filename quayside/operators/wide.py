"""Least squares on sparse vectors of any number of features.

The normal equations are a table with an entry for every two features that share a row, and conjugate gradients solve
them with vectors that are tables too; the driver has a few sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import unwrap_udt

from quayside.session import remove, settle_at


@dataclass
class LeastSquares:
    """``coefficients`` is a table ``at, coefficient``; a feature that no row has is not in it and counts 0."""

    coefficients: DataFrame
    intercept: float


def fit_least_squares(train: DataFrame, target: str, features: str = "features", most: int = 1000, tolerance: float = 1e-12) -> LeastSquares:
    """The solution the gradients approach from 0: where several fit equally well, the smallest on the scale of the features."""
    spark = train.sparkSession
    y = F.col(target).cast("double")
    known = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("double")).otherwise(y)
    v = unwrap_udt(features)
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    rows = train.select(known.alias("y"), F.arrays_zip(places.alias("at"), v["values"].alias("x")).alias("e"))
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("y")).first()

    # every two features of a row, a feature with itself among them; with those come its sums
    left = rows.select("y", "e", F.inline("e").alias("i", "xi"))
    pairs = left.select("y", "i", "xi", F.inline("e").alias("j", "xj"))
    same = F.col("i") == F.col("j")
    gram, gram_path = settle_at(pairs.groupBy("i", "j").agg(
        F.sum(F.col("xi") * F.col("xj")).alias("g"), F.sum(F.when(same, F.col("xi"))).alias("sx"),
        F.sum(F.when(same, F.col("xi") * (F.col("y") - F.lit(mean)))).alias("b")), "gram")
    others = gram.filter("i <> j").select("i", "j", "g")
    others = None if others.isEmpty() else others
    own = gram.filter("i = j and g > 0").select(F.col("i").alias("at"), F.col("g").alias("d"), "sx", F.lit(0.0).alias("c"), F.col("b").alias("r"),
                                               (F.col("b") / F.col("g")).alias("p"))

    def sums(state: DataFrame) -> tuple[float, float]:
        found = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("sx") * F.col("r") / F.col("d")) / n).first()
        return found[0] or 0.0, found[1] or 0.0

    # columns are centred in passing: the means' share is taken off each product
    state, path = settle_at(own, "squares")
    start, along = sums(state)
    size = start
    for _ in range(most):
        if not size > tolerance ** 2 * start:
            break
        q = F.col("d") * F.col("p") - F.col("sx") * F.lit(along)
        base = state
        if others is not None:
            met = others.join(state.select(F.col("at").alias("j"), "p"), "j").groupBy(F.col("i").alias("at")).agg(F.sum(F.col("g") * F.col("p")).alias("o"))
            base, q = state.join(met, "at", "left"), q + F.coalesce("o", F.lit(0.0))
        step, after = settle_at(base.select("at", "d", "sx", "c", "r", "p", q.alias("q")), "squares")
        remove(spark, path)
        path = after
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not curve or not curve > 0:
            state = step
            break
        length = F.lit(size / curve)
        state = step.select("at", "d", "sx", (F.col("c") + length * F.col("p")).alias("c"), (F.col("r") - length * F.col("q")).alias("r"), "p")
        after, direction = sums(state)
        along, turn = direction + after / size * along, F.lit(after / size)
        state, size = state.withColumn("p", F.col("r") / F.col("d") + turn * F.col("p")), after
    remove(spark, gram_path)
    lift = state.agg(F.sum(F.col("sx") * F.col("c")) / n).first()[0] or 0.0
    return LeastSquares(state.select(F.col("at").cast("long"), F.col("c").alias("coefficient")), (mean or 0.0) - lift)
