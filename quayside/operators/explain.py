"""What a fitted model relies on."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quayside.fixed_values import SEED
from quayside.operators.evaluation import regression_metrics


def impurity_importance(spark: SparkSession, model: Model, names: list[str]) -> DataFrame:
    """Importance per feature, largest first; a row per model column."""
    rows = [(n, float(w)) for n, w in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "variable string, feature_importance double") \
        .orderBy(F.desc("feature_importance"), "variable")


# Hash buckets per repeat that a permutation is made of.
BUCKETS = 4096


def shuffled_features(rows: DataFrame, key: list[str], repeats: int, seed: int, features: str,
                      buckets: int = BUCKETS) -> DataFrame:
    """Every row ``repeats`` times, with the features of another row chosen at random as
    ``_other``.

    Rows fall into hash buckets, different ones per repeat; each row takes the features of
    the next one in hash order, the last of a bucket those of the first row of the next
    bucket that has rows, and the last of all those of the first. That is one cycle through
    all rows, so it permutes every feature, whatever the number of rows.

    The shuffled copies carry the features once, as numbers, and of the columns only what the caller
    reads: rows of one hash are told apart by their features, so that ``key`` need not travel.
    """
    base = rows.select("*", vector_to_array(features).alias("_f")) \
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    h = F.xxhash64(*key, "repeat", F.lit(seed))
    base = base.withColumns({"_h": h, "_bucket": F.pmod(F.xxhash64(h, F.lit("bucket")), F.lit(buckets))})
    firsts = base.groupBy("repeat", "_bucket").agg(F.min(F.struct("_h", "_f")).alias("_first"))
    # at most one row per bucket and repeat
    ring = W.partitionBy("repeat").orderBy("_bucket")
    following = F.coalesce(F.lead("_first").over(ring), F.first("_first").over(ring.rowsBetween(W.unboundedPreceding, 0)))
    firsts = firsts.select("repeat", "_bucket", following["_f"].alias("_after"))
    order = W.partitionBy("repeat", "_bucket").orderBy("_h", "_f")
    ordered = base.withColumn("_lead", F.lead("_f").over(order)).join(firsts, ["repeat", "_bucket"])
    return ordered.withColumn("_other", F.coalesce("_lead", "_after")).drop("_h", "_bucket", "_lead", "_after")


def permutation_importance(model: Model, test: DataFrame, target: str, key: list[str], names: list[str],
                           repeats: int = 5, metric: str = "r2", seed: int = SEED, features: str = "features",
                           buckets: int = BUCKETS) -> DataFrame:
    """How much worse the model gets when one feature is shuffled: ``feature, weight, std``
    over the repeats. All features and repeats are scored in one job; the copies with one
    feature exchanged are made row by row after the shuffle."""
    rows = test.select(*key, F.col(target).cast("double").alias("_y"), features)
    shuffled = shuffled_features(rows, key, repeats, seed, features, buckets)
    copies = shuffled.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    parts = [f"_x{i}" for i in range(len(names))]
    exchanged = [F.when(F.col("_j") == i, F.col("_other")[i]).otherwise(F.col("_f")[i]).alias(x)
                 for i, x in enumerate(parts)]
    permuted = model.transform(VectorAssembler(inputCols=parts, outputCol=features).transform(
        copies.select("repeat", "_j", "_y", *exchanged)).select("repeat", "_j", "_y", features))
    errors = regression_metrics(permuted, "_y", "prediction", ["_j", "repeat"])
    base = regression_metrics(model.transform(rows), "_y", "prediction").select(metric).scalar()
    worse = (base - F.col(metric)) if metric == "r2" else (F.col(metric) - base)
    name = F.array(*(F.lit(n) for n in names))[F.col("_j")]
    return (errors.withColumn("_w", worse).groupBy("_j")
            .agg(F.avg("_w").alias("weight"), F.stddev_pop("_w").alias("std"))
            .select(name.alias("feature"), "weight", "std").orderBy(F.desc("weight")))
