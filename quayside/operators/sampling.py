"""Reproducible samples and splits.

Rows are ordered by the MD5 of their key and a seed, so the same rows are drawn on any
cluster size and with any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quayside.fixed_values import SEED
from quayside.operators.joins import enrich, measured

# Hex digits of the hash that form a bucket: 16**4 buckets, and as many within the bucket cut.
BUCKET_DIGITS = 4


def row_hash(key: list[str], seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key), F.lit(str(seed))))


def take_by_hash(df: DataFrame, by: list[str], quota: Column, key: list[str], seed: int = SEED,
                 flag: str = "chosen") -> DataFrame:
    """Marks, in every stratum, the ``quota`` rows with the smallest hash of ``key``, which
    tells rows apart.

    ``quota`` is an expression over ``_n``, the rows of the stratum. Rows are counted per
    hash bucket; the running count shows in which bucket the quota ends, that bucket is
    counted again by further digits, and only the hashes of the finer bucket are ranked to
    find the last one taken: of 16**8 buckets in all one is sorted per stratum. The rows
    themselves are only compared with one hash per stratum, not shuffled.
    """
    hashes = df.select(*by, row_hash(key, seed).alias("_h"))
    edge, wanted = hashes, None
    for digits in (BUCKET_DIGITS, 2 * BUCKET_DIGITS):
        edge = edge.withColumn("_bucket", F.left("_h", F.lit(digits)))
        wanted = _cut(edge, by, quota if wanted is None else F.col("_left"))
        edge = enrich(edge.select(*by, "_h", "_bucket"), wanted, {**{c: c for c in by}, "_bucket": "_bucket"}, "inner", null_safe=bool(by))
    ranked = edge.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_h")))
    last = measured(ranked.filter(F.col("_rank") == F.col("_left")).select(*by, F.col("_h").alias("_last")))
    strata = {c: c for c in by}
    if by:
        marked = enrich(df, last, strata, "left", null_safe=True)
    else:
        marked = df.withColumn("_last", last.scalar())
    return marked.withColumn(flag, F.coalesce(row_hash(key, seed) <= F.col("_last"), F.lit(False))).drop("_last")


def _cut(hashes: DataFrame, by: list[str], quota: Column) -> DataFrame:
    """The bucket of each stratum in which its quota ends, and how many rows of it are still taken."""
    seen = [F.first("_left").alias("_left")] if "_left" in hashes.columns else []
    counts = hashes.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"), *seen)
    # windows over the buckets of a stratum, not over its rows
    stratum = W.partitionBy(*by)
    upto = F.sum("_c").over(stratum.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    summed = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(stratum)}).withColumn("_quota", quota.cast("long"))
    before = F.col("_upto") - F.col("_c")
    return measured(summed.filter((before < F.col("_quota")) & (F.col("_upto") >= F.col("_quota")))
                    .select(*by, "_bucket", (F.col("_quota") - before).alias("_left")))


def stratified_split(df: DataFrame, by: list[str], test: float, key: list[str], seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: exactly ``ceil(test * n)`` rows of every stratum."""
    return take_by_hash(df, by, F.ceil(F.lit(test) * F.col("_n")), key, seed, "is_test")


def approximate_split(df: DataFrame, test: float, key: list[str], seed: int = SEED) -> DataFrame:
    """Adds ``is_test`` for about this share of the rows of any stratum, by the hash of the
    key alone: one pass, no counts and no shuffle."""
    share = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("is_test", share < test)


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows, or all when there are fewer."""
    return take_by_hash(df, [], F.least(F.lit(n), F.col("_n")), key, seed).filter("chosen").drop("chosen")


def sample_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = SEED) -> DataFrame:
    """About this share of the rows, by the hash of their key: the same rows on any
    partitioning, in one pass without a shuffle."""
    below = f"{min(int(fraction * 16 ** 8), 16 ** 8 - 1):08x}"
    return df if fraction >= 1 else df.filter(row_hash(key, seed) < below)


def time_split(df: DataFrame, period: str, train_rows: int | None = None, first_test=None) -> DataFrame:
    """Adds ``is_test``: whole periods from ``first_test`` on, or those after the last
    period that still fits into ``train_rows``. Periods are never cut in two."""
    if first_test is None:
        counts = df.groupBy(period).agg(F.count(F.lit(1)).alias("_c"))
        # one row per period
        upto = F.sum("_c").over(W.orderBy(period).rowsBetween(W.unboundedPreceding, 0))
        cut = counts.withColumn("_upto", upto).filter(F.col("_upto") <= train_rows) \
            .agg(F.max(period).alias("last_train")).scalar()
        return df.withColumn("is_test", F.coalesce(F.col(period) > cut, F.lit(True)))
    return df.withColumn("is_test", F.col(period) >= F.lit(first_test))
