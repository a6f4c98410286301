"""Ordered operators.

A window partition is sorted in one task, so every window here is either over a group
bounded by the calendar (one row per entity and period) or over blocks of a longer
sequence whose summaries are carried over (:func:`running`, :func:`row_numbers`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quayside.operators.joins import enrich, measured
from quayside.session import settle


def supervised(df: DataFrame, keys: list[str], order: str, cols: list[str], n_in: int = 1, n_out: int = 1,
               drop_incomplete: bool = True) -> DataFrame:
    """Lagged frame: ``<col>_t_minus_i`` for the past, ``<col>_t`` and ``<col>_t_plus_i`` ahead.

    One row per entity and period is expected, which bounds each group by the calendar.
    """
    w = W.partitionBy(*keys).orderBy(order)
    past = [F.lag(c, i).over(w).alias(f"{c}_t_minus_{i}") for i in range(n_in, 0, -1) for c in cols]
    ahead = [(F.lead(c, i).over(w) if i else F.col(c)).alias(f"{c}_t" + (f"_plus_{i}" if i else ""))
             for i in range(n_out) for c in cols]
    framed = df.select(*keys, order, *past, *ahead)
    if not drop_incomplete:
        return framed
    return framed.na.drop("any", subset=[c for c in framed.columns if c not in (*keys, order)])


def diff(df: DataFrame, keys: list[str], order: str, col: str, out: str) -> DataFrame:
    """First difference within each series; the first row of a series has none."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(col) - F.lag(col).over(w)).filter(F.col(out).isNotNull())


def undiff(df: DataFrame, keys: list[str], order: str, col: str, start: Column | str, out: str,
           exponentiate: bool = True) -> DataFrame:
    """Levels from differences: ``start`` plus the running sum, through ``exp`` for log series."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    level = (F.col(start) if isinstance(start, str) else start) + F.sum(col).over(w)
    return df.withColumn(out, F.exp(level) if exponentiate else level)


def pct_from_baseline(value: Column | str, baseline: Column | str) -> Column:
    """Percent change from a baseline, null where the baseline is zero."""
    value = F.col(value) if isinstance(value, str) else value
    baseline = F.col(baseline) if isinstance(baseline, str) else baseline
    return F.try_divide(value - baseline, baseline) * 100


def carry_forward(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Nulls take the last known value of their entity; groups are bounded by the calendar."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


_RUNNING = {
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
}


def running(df: DataFrame, order: str, block: Column, measures: dict[str, tuple[str, str]],
            keys: list[str] | None = None) -> DataFrame:
    """Running ``min``, ``max`` or ``sum`` along a sequence of any length.

    ``block`` cuts the sequence into pieces and must not decrease along ``order``. Each
    block is summarised, the summaries are accumulated (one row per block), and rows only
    look back within their own block. ``measures`` is ``{output: (kind, column)}``.
    """
    return _carried(df.withColumn("_block", block), order, measures, keys or [])


def accumulate(df: DataFrame, order: list[Column], measures: dict[str, tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Running ``min``, ``max`` or ``sum`` in a total order, per ``keys`` if given.

    The rows are range-sorted and settled; each sorted partition is a block of
    :func:`running`, so blocks hold equally many rows whatever the values, a group with a
    third of all rows included, and the summaries are one row per partition and group.
    """
    keys = keys or []
    placed = settle(df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    return _carried(placed.withColumn("_block", F.shiftright("_at", 33)), "_at", measures, keys).drop("_at")


def _carried(df: DataFrame, order: str, measures: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Rows with a ``_block``: running values within it, on top of what the blocks before add up to."""
    summaries = df.groupBy(*keys, "_block").agg(
        *(_RUNNING[kind][0](col).alias(f"_s_{out}") for out, (kind, col) in measures.items()))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = summaries.select(*keys, "_block", *(
        _RUNNING[kind][0](f"_s_{out}").over(earlier).alias(f"_b_{out}")
        for out, (kind, _) in measures.items()))
    within = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    here = df.withColumns({f"_h_{out}": _RUNNING[kind][0](col).over(within)
                           for out, (kind, col) in measures.items()})
    joined = enrich(here, carried, {c: c for c in [*keys, "_block"]}, "inner", null_safe=True)
    return joined.select(*(c for c in df.columns if c != "_block"), *(
        _RUNNING[kind][1](F.col(f"_b_{out}"), F.col(f"_h_{out}")).alias(out)
        for out, (kind, _) in measures.items()))


def row_numbers(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position of every row in a total order over the whole table.

    A range-partitioned sort splits the rows evenly whatever their values, as ``order``
    ends in a tie-breaker; the sorted table is settled so that positions cannot change,
    and each piece is shifted by the number of rows before it.
    """
    placed = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright("_at", 33)
    counts = placed.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = measured(counts.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    joined = placed.withColumn("_piece", piece).join(offsets, "_piece")
    position = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return joined.withColumn(out, position).drop("_piece", "_at", "_offset")
