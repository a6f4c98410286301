"""Joins of times with intervals, by equality of blocks instead of comparing all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quayside.operators.joins import Keys, enrich, measured

# Totals that can be taken in parts: name to (kind, column).
Totals = dict[str, tuple[str, str]]
_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _as_long(df: DataFrame, col: str) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.IntegralType):
        return F.col(col).cast("long")
    raise ValueError(f"{col} is {kind.simpleString()}, not a date, a timestamp or a whole number")


def _level(length: Column) -> Column:
    """The power of two of the blocks for an interval of a length: blocks at least as long, under twice as long."""
    # 64 less the leading zeros of length: the number of binary digits
    return F.length(F.bin(length)).cast("int")


def point_in_interval(df: DataFrame, intervals: DataFrame, on: str, start: str, end: str, by: Keys | None = None, how: str = "inner",
                      closed: bool = True) -> DataFrame:
    """Rows of ``df`` with every interval that holds their time ``on``: ``start <= on <= end``.

    ``by`` maps key columns of ``df`` to those of ``intervals``; both sides keep all their
    columns but the interval's keys, and no other column may be on both. ``closed=False``
    leaves the end out. An interval lies in blocks about as long as itself, at most two, and
    a row in one block of each such length that occurs, so both meet by equality however
    long or short the intervals are; then the ends are compared. At least a quarter of a
    block is covered by each of its intervals, so few pairs are compared in vain. Hot keys
    spread over blocks, and what is left of skew is split by adaptive execution. Intervals
    with a null or reversed end hold nothing; rows with a null time or key match nothing.
    ``how="left"`` keeps rows outside all intervals, with nulls.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    by = by or {}
    clash = (set(intervals.columns) - set(by.values())) & set(df.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    names = {key: f"_by_{i}" for i, key in enumerate(by.values())}
    low, high = _as_long(intervals, start), _as_long(intervals, end) - (0 if closed else 1)
    held = intervals.withColumns({"_low": low, "_high": high}).filter("_low <= _high").withColumnsRenamed(names)
    held = held.withColumn("_level", _level(F.col("_high") - F.col("_low")))
    held = held.withColumn("_block", F.explode(F.expr("sequence(shiftright(_low, _level), shiftright(_high, _level))")))
    held = measured(held)
    # one row per length of blocks, at most 64
    levels = sorted(r[0] for r in held.select("_level").distinct().collect())
    timed = df.withColumn("_time", _as_long(df, on))
    lookup = F.array(*(F.struct(F.lit(n).alias("_at_level"), F.shiftright("_time", n).alias("_at_block")) for n in levels)) \
        if levels else F.array().cast("array<struct<_at_level:int,_at_block:bigint>>")
    same = [F.col("_at_level") == F.col("_level"), F.col("_at_block") == F.col("_block"),
            F.col("_time") >= F.col("_low"), F.col("_time") <= F.col("_high"), *(F.col(a) == F.col(names[b]) for a, b in by.items())]
    looked = timed.withColumn("_p", F.explode(lookup)).select(*timed.columns, "_p.*")
    inside = looked.join(held, reduce(lambda a, b: a & b, same), "inner")
    extra = ["_time", "_at_level", "_at_block", "_low", "_high", "_level", "_block", *names.values()]
    out = inside.drop(*extra)
    if how == "inner":
        return out
    # a time inside no interval has no match at any level: the distinct times decide
    points = timed.select("_time", *by).distinct()
    met = points.withColumn("_p", F.explode(lookup)).select("_time", *by, "_p.*").join(held, reduce(lambda a, b: a & b, same), "left_semi") \
        .select("_time", *by).distinct()
    met = measured(met.withColumnsRenamed({"_time": "_met", **{c: f"_met_{i}" for i, c in enumerate(by)}}))
    known = reduce(lambda a, b: a & b, [F.col("_time") == F.col("_met"), *(F.col(c) == F.col(f"_met_{i}") for i, c in enumerate(by))])
    outside = timed.join(met, known, "left_anti").drop("_time")
    return out.unionByName(outside, allowMissingColumns=True)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Keys | None = None,
                 totals: Totals | None = None) -> DataFrame:
    """All pairs of rows whose closed intervals share a time, each pair once.

    Two intervals overlap when the left one starts inside the right one, or the right one
    starts inside the left one, later than it; both are joins of a time with intervals.
    With ``totals`` (name to kind, ``sum``, ``min`` or ``max``, and column of ``left``) the result has, instead of pairs, the
    rows of ``right`` that overlap any row of ``left``, each with the totals over those rows.
    Equal starts are then summed up before they meet the different intervals of ``right``, and what is open at a
    start comes from sums per block, so that no pair of rows is made however long the intervals of ``left`` are.
    """
    by = by or {}
    (l0, l1), (r0, r1) = left_span, right_span
    columns = [*left.columns, *(c for c in right.columns if c not in by.values())]
    left, right = left.filter(F.col(l0) <= F.col(l1)), right.filter(F.col(r0) <= F.col(r1))
    if totals is not None:
        return _overlap_totals(left, right, left_span, right_span, by, totals)
    first = point_in_interval(left, right, l0, r0, r1, by)
    names = {b: f"_key_{i}" for i, b in enumerate(by.values())}
    later = point_in_interval(right.withColumnsRenamed(names), left, r0, l0, l1, {names[b]: a for a, b in by.items()}) \
        .withColumnsRenamed({names[b]: a for a, b in by.items()}).filter(F.col(r0) > F.col(l0))
    return first.select(*columns).unionAll(later.select(*columns))


def _overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Keys, totals: Totals) -> DataFrame:
    (l0, l1), (r0, r1) = left_span, right_span
    clash = set(totals) & {*by, *left_span, *right.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    again = [_KINDS[kind](name).alias(name) for name, (kind, _) in totals.items()]  # totals of totals
    keys = {b: a for a, b in by.items()}
    # one row per different interval of either side
    spans = measured(left.groupBy(*by, l0, l1).agg(*(_KINDS[kind](c).alias(name) for name, (kind, c) in totals.items())))
    windows = measured(right.select(*by.values(), r0, r1).distinct())
    inside = point_in_interval(spans.groupBy(*by, l0).agg(*again), windows, l0, r0, r1, by).groupBy(*by, r0, r1).agg(*again)
    # windows of one start have the same totals over what had begun before and was still open
    points = windows.select(*by.values(), r0).distinct().withColumnsRenamed(keys).withColumn("_time", _as_long(windows, r0))
    begun = spans.withColumns({"_low": _as_long(spans, l0) + 1, "_high": _as_long(spans, l1)})
    later = _totals_at(points, begun, by, again).groupBy(*by, r0).agg(*again)
    opened = enrich(windows.withColumnsRenamed(keys), later, {**{a: a for a in by}, r0: r0}, "inner")
    columns = [*by, r0, r1, *totals]
    both = inside.select(*columns).unionAll(opened.select(*columns)).groupBy(*by, r0, r1).agg(*again)
    return enrich(right.withColumnsRenamed(keys), both, {**{a: a for a in by}, r0: r0, r1: r1}, "inner")


def _totals_at(points: DataFrame, held: DataFrame, by: Keys, again: list[Column]) -> DataFrame:
    """``points`` with totals over the intervals from ``_low`` to ``_high`` that hold their ``_time``, in a few rows each.

    An interval is cut into the largest aligned blocks of powers of two that make it up, at most two of a length.
    Totals are kept per block, and a point looks up the one block of each length that it lies in.
    """
    cut = held.filter("_low <= _high").withColumn("_level", F.explode(F.sequence(F.lit(0), _level(F.col("_high") - F.col("_low") + 1) - 1)))
    # the first and the end of the blocks of a length that lie within; those that no larger one holds stand at the ends
    cut = cut.withColumns({"_from": F.expr("shiftright(_low + shiftleft(1L, _level) - 1, _level)"), "_to": F.expr("shiftright(_high + 1, _level)")})
    ends = F.expr("array(if(_from & 1 = 1, _from, null), if(_to & 1 = 1, _to - 1, null))")
    blocks = measured(cut.filter("_from < _to").withColumn("_block", F.explode(ends)).filter("_block is not null").groupBy(*by, "_level", "_block").agg(*again))
    # one row per length of blocks, at most 64
    levels = F.array(*(F.lit(r[0]) for r in blocks.select("_level").distinct().collect())).cast("array<int>")
    looked = points.withColumn("_level", F.explode(levels)).withColumn("_block", F.expr("shiftright(_time, _level)"))
    return enrich(looked, blocks, {c: c for c in (*by, "_level", "_block")}, "inner")
