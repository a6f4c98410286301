"""Joins on the nearest row of an ordered side: the last one at or before, the first one at
or after, or the closer of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quayside.operators.joins import Keys, enrich, measured
from quayside.operators.windows import accumulate


def _as_number(df: DataFrame, col: str) -> Column:
    """An order column as a number, so that distances and both directions are plain arithmetic."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType)):
        return F.col(col)
    raise ValueError(f"{col} is {kind.simpleString()}, not a date, a timestamp or a number")


def _found(points: DataFrame, rows: DataFrame, by: list[str], sign: int, exact: bool) -> DataFrame:
    """``points`` ``(by, _t)`` with ``_hit``: the last of ``rows`` ``(by, _t, _row)`` at or before each.

    Points and rows become one stream, sorted by key and time over all tasks; each sorted
    piece carries the last row it has seen to the next, so a key with a third of all rows is
    spread over many pieces and no task holds a key whole. ``sign`` -1 reads time backwards.
    """
    nothing = F.lit(None).cast(rows.schema["_row"].dataType)
    # rows stand before points of the same time if they are to be found there
    stream = rows.select(*by, "_t", F.lit(0 if exact else 1).alias("_side"), "_row", F.lit(False).alias("_point")).unionAll(
        points.select(*by, "_t", F.lit(1 if exact else 0).alias("_side"), nothing.alias("_row"), F.lit(True).alias("_point")))
    stream = stream.withColumns({"_at": F.col("_t") * sign, "_hit": F.when(~F.col("_point"), F.struct((F.col("_t") * sign).alias("at"), "_row"))})
    order = [F.col("_order"), F.col("_side")]
    running = accumulate(stream.withColumnRenamed("_at", "_order"), order, {"_last": ("max", "_hit")}, by)
    return running.filter("_point").select(*by, "_t", F.col("_last._row").alias("_hit"), (F.col("_last.at") * sign).alias("_hit_t"))


def asof_join(df: DataFrame, side: DataFrame, by: Keys, on: str, side_on: str, direction: str = "backward", exact: bool = True,
              tolerance: float | None = None, how: str = "left") -> DataFrame:
    """Rows of ``df`` with the attributes of the row of ``side`` nearest in time, per key.

    ``by`` maps key columns of ``df`` to those of ``side``; ``on`` and ``side_on`` are the
    times (dates, timestamps or numbers). ``direction`` is ``backward`` (the last row at or
    before), ``forward`` (the first at or after) or ``nearest`` (the closer one, the earlier
    of equals). ``exact=False`` leaves out rows of the same time. Rows further away than
    ``tolerance`` (days, microseconds or units) do not count. Attributes are the columns of
    ``side`` that are no key, ``side_on`` among them, under their own names.

    Only the distinct keys and times of ``df`` take part in the search, combined before the
    shuffle; its rows get the result by an equality join, which Spark broadcasts or splits
    by its size. Null keys and times match nothing. Of several rows of ``side`` with one key
    and time the one with the largest attributes counts. ``how="inner"`` leaves out rows
    without a match.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    names = [f"_by_{i}" for i in range(len(by))]
    attributes = [c for c in side.columns if c not in by.values()]
    clash = set(attributes) & set(df.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    points = df.select(*(F.col(c).alias(n) for c, n in zip(by, names)), _as_number(df, on).alias("_t")).na.drop().distinct()
    rows = side.select(*(F.col(c).alias(n) for c, n in zip(by.values(), names)), _as_number(side, side_on).alias("_t"),
                       F.struct(*attributes).alias("_row")).na.drop(subset=[*names, "_t"])
    points, rows = measured(points), measured(rows)
    signs = {"backward": [1], "forward": [-1], "nearest": [1, -1]}[direction]
    found = None
    for sign in signs:
        hit = _found(points, rows, names, sign, exact).filter(F.col("_hit_t").isNotNull())
        found = hit if found is None else found.unionAll(hit)
    away = F.abs(F.col("_t") - F.col("_hit_t"))
    if tolerance is not None:
        found = found.filter(away <= tolerance)
    if direction == "nearest":
        found = found.groupBy(*names, "_t").agg(F.min_by("_hit", F.struct(away, "_hit_t")).alias("_hit"))
    matched = measured(found.select(*names, "_t", "_hit.*"))
    timed = df.withColumn("_asof", _as_number(df, on))
    return enrich(timed, matched, {**dict(zip(by, names)), "_asof": "_t"}, how).drop("_asof")
