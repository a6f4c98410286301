"""Projections, filters and row predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Without ``cols``; a name the table does not have is an error, not a silent no-op."""
    cols = list(cols)
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*cols)


def conform(df: DataFrame, mapping: dict[str, str], drop: Iterable[str] = ()) -> DataFrame:
    """Renamed to the common vocabulary, without the columns in ``drop``."""
    return df.drop(*drop).withColumnsRenamed(mapping)


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where none of ``cols`` is null."""
    return df.na.drop(subset=list(cols))


def complete_cases(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(values))


def year_slice(df: DataFrame, first: int | None = None, last: int | None = None, col: str = "year",
               date: str | None = None) -> DataFrame:
    """Years ``first..last``, both included. On a table written by year the filter skips
    folders; where the year is only computed from a date, name the ``date`` column, so that
    the bounds reach the scan as bounds of the date."""
    start_of = (lambda y: F.make_date(F.lit(y), F.lit(1), F.lit(1))) if date else F.lit
    by = F.col(date or col)
    if first is not None:
        df = df.filter(by >= start_of(first))
    if last is not None:
        df = df.filter(by < start_of(last + 1))
    return df


def cap(df: DataFrame, col: str, below: float) -> DataFrame:
    return df.filter(F.col(col) < below)


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced by a constant per column."""
    return df.na.fill(values)


def narrow(df: DataFrame, floats: Iterable[str] = (), ints: Iterable[str] = ()) -> DataFrame:
    """Narrow types for model input; integers are cut, not rounded."""
    return df.withColumns({**{c: F.col(c).cast("float") for c in floats},
                           **{c: F.col(c).cast("int") for c in ints}})


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row distinct; copies collapse in the map-side aggregate before the shuffle."""
    return df.dropDuplicates()


def split_apply(df: DataFrame, branches: list[tuple[Column, dict[str, object]]],
                otherwise: dict[str, object] | None = None) -> DataFrame:
    """Each row takes the column values of the first branch whose predicate holds.

    One projection instead of splitting the table, treating the parts and joining them
    again. Every branch gives the same columns; plain values become literals.
    """
    otherwise = otherwise or {}
    names = list(dict.fromkeys(n for _, values in branches for n in values))
    out: dict[str, Column] = {}
    for name in names:
        expr = F
        for predicate, values in branches:
            fallback = F.col(name) if name in df.columns else F.lit(None)
            expr = expr.when(predicate, _as_column(values.get(name, fallback)))
        rest = otherwise.get(name, F.col(name) if name in df.columns else None)
        out[name] = expr.otherwise(_as_column(rest))
    return df.withColumns(out)


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
