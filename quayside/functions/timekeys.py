"""Dates and the period keys that side tables are joined on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quayside.functions.text import _col


def parse_date(c: Column | str, fmt: str, last_year: int | None = None) -> Column:
    """Date from text (``yyyyMMdd``, ``M/d/yyyy``), null when it does not parse. Two-digit
    years (``d-MMM-yy``) mean the century that does not go beyond ``last_year``."""
    date = F.try_to_timestamp(_col(c).cast("string"), F.lit(fmt)).cast("date")
    if last_year is None:
        return date
    return F.when(F.year(date) > last_year, F.add_months(date, -1200)).otherwise(date)


def month_key(d: Column | str) -> Column:
    return F.trunc(_col(d), "month")


def year_week(d: Column | str) -> Column:
    """``2020-w07``: weeks start on Sunday, days before the first Sunday are week 00."""
    d = _col(d)
    week = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("string")
    return F.concat(F.year(d).cast("string"), F.lit("-w"), F.lpad(week, 2, "0"))


def week_ending_monday(d: Column | str, shift_back: int = 0) -> Column:
    """Monday that ends the week of ``d``, after moving ``d`` back by ``shift_back`` days."""
    return F.next_day(F.date_sub(_col(d), shift_back + 1), "MO")


def shift_days(d: Column | str, n: int) -> Column:
    return F.date_add(_col(d), n)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def time_features(df: DataFrame, date: str) -> DataFrame:
    """Adds ``year``, ``year_month`` (first day of month) and ``year_week``."""
    return df.withColumns({
        "year": F.year(date),
        "year_month": month_key(date),
        "year_week": year_week(date),
    })
