"""Unions and comparisons of key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_conformed(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ; missing columns are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    return union_conformed(first, *others).distinct()


def set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.subtract(right)


def set_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return left.intersect(right)
