"""Numeric functions: coercion, flags, size classes, recoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quayside.functions.text import _col, strip_chars


def to_number(c: Column | str, thousands: str = ",") -> Column:
    """Number from text, null when it is none; thousands separators are removed."""
    return strip_chars(_col(c).cast("string"), thousands).try_cast("double")


def to_number_keep_original(c: Column | str) -> Column:
    """Text of the number where the value is one, the value itself elsewhere."""
    c = _col(c)
    return F.coalesce(c.try_cast("double").cast("string"), c)


def to_flag(c: Column | str, least: int = 1) -> Column:
    """Counts of ``least`` or more become 1; smaller counts stay."""
    c = _col(c)
    return F.when(c >= least, F.lit(1)).otherwise(c)


def bin_by_thresholds(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """First label whose upper edge (inclusive) holds the value; the last label beyond all edges."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    c = _col(c)
    out = F
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge, label)
    return out.when(c > edges[-1], labels[-1])


def code_is_mixed(c: Column | str, longest_single: int = 7) -> Column:
    """1 when the code text is longer than one code, else 0."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return (F.length(text) > longest_single).cast("int")


def recode(c: Column | str, mapping: dict) -> Column:
    """Value replaced by its entry in a small mapping, unchanged when it has none."""
    c = _col(c)
    out = F
    for raw, clean in mapping.items():
        out = out.when(c == F.lit(raw), F.lit(clean))
    return out.otherwise(c)


def yes_no_to_bool(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == "Yes", True).when(c == "No", False)
