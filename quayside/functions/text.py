"""Text functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from quayside.fixed_values import REFRIGERATED_WORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_suffix(c: Column | str, suffix: str) -> Column:
    """Text without ``suffix`` at its end (``20190331.0`` -> ``20190331``)."""
    return F.regexp_replace(_col(c), re.escape(suffix) + "$", "")


def prefix(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def after_last(c: Column | str, sep: str) -> Column:
    """Text after the last ``sep``, whole text when there is none; blanks are kept."""
    return F.substring_index(_col(c), sep, -1)


def before_last(c: Column | str, sep: str) -> Column:
    """Text before the last ``sep``, null when there is none."""
    c = _col(c)
    tail = F.substring_index(c, sep, -1)
    return F.when(F.instr(c, sep) > 0, F.left(c, F.length(c) - F.length(tail) - F.lit(len(sep))))


def tail_code(c: Column | str, n: int = 2) -> Column:
    """Last ``n`` characters once parentheses and digits are gone (``NAME (CN)`` -> ``CN``)."""
    return F.right(F.regexp_replace(_col(c), r"[()\d]+", ""), F.lit(n))


def contains_any(c: Column | str, words: list[str]) -> Column:
    """True when any word occurs, case-sensitive."""
    return _col(c).rlike("|".join(re.escape(w) for w in words))


def strip_chars(c: Column | str, chars: str) -> Column:
    return F.translate(_col(c), chars, "")


def container_flags(description: Column | str, containerised: Column,
                    words: list[str] = REFRIGERATED_WORDS) -> tuple[Column, Column]:
    """(refrigerated, dry) 0/1 flags from a description, both 0 when not containerised."""
    cold = contains_any(description, words)
    refrigerated = F.when(~containerised, 0).when(cold, 1).otherwise(0)
    dry = F.when(~containerised, 0).when(cold, 0).otherwise(1)
    return refrigerated, dry


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    pairs = [
        (chr(code), base[0])
        for code in range(0xC0, 0x180)
        if len(base := unicodedata.normalize("NFD", chr(code))) > 1
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fingerprint(c: Column | str) -> Column:
    """Normal form of a name: no accents, punctuation or blanks, upper case."""
    accented, plain = _accent_table()
    return F.regexp_replace(F.upper(F.translate(_col(c), accented, plain)), "[^A-Z0-9]+", "")
