"""Joins of the fact with dimensions, side tables and entity lists.

No join here carries a broadcast hint: Spark broadcasts a side only when its size is
below ``spark.sql.autoBroadcastJoinThreshold``, from file statistics before and from
measured shuffle sizes during the run, and uses a sort-merge join with adaptive skew
splitting beyond it. A side that is computed first has no file size and would be guessed to be as
large as its input, so :func:`measured` writes it once. Adaptive execution splits hot keys of inner, left and semi joins
only, so the outer variants below are built from those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quayside.session import settle

Keys = dict[str, str]


def _condition(df: DataFrame, dim: DataFrame, on: Keys, null_safe: bool) -> Column:
    parts = [df[a].eqNullSafe(dim[b]) if null_safe else df[a] == dim[b] for a, b in on.items()]
    return reduce(lambda x, y: x & y, parts)


def _private(dim: DataFrame, on: Keys) -> tuple[DataFrame, Keys]:
    """Key columns renamed so that they cannot clash with fact columns."""
    renamed = {key: f"_dim_{i}" for i, key in enumerate(on.values())}
    return dim.withColumnsRenamed(renamed), {a: renamed[b] for a, b in on.items()}


def keyed(dim: DataFrame, *keys: str) -> DataFrame:
    """A dimension ready to join: rows with a null key and whole-row copies are gone, so
    the join cannot fan out through copies and the fact needs no distinct afterwards."""
    return dim.na.drop(subset=list(keys)).dropDuplicates()


def measured(side: DataFrame) -> DataFrame:
    """A computed side as a table in the shared folder, so that the planner knows its size.

    When it is small, Spark broadcasts it by its own limit and the fact is neither shuffled
    nor skewed by hot keys; when it is not, the join is a shuffled one. Also the way to
    use a side more than once without computing it again. Runs a job.
    """
    return settle(side, "side")


def enrich(df: DataFrame, dim: DataFrame, on: Keys, how: str = "left", null_safe: bool = False,
           role: str = "") -> DataFrame:
    """Attributes of ``dim`` added to the fact. ``on`` maps fact columns to dimension
    columns; ``role`` prefixes the attribute names, so one dimension can play several."""
    attributes = [c for c in dim.columns if c not in on.values()]
    dim = dim.withColumnsRenamed({c: f"{role}{c}" for c in attributes})
    dim, on = _private(dim, on)
    return df.join(dim, _condition(df, dim, on, null_safe), how).drop(*on.values())


def standardise(df: DataFrame, names: DataFrame, raw: str, clean: str, null_safe: bool = False) -> DataFrame:
    """Raw names replaced by those of a name map; rows whose name the map lacks are dropped."""
    return enrich(df, names.select(raw, clean), {raw: raw}, "inner", null_safe).drop(raw)


def keep_qualifying(df: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """Rows of the listed entities, with the entity attributes."""
    return enrich(df, entities, {on: on}, "inner")


def semi_qualifying(df: DataFrame, entities: DataFrame, on: Keys) -> DataFrame:
    """Rows of the listed entities, nothing added."""
    entities, on = _private(entities.select(*on.values()), on)
    return df.join(entities, _condition(df, entities, on, False), "left_semi")


def unmatched(df: DataFrame, dim: DataFrame, on: Keys) -> DataFrame:
    """Rows the dimension has no entry for, null keys included."""
    dim, on = _private(dim.select(*on.values()), on)
    return df.join(dim, _condition(df, dim, on, False), "left_anti")


def _without_match(dim: DataFrame, df: DataFrame, on: Keys) -> DataFrame:
    """Rows of ``dim`` whose keys the fact never has; the fact is reduced to its keys first."""
    fact_keys, on = _private(df.select(*on.values()).distinct(), on)
    return dim.join(fact_keys, _condition(dim, fact_keys, on, False), "left_anti")


def preserve_dim(df: DataFrame, dim: DataFrame, on: Keys, seen: DataFrame | None = None) -> DataFrame:
    """Right join: every dimension row stays, fact rows without one go.

    The matches are an inner join; dimension rows without trade are found against the
    distinct fact keys, so a hot key never sits whole in one task. ``seen`` is a smaller
    table with all keys of the fact, where there is one, and spares a pass over the fact.
    """
    kept, private = _private(dim, on)
    matched = df.join(kept, _condition(df, kept, private, False), "inner").drop(*private.keys()) \
        .withColumnsRenamed({v: k for k, v in private.items()})
    idle = _without_match(dim, df if seen is None else seen, {b: a for a, b in on.items()}).withColumnsRenamed({b: a for a, b in on.items()})
    return matched.unionByName(idle, allowMissingColumns=True)


def outer_period_join(df: DataFrame, side: DataFrame, on: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Full outer join on shared key columns: all fact rows, and all side rows of periods
    without trade. Left join and leftovers, for the reason given in :func:`preserve_dim`,
    where ``seen`` is explained."""
    side, keys = measured(side), {c: c for c in on}
    matched = enrich(df, side, keys, "left")
    return matched.unionByName(_without_match(side, df if seen is None else seen, keys), allowMissingColumns=True)


def expand_group(df: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """One row per member for group rows, others as they are; ``is_member`` tells which.

    ``members`` has the columns ``group`` and ``member``; ``df`` names groups and single
    members alike in the column ``group``. The name goes to ``member``.
    """
    dim, on = _private(members.select(group, member), {group: group})
    joined = df.join(dim, _condition(df, dim, on, False), "left").drop(*on.values())
    return joined.withColumns({
        "is_member": F.col(member).isNotNull(),
        member: F.coalesce(F.col(member), F.col(group)),
    }).drop(group)
