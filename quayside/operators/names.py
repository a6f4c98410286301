"""Text standardisation: recorded mass edits, and proposals of names that belong together.

Proposals are kept apart from edits on purpose: near spellings can be different places.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quayside.functions.numbers import to_number_keep_original
from quayside.functions.text import _col, fingerprint
from quayside.operators.joins import enrich


def edit_table(spark: SparkSession, edits: list[dict]) -> DataFrame:
    """Rows ``(raw, clean)`` from edits of the form ``{"from": [...], "to": ...}``. A recipe
    is written by hand, so it is small enough to come from the driver."""
    rows = [F.struct(F.lit(raw).alias("raw"), F.lit(edit["to"]).alias("clean"))
            for edit in edits for raw in edit["from"]]
    return spark.range(1).select(F.inline(F.array(*rows)))


def mass_edit(df: DataFrame, col: str, edits: DataFrame) -> DataFrame:
    """Listed spellings replaced, others kept. ``edits`` has one row per raw spelling."""
    joined = enrich(df, edits.select("raw", F.col("clean").alias("_clean")), {col: "raw"})
    return joined.withColumn(col, F.coalesce("_clean", col)).drop("_clean")


def copy_column(df: DataFrame, col: str, new: str) -> DataFrame:
    return df.withColumn(new, F.col(col))


def apply_recipe(df: DataFrame, recipe: str, column: str | None = None) -> DataFrame:
    """Runs a recorded cleaning recipe (JSON list of steps) in order: number conversion,
    column copy, mass edits, column removal. ``column`` overrides the recorded name of the
    column that is copied. Steps on columns the table lacks are an error."""
    for step in json.loads(recipe):
        kind = step["op"].split("/")[-1]
        if kind == "text-transform":
            if step["expression"].split(":")[-1] != "value.toNumber()":
                raise ValueError(f"unknown expression: {step['expression']}")
            df = df.withColumn(step["columnName"], to_number_keep_original(step["columnName"]))
        elif kind == "column-addition":
            df = copy_column(df, column or step["baseColumnName"], step["newColumnName"])
        elif kind == "mass-edit":
            df = mass_edit(df, step["columnName"], edit_table(df.sparkSession, step["edits"]))
        elif kind == "column-removal":
            if step["columnName"] not in df.columns:
                raise ValueError(f"no such column: {step['columnName']}")
            df = df.drop(step["columnName"])
        else:
            raise ValueError(f"unknown step: {step['op']}")
    return df


def name_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct names with their frequency; copies collapse before the shuffle."""
    return df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def cluster_by_key(df: DataFrame, col: str, key: Column) -> DataFrame:
    """Distinct names that share a key with another name, one row each:
    ``cluster, name, n, cluster_size``. Long form, so no group becomes one array."""
    names = name_counts(df, col).withColumn("cluster", key)
    sizes = names.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size")).filter("cluster_size > 1")
    return names.join(sizes, "cluster").select("cluster", "name", "n", "cluster_size")


def cluster_fingerprint(df: DataFrame, col: str) -> DataFrame:
    """Names alike but for accents, punctuation, case and spacing."""
    return cluster_by_key(df, col, fingerprint("name"))


def cluster_sound(df: DataFrame, col: str) -> DataFrame:
    """Names that sound alike."""
    return cluster_by_key(df, col, F.soundex(F.regexp_replace(F.upper("name"), "[^A-Z]+", "")))


def deletions(c: Column | str, depth: int) -> Column:
    """The text and every text made by deleting up to ``depth`` of its characters."""
    out = F.array(_col(c))
    for _ in range(depth):
        shorter = F.transform(out, lambda s: F.when(
            F.length(s) > 0,
            F.transform(F.sequence(F.lit(1), F.length(s)),
                        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
            .otherwise(F.array(s)))
        out = F.array_distinct(F.concat(out, F.flatten(shorter)))
    return out


def cluster_similar(df: DataFrame, col: str, max_distance: int = 1) -> DataFrame:
    """All pairs of distinct names within ``max_distance`` edits: ``left, right, distance``.

    Two texts that close share a text both reach by deleting at most ``max_distance``
    characters, so an equality join on those finds every pair; names are compared only
    when they share one. Work follows the number of near names, not that of all pairs.
    """
    names = name_counts(df, col).select("name")
    # dealt out by the join key before the join: a name table small enough to be broadcast
    # still makes many forms
    forms = names.select("name", F.explode(deletions("name", max_distance)).alias("form")).repartition("form")
    left = forms.withColumnRenamed("name", "left")
    right = forms.withColumnsRenamed({"name": "right", "form": "form_r"})
    candidates = left.join(right, (F.col("form") == F.col("form_r")) & (F.col("left") < F.col("right")))
    # -1 beyond the limit; compared first, so that only true pairs are shuffled for the distinct
    distance = F.levenshtein("left", "right", max_distance).alias("distance")
    return candidates.select("left", "right", distance).filter(F.col("distance") >= 0).distinct()


def canonical_name(clusters: DataFrame, group: str = "cluster", name: str = "name", n: str = "n") -> DataFrame:
    """Most frequent name of every group, the alphabetically first among equals."""
    first = F.struct(F.negative(F.col(n)).alias("minus_n"), F.col(name).alias("name"))
    return clusters.groupBy(group).agg(F.min(first)["name"].alias("canonical"))
