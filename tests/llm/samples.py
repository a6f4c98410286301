"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts: list, ids: list | None = None, sources: list | None = None) -> DataFrame:
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """Further columns named like those the operators use inside."""
    names = ("fingerprint keep_id group_size kept t1 t2 pos keep key size score h1 n root node shard slot taken copies "
             "words label weight target cut bucket rank kept_id kept_bits kept_sha member text_ doc_ids").split()
    return df.selectExpr("*", *(f"'x' as {n}" for n in names))


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", " ", "\n", "\n\n", "a", "x" * 50_000, "long word line " * 5_000, "naïve Größe line", "tab\tand\x0bvt\x0cff\rcr",
           "Kelvin K sign and İ dots", "nul \x00 inside", "emoji 😀 text", "same text here", "same text here", None, ""]
