"""CSV folders read with nothing lost in silence: what does not fit is a row of a reject table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quayside.session import settle

_LINE, _FILE = "_line", "_file"


@dataclass
class Checked:
    """``kept`` has the columns of the schema; ``rejected`` has ``file, reason, line``, a row per line. Both come from one written table."""

    kept: DataFrame
    rejected: DataFrame


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, titles)``: the first line of every CSV file of a folder. Of a large file only its first part can hold it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("at")).filter("start = 0")
    # the places of the first lines, a number per file, then those lines: taking the texts along would sort every line
    at = settle(lines.groupBy("file").agg(F.min("at").alias("first")).select("first"), "first-lines")
    first = lines.join(at, F.col("at") == F.col("first"), "left_semi").withColumnRenamed("value", "header")
    titles = F.from_json(F.to_json(F.split(F.regexp_replace("header", "^﻿", ""), ",")), "array<string>")
    return first.select("file", F.transform(titles, lambda t: F.trim(t, F.lit(' "\r'))).alias("titles"))


def _wrong(column: T.StructField) -> Column:
    """Whether a text is there that is no value of the column's type."""
    raw = F.col(f"_raw.`{column.name}`")
    return raw.isNotNull() & (F.trim(raw) != "") & F.trim(raw).try_cast(column.dataType).isNull()


def read_checked(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = (), fmt: dict[str, str] | None = None) -> Checked:
    """Every line of a folder of CSV files, kept or rejected.

    Columns are matched by title, file by file: a folder whose files have their columns in
    another order, or more of them, reads like any other. Reasons to reject:

    * ``header lacks <title>``: all lines of a file without a title that is ``required``;
    * ``malformed``: more or fewer fields than the header;
    * ``<title> is no <type>``: a text that does not convert;
    * ``<title> is missing``: a required value that is blank.

    The first that holds, in the order of the schema, is reported. Headers are looked up
    first; files of one header are read together. The lines are parsed once, into one
    written table that both results read, so every line is in exactly one of them.
    ``fmt`` has further options of the CSV reader.
    """
    headers = file_headers(spark, path).groupBy("titles").agg(F.collect_list("file").alias("files")).collect()  # a row per different header
    out = None
    for titles, files in sorted((list(r.titles), sorted(r.files)) for r in headers):
        part = _read_alike(spark, files, titles, schema, required, fmt or {})
        out = part if out is None else out.unionAll(part)
    if out is None:
        empty = spark.createDataFrame([], schema)
        return Checked(empty, spark.createDataFrame([], "file string, reason string, line string"))
    table = settle(out, "checked")
    return Checked(table.filter("_reason is null").select(*(F.col(f"`{f.name}`") for f in schema.fields)),
                   table.filter("_reason is not null").select(F.col(_FILE).alias("file"), F.col("_reason").alias("reason"), F.col(_LINE).alias("line")))


def _read_alike(spark: SparkSession, files: list[str], titles: list[str], schema: T.StructType, required: list[str], fmt: dict[str, str]) -> DataFrame:
    """Lines of files that share a header: the values of the schema, the reason to reject, the line and its file."""
    names = [f"{t}#{i}" if t in titles[:i] else t for i, t in enumerate(titles)]  # a repeated title counts once
    layout = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(_LINE, T.StringType())])
    reader = spark.read.schema(layout).option("header", True).option("enforceSchema", True).option("escape", '"') \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).options(**fmt)
    lines = reader.csv(files).withColumn(_FILE, F.col("_metadata.file_path"))
    known = [f for f in schema.fields if f.name in names]
    raw = lines.select(F.struct(*(F.col(f"`{f.name}`") for f in known)).alias("_raw") if known else F.lit(None).alias("_raw"),
                       F.concat_ws(",", *(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names)).alias("_read"), _LINE, _FILE)
    lacks = [t for t in required if t not in names]
    reason = F.lit(f"header lacks {lacks[0]}") if lacks else F.when(F.col(_LINE).isNotNull(), "malformed")
    for f in known if not lacks else ():
        reason = F.coalesce(reason, F.when(_wrong(f), f"{f.name} is no {f.dataType.simpleString()}"))
        if f.name in required:
            text = F.col(f"_raw.`{f.name}`")
            reason = F.coalesce(reason, F.when(text.isNull() | (F.trim(text) == ""), f"{f.name} is missing"))

    def value(f: T.StructField) -> Column:
        if f not in known:
            return F.lit(None).cast(f.dataType)
        text = F.col(f"_raw.`{f.name}`")
        return text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)
    return raw.select(*(value(f).alias(f.name) for f in schema.fields), reason.alias("_reason"), F.coalesce(_LINE, "_read").alias(_LINE), _FILE)
