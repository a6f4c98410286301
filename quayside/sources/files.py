"""Shipment folders, dimension files, tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quayside.operators.columns import dedupe, drop_columns


def read_shipments(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every CSV file of a folder as one table, without an inference pass.

    The files of a folder share a layout. Only their header line is looked at, so that
    columns are matched by title: unknown columns (an unnamed trailing one, say) are
    ignored and missing ones are null.
    """
    titles = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in schema.fields}
    layout = T.StructType([known.get(t, T.StructField(t, T.StringType())) for t in titles])
    df = spark.read.schema(layout).option("header", True).option("escape", '"').csv(path)
    return df.select(*(F.col(f"`{f.name}`") if f.name in titles else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields))


def read_dim(spark: SparkSession, path: str, schema: T.StructType, key: str, drop_blank: bool = True,
             null_value: str = "", index_column: bool = False) -> DataFrame:
    """A dimension file: columns by position, named by ``schema``; a byte order mark, an
    unnamed leading index and rows with a blank key do not get through. ``null_value`` is a
    text that means null in this file (such as ``NA``)."""
    layout = T.StructType([T.StructField("_index", T.StringType()), *schema.fields]) if index_column else schema
    df = spark.read.schema(layout).option("header", True).option("escape", '"') \
        .option("nullValue", null_value).csv(path)
    if index_column:
        df = df.drop("_index")
    if drop_blank:
        df = df.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A prepared set. Parquet brings its schema; for CSV one is needed."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = "year", mode: str = "errorifexists",
                fmt: str = "parquet") -> None:
    """Partitioned by year, so that period filters skip files. Rows of a year stay spread
    over the tasks that hold them: no shuffle, and a big year has many files."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def export_distinct(df: DataFrame, col: str, path: str) -> None:
    """Distinct values of a column as CSV, for curation by hand."""
    df.select(col).distinct().write.option("header", True).option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a log, such as search trials."""
    df.write.mode("append").parquet(path)


def publish_extract(df: DataFrame, drop_cols: list[str], path: str | None = None) -> DataFrame:
    """Distinct rows without the columns not meant for publication, written when a path is given."""
    out = dedupe(drop_columns(df, drop_cols))
    if path:
        out.write.parquet(path)
    return out
