"""Weekly sums of a growing folder of dated rows.

A run takes the files that came since the last one, updates the open weeks in the query's
state, and ends (an available-now trigger), so it can be started by any scheduler. Each
micro-batch writes the weeks it changed under its own number; a batch that runs again after
a failure writes the same rows to the same place. The current sums are the newest rows per
key and week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

# Windows are cut from the start of 1970, a Thursday; weeks that end on Monday begin five days on.
_TUESDAY, _DAY = "5 days", 86_400_000_000


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The files of a folder, or of a pattern of paths, as a stream, each file once, oldest first. CSV files have a header."""
    reader = spark.readStream.schema(schema).format(fmt).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def weekly_totals(rows: DataFrame, keys: list[str], time: str, measures: dict[str, str], lateness: str, shift_back: int = 0) -> DataFrame:
    """Sums per key and week ending Monday of a stream (or a table), as ``{source column: output name}``.

    ``time`` is a timestamp, whose day is that in UTC, or one without a zone. Rows more than ``lateness`` behind the newest one
    of earlier batches may find their week closed; the state of a closed week is dropped, so
    state follows the open weeks and keys, not the history. ``shift_back`` moves rows back by
    days before they are assigned, and the watermark with them.
    """
    at = F.col(time)
    if isinstance(rows.schema[time].dataType, T.TimestampNTZType):  # the same clock time, in UTC
        at = F.from_utc_timestamp(at.cast("timestamp"), F.current_timezone())
    moved = rows.withColumn("_time", F.timestamp_micros(F.unix_micros(at) - shift_back * _DAY))
    week = F.window("_time", "7 days", "7 days", _TUESDAY)
    sums = moved.withWatermark("_time", lateness).groupBy(*keys, week.alias("_week")).agg(
        *(F.sum(c).alias(name) for c, name in measures.items()), F.count(F.lit(1)).alias("n_rows"))
    last = F.date_from_unix_date((F.unix_micros("_week.end") / _DAY).cast("int") - 1)
    return sums.withColumn("week", last).drop("_week")


def follow(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a run over what has arrived: the weeks that each micro-batch changes go to ``path/batch=<number>``.

    Write mode is overwrite of that folder alone, so a repeated batch replaces itself. The
    batch's files are one partition of a plain table.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def run_weekly_totals(rows: DataFrame, keys: list[str], time: str, measures: dict[str, str], path: str, checkpoint: str,
                      lateness: str = "14 days", shift_back: int = 0) -> dict:
    """One run to its end; returns how many rows the batches read and how many came too late."""
    query = follow(weekly_totals(rows, keys, time, measures, lateness, shift_back), path, checkpoint)
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in map(dict, _operators(p)))
    return {"read": sum(_field(p, "numInputRows") or 0 for p in progress), "late": late}


def _field(progress, name: str):
    return progress[name] if isinstance(progress, dict) else getattr(progress, name)


def _operators(progress) -> list[dict]:
    found = _field(progress, "stateOperators") or []
    return [o if isinstance(o, dict) else {"numRowsDroppedByWatermark": o.numRowsDroppedByWatermark} for o in found]


def current_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The sums as they stand: of each key and week the row of the newest batch."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "week", "batch")]
    newest = rows.groupBy(*keys, "week").agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "week", "_v.*")


def compact(spark: SparkSession, path: str, into: str, keys: list[str]) -> None:
    """The current sums as one table, for readers that should not see the history of batches."""
    current_totals(spark, path, keys).write.mode("overwrite").parquet(into)

