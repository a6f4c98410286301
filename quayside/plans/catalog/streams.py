"""Queries that follow files as they arrive."""

from pyspark.sql import functions as F

from quayside.plans.catalog.aggregating import rounded
from quayside.plans.catalog.joining import WEEK_SQL
from quayside.plans.registry import query
from quayside.plans.views import WEEKLY_SOURCE_SQL
from quayside.session import new_shared_path
from quayside.streaming import weekly


@query("stream_weekly_sum", f"""
    select nation_key, event_type, {WEEK_SQL} as week, round(sum(value), 4) as cases, count(*) as n_rows from {WEEKLY_SOURCE_SQL} group by all""")
def stream_weekly_sum(t):
    # a pattern, as the table may be a file and streams read folders or patterns
    arrivals = weekly.read_arrivals(t.spark, f"{t.folder}/events.parque[t]", t.events.schema)
    rows = arrivals.select(F.pmod("user_id", F.lit(25)).cast("int").alias("nation_key"), "event_type", F.col("ts").alias("at"), "value")
    path, keys = new_shared_path(t.spark, "weekly"), ["nation_key", "event_type"]
    # no row is late here: the table spans less
    weekly.run_weekly_totals(rows, keys, "at", {"value": "cases"}, path, new_shared_path(t.spark, "weekly-state"), lateness="3650 days")
    return rounded(weekly.current_totals(t.spark, path, keys), 4, "cases")
