"""Reads that keep account of every line, and tables and profiles that grow by deliveries."""

from pyspark.sql import functions as F, types as T

from quayside.operators import sketches
from quayside.plans.catalog.aggregating import rounded
from quayside.plans.catalog.composites import SIZE_EDGES, _size_sql
from quayside.plans.increments import SizedFact
from quayside.plans.registry import query
from quayside.plans.views import SHIPMENT_KEY, shipments_sql
from quayside.session import new_shared_path, settle
from quayside.sources.checked import read_checked

CHECKED_FILE = T.StructType([
    T.StructField("Date", T.StringType()), T.StructField("HS", T.IntegerType()),
    T.StructField("Metric Tons", T.DoubleType()), T.StructField("Port", T.StringType()),
])


@query("checked_read", f"""
    with s as (select *, case when discount = 0.0 then 'unknown' else cast(metric_tons as varchar) end as tons, case when tax > 0.0 then 'd' end as day
        from {shipments_sql("part")}),
    judged as (select case when trade_direction = 'Export' and status = 'O' then 'header lacks Date' when day is null then 'Date is missing'
        when tons = 'unknown' then 'Metric Tons is no double' else 'kept' end as outcome, metric_tons, hs_class from s)
    select outcome, count(*) as n, round(sum(case when outcome = 'kept' then metric_tons end), 4) as metric_tons,
        sum(case when outcome = 'kept' then hs_class end)::bigint as hs from judged group by outcome""")
def checked_read(t):
    rows = t.shipments("part").select(
        F.when(F.col("tax") > 0.0, F.date_format("ship_date", "yyyyMMdd")).alias("Date"), F.col("hs_class").alias("HS"),
        F.when(F.col("discount") == 0.0, "unknown").otherwise(F.col("metric_tons").cast("string")).alias("Metric Tons"),
        F.col("goods").alias("Notes"), "trade_direction", "status")
    path = new_shared_path(t.spark, "deliveries-csv")
    imports, exports = (rows.filter(F.col("trade_direction") == d) for d in ("Import", "Export"))
    for part, columns in ((imports, ["Date", "HS", "Metric Tons"]), (exports.filter("status = 'F'"), ["Notes", "Metric Tons", "HS", "Date"]),
                          (exports.filter("status = 'O'"), ["HS", "Metric Tons", "Notes"])):
        part.select(*columns).write.mode("append").option("header", True).csv(path)
    read = read_checked(t.spark, path, CHECKED_FILE, required=["Date"])
    kept = read.kept.select(F.lit("kept").alias("outcome"), F.col("Metric Tons").alias("metric_tons"), F.col("HS").cast("long").alias("hs"))
    lost = read.rejected.select(F.col("reason").alias("outcome"), F.lit(None).cast("double").alias("metric_tons"), F.lit(None).cast("long").alias("hs"))
    return kept.unionAll(lost).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"), F.sum("hs").alias("hs"))


@query("incremental_fact", f"""
    with s as (select distinct us_company, foreign_company, year, {", ".join(SHIPMENT_KEY)}, metric_tons from {shipments_sql("supplier", "customer")}),
        u as (select us_company, {_size_sql("sum(metric_tons)")} as us_company_size from s group by 1 having sum(metric_tons) > 15000),
        a as (select s.*, us_company_size from s join u using (us_company)),
        f as (select foreign_company, {_size_sql("sum(metric_tons)")} as foreign_company_size from a group by 1 having sum(metric_tons) > 500)
    select year, us_company_size, foreign_company_size, count(*) as n, round(sum(metric_tons), 4) as metric_tons from a join f using (foreign_company) group by all""")
def incremental_fact(t):
    rows = settle(t.shipments("supplier", "customer").select("us_company", "foreign_company", "year", *SHIPMENT_KEY, "metric_tons", "trade_direction"), "rows")
    fact = SizedFact(t.spark, new_shared_path(t.spark, "sized"), {"us_company": "us_company_size", "foreign_company": "foreign_company_size"})
    for direction in ("Import", "Export", "Import"):  # the last delivery repeats the first
        fact.deliver(rows.filter(F.col("trade_direction") == direction).drop("trade_direction"))
    return fact.read([15000, 500], SIZE_EDGES).groupBy("year", "us_company_size", "foreign_company_size").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


PROFILED = {"status": False, "trade_direction": False, "hs_class": True, "foreign_nation": True, "teus": True}


def _profile_sql(c: str, number: bool) -> str:
    value = "nullif(hs_class, 7)" if c == "hs_class" else c
    figures = f"min({value})::double, max({value})::double, round(avg({value}), 6)" if number else "null::double, null::double, null::double"
    return f"""select year >= 1998, '{c}', count(*), count(*) filter ({value} is null), count(distinct {value}), {figures}
        from {shipments_sql("part", "customer")} group by 1"""


@query("period_profile", f"""
    with p(late, "column", n, missing, "distinct", low, high, mean) as ({" union all ".join(_profile_sql(*c) for c in PROFILED.items())}) select * from p""")
def period_profile(t):
    s = t.shipments("part", "customer").withColumn("hs_class", F.nullif("hs_class", F.lit(7)))
    kept = settle(sketches.period_sketches(s, list(PROFILED), ["year"]), "sketches")
    merged = sketches.merge_sketches(kept.withColumn("late", F.col("year") >= 1998), ["late"])
    return rounded(sketches.read_sketches(merged, []), 6, "mean")
