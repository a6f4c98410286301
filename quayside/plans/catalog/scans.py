"""Sources and sinks."""

from pyspark.sql import functions as F, types as T

from quayside.operators.columns import year_slice
from quayside.operators.sets import union_conformed
from quayside.plans.registry import query
from quayside.plans.views import TRIALS_SQL, shipments_sql
from quayside.session import new_shared_path
from quayside.sources.files import (append_rows, export_distinct, publish_extract, read_dim, read_shipments,
                                    read_table, write_table)

SHIPMENT_FILE = T.StructType([
    T.StructField("Date", T.StringType()), T.StructField("HS", T.StringType()),
    T.StructField("Metric Tons", T.DoubleType()), T.StructField("Teus", T.DoubleType()),
])


@query("scan_union_count", f"""
    select trade_direction, count(*) as n_rows, 4 as n_columns, round(sum(metric_tons), 4) as metric_tons,
           count(distinct cast(ship_date as varchar)) as n_dates
    from {shipments_sql("part")} group by trade_direction""")
def scan_union_count(t):
    rows = t.shipments("part").select(
        F.date_format("ship_date", "yyyyMMdd").alias("Date"), F.col("hs_class").cast("string").alias("HS"),
        F.col("metric_tons").alias("Metric Tons"), F.col("teus").alias("Teus"), "trade_direction")
    sources = []
    for direction in ("Import", "Export"):
        path = new_shared_path(t.spark, "shipments-csv")
        rows.filter(F.col("trade_direction") == direction).drop("trade_direction") \
            .write.option("header", True).csv(path)
        read = read_shipments(t.spark, path, SHIPMENT_FILE)
        sources.append(read.withColumns({"trade_direction": F.lit(direction), "n_columns": F.lit(len(read.columns))}))
    return union_conformed(*sources).groupBy("trade_direction", "n_columns").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("Metric Tons"), 4).alias("metric_tons"),
        F.count_distinct("Date").alias("n_dates"))


@query("dim_scan_clean", """
    select s_name as us_company, s_nationkey as nation_key, s_acctbal as balance
    from supplier where s_acctbal >= 500""")
def dim_scan_clean(t):
    path = new_shared_path(t.spark, "dim-csv")
    # an index column without a title, and blank keys such as curated files have
    t.supplier.select(
        F.col("s_suppkey").alias(" "), F.when(F.col("s_acctbal") >= 500, F.col("s_name")).otherwise("  ").alias("name"),
        "s_nationkey", "s_acctbal").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("us_company", T.StringType()), T.StructField("nation_key", T.IntegerType()),
                           T.StructField("balance", T.DoubleType())])
    return read_dim(t.spark, path, schema, "us_company", index_column=True)


@query("sink_roundtrip", f"""
    select year, trade_direction, count(*) as n, round(sum(metric_tons), 4) as metric_tons
    from {shipments_sql()} where year between 1997 and 1999 group by year, trade_direction""")
def sink_roundtrip(t):
    path = new_shared_path(t.spark, "warehouse")
    write_table(t.shipments(), path, "year")
    return year_slice(read_table(t.spark, path), 1997, 1999).groupBy("year", "trade_direction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


@query("distinct_values", "select distinct o_custkey as customer_key from orders")
def distinct_values(t):
    path = new_shared_path(t.spark, "curate")
    export_distinct(t.orders.withColumnRenamed("o_custkey", "customer_key"), "customer_key", path)
    return read_table(t.spark, path, "csv", T.StructType([T.StructField("customer_key", T.LongType())]))


@query("trial_append", f"""
    select boosting_type, count(*) as n, min(loss) as best, max(iteration) as last_iteration
    from {TRIALS_SQL} group by boosting_type""")
def trial_append(t):
    path = new_shared_path(t.spark, "trial-log")
    trials = t.trials()
    append_rows(trials.filter(F.col("loss") < 50), path)
    append_rows(trials.filter(F.col("loss") >= 50), path)
    return read_table(t.spark, path).groupBy("boosting_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("loss").alias("best"), F.max("iteration").alias("last_iteration"))


@query("extract_columns", f"""
    select distinct trade_direction, year, hs_group, brand, status, metric_tons from {shipments_sql("part")}""")
def extract_columns(t):
    return publish_extract(t.shipments("part"), [
        "order_key", "line_number", "part_key", "supplier_key", "value_usd", "discount", "tax", "ship_date",
        "goods", "teus", "hs_class"])
