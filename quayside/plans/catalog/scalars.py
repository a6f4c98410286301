"""Scalar functions."""

from pyspark.sql import functions as F

from quayside.functions import text, timekeys
from quayside.operators.trials import trials_to_columns, trials_to_rows
from quayside.plans.registry import query
from quayside.plans.views import SHIPMENT_KEY, TRIALS_SQL, shipments_sql

KEY = ", ".join(SHIPMENT_KEY)


@query("str_strip_suffix", """
    select l_orderkey as order_key, l_linenumber as line_number, strftime(l_shipdate, '%Y%m%d') as date from lineitem""")
def str_strip_suffix(t):
    written = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".0"))
    return t.lineitem.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
                             text.strip_suffix(written, ".0").alias("date"))


@query("str_prefix", "select p_partkey as part_key, substr(p_name, 1, 2) as code from part")
def str_prefix(t):
    return t.part.select(F.col("p_partkey").alias("part_key"), text.prefix("p_name", 2).alias("code"))


# company names as they are written in shipment files: NAME, SEGMENT, STATE
COMPANY_SQL = """(select c_custkey, case when c_acctbal < 1000 then c_name
    else concat(c_name, ', ', c_mktsegment, ', N', c_nationkey) end as company from customer)"""


def _companies(t):
    written = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(", N"), F.col("c_nationkey").cast("string"))
    return t.customer.select(F.col("c_custkey").alias("customer_key"),
                             F.when(F.col("c_acctbal") < 1000, F.col("c_name")).otherwise(written).alias("company"))


@query("str_after_last", f"""
    select c_custkey as customer_key, list_extract(string_split(company, ','), -1) as state,
           trim(list_extract(string_split(company, ','), -1)) as state_trimmed from {COMPANY_SQL}""")
def str_after_last(t):
    state = text.after_last("company", ",")
    return _companies(t).select("customer_key", state.alias("state"), F.trim(state).alias("state_trimmed"))


@query("str_before_last", f"""
    select c_custkey as customer_key, case when contains(company, ',') then
        array_to_string(list_slice(string_split(company, ','), 1, -2), ',') end as aggregate_name from {COMPANY_SQL}""")
def str_before_last(t):
    return _companies(t).select("customer_key", text.before_last("company", ",").alias("aggregate_name"))


@query("str_country_code", """
    select c_custkey as customer_key,
           right(regexp_replace(concat(c_name, ' (', substr(c_mktsegment, 1, 2), ')'), '[()\\d]+', '', 'g'), 2) as country
    from customer""")
def str_country_code(t):
    written = F.concat("c_name", F.lit(" ("), F.substring("c_mktsegment", 1, 2), F.lit(")"))
    return t.customer.select(F.col("c_custkey").alias("customer_key"), text.tail_code(written).alias("country"))


@query("parse_dates", """
    select o_orderkey as order_key, cast(o_orderdate as date) as from_compact, cast(o_orderdate as date) as from_us,
           cast(null as date) as from_na from orders""")
def parse_dates(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        timekeys.parse_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd").alias("from_compact"),
        timekeys.parse_date(F.date_format("o_orderdate", "M/d/yyyy"), "M/d/yyyy").alias("from_us"),
        timekeys.parse_date(F.lit("NA"), "M/d/yyyy").alias("from_na"))


@query("time_features", f"""
    select {KEY}, year, cast(date_trunc('month', ship_date) as date) as year_month,
           strftime(ship_date, '%Y-w%U') as year_week from {shipments_sql()}""")
def time_features(t):
    return timekeys.time_features(t.shipments(), "ship_date").select(*SHIPMENT_KEY, "year", "year_month", "year_week")


@query("days_between", f"""
    select {KEY}, cast(ship_date - order_date as integer) as lead_days, cast(ship_date - 7 as date) as week_before
    from {shipments_sql("order")}""")
def days_between(t):
    return t.shipments("order").select(
        *SHIPMENT_KEY, timekeys.days_between("ship_date", "order_date").alias("lead_days"),
        timekeys.shift_days("ship_date", -7).alias("week_before"))


@query("params_explode", f"""
    select iteration, 'k' as parameter, json_extract_string(params, '$.k') as setting from {TRIALS_SQL}""")
def params_explode(t):
    return trials_to_rows(t.trials()).select("iteration", "parameter", "setting")


@query("params_pivot", f"""
    select iteration, loss, cast(json_extract_string(params, '$.k') as double) as k,
           cast(null as varchar) as booster from {TRIALS_SQL}""")
def params_pivot(t):
    # the same text as a search log writes it, with single quotes
    log = t.trials().withColumn("params", F.translate("params", '"', "'"))
    return trials_to_columns(log, numeric=["k"], text=["booster"]).select("iteration", "loss", "k", "booster")
