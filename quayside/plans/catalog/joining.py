"""Joins."""

from pyspark.sql import functions as F

from quayside.fixed_values import HS_CLASSES, SIZE_LABELS
from quayside.functions.numbers import bin_by_thresholds
from quayside.functions.timekeys import month_key
from quayside.operators import joins
from quayside.operators.aggregates import first_nonzero, totals_over, weekly_sum
from quayside.operators.windows import pct_from_baseline
from quayside.plans.registry import query
from quayside.plans.views import NATIONS_SQL, SHIPMENT_KEY, WEEKLY_SOURCE_SQL, shipments_sql

KEY = ", ".join(SHIPMENT_KEY)
HS_LIST = ", ".join(map(str, HS_CLASSES))

# product classes of interest with a group each, from the parts themselves
GROUPS_SQL = f"""(select cast(replace(p_brand, 'Brand#', '') as int) as hs_class, min(p_type) as group_name
    from part where cast(replace(p_brand, 'Brand#', '') as int) in ({HS_LIST}) group by 1)"""


def _groups(t):
    hs_class = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return joins.measured(t.part.groupBy(hs_class.alias("hs_class")).agg(F.min("p_type").alias("group_name"))
                          .filter(F.col("hs_class").isin(HS_CLASSES)))


@query("join_left_dim", f"""
    select {KEY}, s.hs_class, group_name from {shipments_sql("part")} s left join {GROUPS_SQL} g on s.hs_class = g.hs_class""")
def join_left_dim(t):
    return joins.enrich(t.shipments("part"), _groups(t), {"hs_class": "hs_class"}) \
        .select(*SHIPMENT_KEY, "hs_class", "group_name")


NAME_MAP_SQL = """(select c_name as raw, concat(c_mktsegment, ' ', c_nationkey) as clean from customer where c_acctbal >= 0)"""


@query("join_inner_map", f"""
    select clean as foreign_company, count(*) as n, round(sum(metric_tons), 4) as metric_tons
    from {shipments_sql("customer")} join {NAME_MAP_SQL} m on foreign_company = raw group by clean""")
def join_inner_map(t):
    names = t.customer.filter("c_acctbal >= 0").select(
        F.col("c_name").alias("foreign_company"),
        F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("clean"))
    return (joins.standardise(t.shipments("customer"), names, "foreign_company", "clean")
            .groupBy(F.col("clean").alias("foreign_company"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons")))


@query("join_region_chain", f"""
    select country, region, count(*) as n, round(sum(metric_tons), 4) as metric_tons
    from {shipments_sql("supplier")} join {NATIONS_SQL} n on us_nation = nation_key group by country, region""")
def join_region_chain(t):
    chained = joins.enrich(t.shipments("supplier"), t.nations, {"us_nation": "nation_key"}, "inner")
    return chained.groupBy("country", "region").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


@query("join_role_playing", f"""
    select a.region as us_region, b.region as foreign_region, count(*) as n
    from {shipments_sql("supplier", "customer")} left join {NATIONS_SQL} a on us_nation = a.nation_key
    left join {NATIONS_SQL} b on foreign_nation = b.nation_key group by a.region, b.region""")
def join_role_playing(t):
    both = joins.enrich(t.shipments("supplier", "customer"), t.nations, {"us_nation": "nation_key"}, role="us_")
    both = joins.enrich(both, t.nations, {"foreign_nation": "nation_key"}, role="foreign_")
    return both.groupBy("us_region", "foreign_region").agg(F.count(F.lit(1)).alias("n"))


@query("join_qualifying", f"""
    select {KEY}, size from {shipments_sql()} join (
        select part_key as pk, case when sum(metric_tons) <= 800 then 'micro' when sum(metric_tons) <= 900 then 'small'
            when sum(metric_tons) <= 1000 then 'medium' when sum(metric_tons) <= 1100 then 'large' else 'huge' end as size
        from {shipments_sql()} group by part_key having sum(metric_tons) > 700) q on part_key = pk""")
def join_qualifying(t):
    s = t.shipments()
    entities = totals_over(s, "part_key", "metric_tons", 700).select(
        "part_key", bin_by_thresholds("total", [800, 900, 1000, 1100], SIZE_LABELS).alias("size"))
    return joins.keep_qualifying(s, joins.measured(entities), "part_key").select(*SHIPMENT_KEY, "size")


@query("semi_qualifying", f"""
    select {KEY}, metric_tons from {shipments_sql()} where part_key in (
        select part_key from {shipments_sql()} group by part_key having sum(metric_tons) > 700)""")
def semi_qualifying(t):
    s = t.shipments()
    entities = totals_over(s, "part_key", "metric_tons", 700)
    return joins.semi_qualifying(s, joins.measured(entities), {"part_key": "part_key"}).select(*SHIPMENT_KEY, "metric_tons")


RATE_SQL = """(select cast(date_trunc('month', o_orderdate) as date) as month, max(o_totalprice) as rate
    from orders group by 1)"""


@query("join_month", f"""
    select {KEY}, rate from {shipments_sql()} join {RATE_SQL} r
    on cast(date_trunc('month', ship_date) as date) = month""")
def join_month(t):
    rates = t.orders.groupBy(month_key(F.col("o_orderdate").cast("date")).alias("month")) \
        .agg(F.max("o_totalprice").alias("rate"))
    s = t.shipments().withColumn("year_month", month_key("ship_date"))
    return joins.enrich(s, joins.measured(rates), {"year_month": "month"}, "inner").select(*SHIPMENT_KEY, "rate")


TARIFF_SQL = f"""(select foreign_nation as country, hs_class as hs_family, year as tariff_year, max(tax) as average_tariff
    from {shipments_sql("part", "customer")} where status = 'F' group by all)"""


@query("join_three_keys", f"""
    select hs_class, year, count(*) as n, count(average_tariff) as n_with_tariff,
        round(sum(average_tariff * metric_tons), 3) as duty
    from {shipments_sql("part", "customer")} left join {TARIFF_SQL} x
    on foreign_nation = country and hs_class = hs_family and year = tariff_year group by hs_class, year""")
def join_three_keys(t):
    s = t.shipments("part", "customer")
    tariffs = s.filter("status = 'F'").groupBy(
        F.col("foreign_nation").alias("country"), F.col("hs_class").alias("hs_family"), F.col("year").alias("tariff_year")) \
        .agg(F.max("tax").alias("average_tariff"))
    on = {"foreign_nation": "country", "hs_class": "hs_family", "year": "tariff_year"}
    return joins.enrich(s, joins.measured(tariffs), on).groupBy("hs_class", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("average_tariff").alias("n_with_tariff"),
        F.round(F.sum(F.col("average_tariff") * F.col("metric_tons")), 3).alias("duty"))


@query("join_two_keys", f"""
    select foreign_nation, year, count(*) as n, count(price) as n_priced, round(sum(price), 2) as price
    from {shipments_sql("customer")} left join (
        select c_nationkey as country, cast(date_trunc('month', o_orderdate) as date) as month,
            max(o_totalprice) as price
        from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' group by 1, 2) c
    on foreign_nation = country and cast(date_trunc('month', ship_date) as date) = month group by foreign_nation, year""")
def join_two_keys(t):
    currency = (t.orders.filter("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(F.col("c_nationkey").alias("country"), month_key(F.col("o_orderdate").cast("date")).alias("month"))
                .agg(F.max("o_totalprice").alias("price")))
    s = t.shipments("customer").withColumn("year_month", month_key("ship_date"))
    priced = joins.enrich(s, joins.measured(currency), {"foreign_nation": "country", "year_month": "month"})
    return priced.groupBy("foreign_nation", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_priced"), F.round(F.sum("price"), 2).alias("price"))


@query("join_state_lookup", """
    select n_name as country, event_id, value from events join nation on user_id % 30 = n_nationkey""")
def join_state_lookup(t):
    # five of the thirty codes have no entry and are dropped
    side = t.events.select(F.pmod("user_id", F.lit(30)).cast("int").alias("code"), "event_id", "value")
    states = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("country"))
    found = joins.enrich(side, states, {"code": "code"})
    return found.filter(F.col("country").isNotNull()).select("country", "event_id", "value")


@query("join_right_preserve", f"""
    select nation_key, country, us_company from (
        select nullif(s_nationkey, 3) as nk, s_name as us_company from supplier where s_acctbal > 7500)
    right join {NATIONS_SQL} n on nk = nation_key""")
def join_right_preserve(t):
    fact = t.supplier.filter("s_acctbal > 7500").select(
        F.nullif("s_nationkey", F.lit(3)).alias("nation_key"), F.col("s_name").alias("us_company"))
    return joins.preserve_dim(fact, t.nations, {"nation_key": "nation_key"}).select("nation_key", "country", "us_company")


WEEK_SQL = "cast(date + cast((8 - isodow(date)) % 7 as integer) as date)"


@query("join_full_outer_week", f"""
    select coalesce(f.nation_key, w.nation_key) as nation_key, coalesce(f.week, w.week) as week, tons, cases_weekly
    from (select nation_key, {WEEK_SQL} as week, value as tons from {WEEKLY_SOURCE_SQL}
          where event_type = 'purchase' and value > 120) f
    full join (select nation_key, {WEEK_SQL} as week, round(sum(value), 4) as cases_weekly from {WEEKLY_SOURCE_SQL}
          where event_type = 'error' group by 1, 2) w on f.nation_key = w.nation_key and f.week = w.week""")
def join_full_outer_week(t):
    from quayside.functions.timekeys import week_ending_monday
    source = t.weekly_source()
    fact = source.filter("event_type = 'purchase' and value > 120").select(
        "nation_key", week_ending_monday("date").alias("week"), F.col("value").alias("tons"))
    side = weekly_sum(source.filter("event_type = 'error'"), ["nation_key"], "date", {"value": "cases_weekly"}) \
        .withColumn("cases_weekly", F.round("cases_weekly", 4))
    return joins.outer_period_join(fact, side, ["nation_key", "week"]).select(
        "nation_key", "week", "tons", "cases_weekly")


@query("join_first_period", f"""
    with yearly as (select foreign_nation as nation, hs_class, year, round(sum(case when status = 'F' then metric_tons else 0 end), 4) as tons
            from {shipments_sql("part", "customer")} group by all),
        first as (select nation, hs_class, coalesce(min(case when tons <> 0 then year end), min(year)) as first_year
            from yearly group by all)
    select y.nation, y.hs_class, y.year, y.tons, f.first_year, b.tons as first_tons,
        round(case when b.tons <> 0 then (y.tons - b.tons) / b.tons * 100 end, 4) as pct
    from yearly y join first f on y.nation = f.nation and y.hs_class = f.hs_class
    join yearly b on b.nation = f.nation and b.hs_class = f.hs_class and b.year = f.first_year""")
def join_first_period(t):
    tons = F.sum(F.when(F.col("status") == "F", F.col("metric_tons")).otherwise(0))
    yearly = joins.measured(t.shipments("part", "customer").groupBy(
        F.col("foreign_nation").alias("nation"), "hs_class", "year").agg(F.round(tons, 4).alias("tons")))
    entity = F.struct("nation", "hs_class")
    first = first_nonzero(yearly.withColumn("entity", entity), "entity", "year", "tons", "first_year") \
        .select("entity.*", "first_year")
    based = joins.enrich(yearly, first, {"nation": "nation", "hs_class": "hs_class"}, "inner")
    baseline = yearly.select("nation", "hs_class", "year", F.col("tons").alias("first_tons"))
    based = joins.enrich(based, baseline, {"nation": "nation", "hs_class": "hs_class", "first_year": "year"}, "inner")
    return based.withColumn("pct", F.round(pct_from_baseline("tons", "first_tons"), 4))


GROUP_ROWS_SQL = f"""(select case when region in ('EUROPE', 'ASIA') then region else country end as place, year,
    max(tax) as average_tariff from {shipments_sql("customer")} join {NATIONS_SQL} n on foreign_nation = nation_key
    group by 1, 2)"""


@query("expand_group_members", f"""
    select coalesce(country, place) as country, country is not null as is_member, year, average_tariff
    from {GROUP_ROWS_SQL} left join {NATIONS_SQL} m on place = region""")
def expand_group_members(t):
    with_country = joins.enrich(t.shipments("customer"), t.nations, {"foreign_nation": "nation_key"}, "inner")
    place = F.when(F.col("region").isin("EUROPE", "ASIA"), F.col("region")).otherwise(F.col("country"))
    tariffs = with_country.groupBy(place.alias("region"), "year").agg(F.max("tax").alias("average_tariff"))
    return joins.expand_group(tariffs, t.nations.select("region", "country"), "region", "country")


@query("anti_unmatched", f"""
    select {KEY}, hs_class from {shipments_sql("part")} where hs_class not in (select hs_class from {GROUPS_SQL})""")
def anti_unmatched(t):
    return joins.unmatched(t.shipments("part"), _groups(t), {"hs_class": "hs_class"}).select(*SHIPMENT_KEY, "hs_class")


@query("join_null_safe", """
    select o_orderkey as order_key, a.status, label from
        (select o_orderkey, nullif(o_orderstatus, 'P') as status from orders) a
    join (select nullif(o_orderstatus, 'P') as status, min(o_orderpriority) as label from orders group by 1) b
    on a.status is not distinct from b.status""")
def join_null_safe(t):
    rows = t.orders.select(F.col("o_orderkey").alias("order_key"), F.nullif("o_orderstatus", F.lit("P")).alias("status"),
                           "o_orderpriority")
    labels = rows.groupBy("status").agg(F.min("o_orderpriority").alias("label"))
    return joins.enrich(rows.drop("o_orderpriority"), joins.measured(labels), {"status": "status"}, "inner", null_safe=True)
