"""Joins on the nearest time and on intervals."""

from pyspark.sql import functions as F

from quayside.operators import asof, intervals
from quayside.operators.joins import measured
from quayside.plans.registry import query
from quayside.plans.views import shipments_sql
from quayside.session import settle

# tariffs that few countries report, in few years: the highest tax of their rarely discounted goods
REPORTED = "discount >= 0.1 and tax >= 0.08"


@query("asof_tariff", f"""
    with s as {shipments_sql("part", "customer")},
        reports as (select foreign_nation, hs_class, year as reported, max(value_usd) as tariff from s where {REPORTED} group by all)
    select s.foreign_nation, s.hs_class, s.year, reported, tariff, count(*) as n
    from s asof left join reports r on s.foreign_nation = r.foreign_nation and s.hs_class = r.hs_class and s.year >= r.reported
    group by all""")
def asof_tariff(t):
    s = settle(t.shipments("part", "customer").select("foreign_nation", "hs_class", "year", "value_usd", "discount", "tax"), "rows")
    reports = s.filter(REPORTED).groupBy(F.col("foreign_nation").alias("country"), F.col("hs_class").alias("family"), F.col("year").alias("reported")) \
        .agg(F.max("value_usd").alias("tariff"))
    found = asof.asof_join(s.drop("value_usd"), reports, {"foreign_nation": "country", "hs_class": "family"}, "year", "reported")
    return found.groupBy("foreign_nation", "hs_class", "year", "reported", "tariff").agg(F.count(F.lit(1)).alias("n"))


@query("asof_last_view", """
    with views as (select user_id, ts as viewed, max(event_id) as view_id from events where event_type = 'view' group by all)
    select event_id, e.user_id, e.ts, case when epoch_us(e.ts) - epoch_us(viewed) <= 86400000000 then view_id end as view_id
    from events e asof left join views v on e.user_id = v.user_id and e.ts > v.viewed where event_type = 'purchase'""")
def asof_last_view(t):
    views = t.events.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("viewed")).agg(F.max("event_id").alias("view_id"))
    # stored without a zone; both sides are read as UTC
    utc = lambda c: F.col(c).cast("timestamp")
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", utc("ts").alias("ts"))
    found = asof.asof_join(bought, views.withColumn("viewed", utc("viewed")), {"user_id": "user_id"}, "ts", "viewed", exact=False, tolerance=86_400_000_000)
    return found.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "view_id")


@query("asof_nearest_price", """
    with placed as (select o_orderkey as order_key, c_nationkey as nation, cast(o_orderdate as date) as order_date, o_orderstatus, o_totalprice
            from orders join customer on o_custkey = c_custkey),
        prices as (select nation, order_date as priced, max(o_totalprice) as price from placed where o_orderstatus = 'P' and o_totalprice > 400000 group by all)
    select order_key, p.nation, order_date, priced, price from placed p left join prices x
        on p.nation = x.nation and abs(order_date - priced) <= 30
    qualify row_number() over (partition by order_key order by abs(order_date - priced), priced) = 1""")
def asof_nearest_price(t):
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_key"), F.col("c_nationkey").alias("nation"), F.col("o_orderdate").cast("date").alias("order_date"),
        "o_orderstatus", "o_totalprice")
    prices = placed.filter("o_orderstatus = 'P' and o_totalprice > 400000").groupBy("nation", F.col("order_date").alias("priced")) \
        .agg(F.max("o_totalprice").alias("price"))
    found = asof.asof_join(placed, prices, {"nation": "nation"}, "order_date", "priced", "nearest", tolerance=30)
    return found.select("order_key", "nation", "order_date", "priced", "price")


# a country closes on the day of an order of this size, for longer the larger it is
CLOSURES_SQL = """(select c_nationkey as nation, o_orderkey as closure, cast(o_orderdate as date) as closed,
    cast(o_orderdate as date) + cast(floor(o_totalprice / 1000) - 470 as int) as reopened
    from orders join customer on o_custkey = c_custkey where o_totalprice > 480000)"""


def _closures(t):
    big = t.orders.filter("o_totalprice > 480000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    closed = F.col("o_orderdate").cast("date")
    return big.select(F.col("c_nationkey").alias("nation"), F.col("o_orderkey").alias("closure"), closed.alias("closed"),
                      F.date_add(closed, (F.floor(F.col("o_totalprice") / 1000) - 470).cast("int")).alias("reopened"))


@query("shipments_in_closures", f"""
    select nation, closure, closed, reopened, count(*) as n, round(sum(metric_tons), 4) as metric_tons
    from {shipments_sql("customer")} join {CLOSURES_SQL} c on foreign_nation = nation and ship_date between closed and reopened group by all""")
def shipments_in_closures(t):
    # a row per country and day, so that the pairs grow with the closures and not with closures times shipments
    days = measured(t.shipments("customer").groupBy("foreign_nation", "ship_date").agg(F.count(F.lit(1)).alias("n"), F.sum("metric_tons").alias("metric_tons")))
    inside = intervals.point_in_interval(days, _closures(t), "ship_date", "closed", "reopened", {"foreign_nation": "nation"})
    return inside.groupBy(F.col("foreign_nation").alias("nation"), "closure", "closed", "reopened") \
        .agg(F.sum("n").alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


@query("shipments_by_open_closures", f"""
    with s as {shipments_sql("customer")}
    select trade_direction, year, closure is not null as closed, count(*) as n, count(distinct closure) as n_closures
    from s left join {CLOSURES_SQL} c on foreign_nation = nation and ship_date >= closed and ship_date < reopened group by all""")
def shipments_by_open_closures(t):
    # a row per direction, country and day; the year follows from the day
    days = measured(t.shipments("customer").groupBy("trade_direction", "year", "foreign_nation", "ship_date").agg(F.count(F.lit(1)).alias("rows")))
    found = intervals.point_in_interval(days, _closures(t), "ship_date", "closed", "reopened", {"foreign_nation": "nation"}, "left", closed=False)
    return found.groupBy("trade_direction", "year", F.col("closure").isNotNull().alias("closed")) \
        .agg(F.sum("rows").alias("n"), F.count_distinct("closure").alias("n_closures"))


@query("closure_overlaps", f"""
    with spans as (select nation, order_key, min(order_date) as ordered, max(ship_date) as shipped
            from (select *, foreign_nation as nation from {shipments_sql("customer")}) group by all having ordered <= shipped)
    select closure, c.nation, count(*) as n, min(ordered) as first_ordered, max(shipped) as last_shipped
    from spans s join {CLOSURES_SQL} c on s.nation = c.nation and ordered <= reopened and closed <= shipped group by all""")
def closure_overlaps(t):
    spans = t.shipments("customer").groupBy(F.col("foreign_nation").alias("buyer"), "order_key") \
        .agg(F.min("order_date").alias("ordered"), F.max("ship_date").alias("shipped")).withColumn("one", F.lit(1).cast("long"))
    totals = {"n": ("sum", "one"), "first_ordered": ("min", "ordered"), "last_shipped": ("max", "shipped")}
    found = intervals.overlap_join(spans, _closures(t), ("ordered", "shipped"), ("closed", "reopened"), {"buyer": "nation"}, totals)
    # a row per closure, unless its key repeats
    return found.groupBy("closure", F.col("buyer").alias("nation")).agg(
        F.sum("n").alias("n"), F.min("first_ordered").alias("first_ordered"), F.max("last_shipped").alias("last_shipped"))
