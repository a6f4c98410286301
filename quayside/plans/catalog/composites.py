"""Warehouse composites on shipments written the way raw files write them."""

from pyspark.sql import functions as F

from quayside.fixed_values import HS_CLASSES
from quayside.functions.timekeys import time_features, year_week
from quayside.operators.joins import measured
from quayside.plans import warehouse
from quayside.plans.catalog.aggregating import rounded
from quayside.plans.catalog.joining import GROUPS_SQL, WEEK_SQL, _groups
from quayside.plans.registry import query
from quayside.plans.views import NATIONS_SQL, shipments_sql
from quayside.session import settle

HS_LIST = ", ".join(map(str, HS_CLASSES))
SIDES = ("part", "supplier", "customer")

# raw file columns from the trade view, in SQL both engines read
RAW = {
    "date": "case when discount > 0.0 then concat(replace(cast(ship_date as string), '-', ''), '.0') end",
    "us_company": "case when tax > 0.0 then concat(us_company, ', INC, N', cast(us_nation as string)) end",
    "hs": "concat(lpad(cast(hs_class as string), 2, '0'), case when status = 'F' then '0110' else '0110 290000' end)",
    "hs_description": "concat(lpad(cast(hs_class as string), 2, '0'), '0110 - ', goods)",
    "foreign_country": "concat('NATION_', cast(foreign_nation as string))",
    "us_port": "case when teus < 49 then concat('PORT ', cast(us_nation as string), ', N', cast(us_nation as string)) end",
    "carrier": "carrier",
    "foreign_company": "case when tax < 0.08 then concat(foreign_company, ' (', chr(65 + foreign_nation), 'X)') end",
    "teus": "teus", "metric_tons": "metric_tons", "tcvusd": "value_usd",
}
IMPORT_ONLY = {"container_type_refrigerated": "cast(case when teus > 25 then 2 else 0 end as int)",
               "container_type_dry": "cast(case when teus > 25 then 0 else 1 end as int)",
               "vessel_country": "'X'", "in_bond_entry_type": "'Y'"}
EXPORT_ONLY = {"short_container_description": "case when teus > 1 then goods end",
               "containerized": "cast(case when status = 'F' then 1 else 0 end as int)", "vessel_country": "'X'"}


def raw_imports(t, first=None):
    return t.shipments(*SIDES, first=first).filter("trade_direction = 'Import'").selectExpr(
        *(f"{e} as {c}" for c, e in {**RAW, **IMPORT_ONLY}.items()))


def raw_exports(t, first=None):
    exprs = {c: e for c, e in {**RAW, **EXPORT_ONLY}.items() if c != "foreign_company"}
    return t.shipments(*SIDES, first=first).filter("trade_direction = 'Export'").selectExpr(*(f"{e} as {c}" for c, e in exprs.items()))


FACT_SQL = f"""(select distinct replace(date, '.0', '') as date, us_company, hs, hs_description, foreign_country, us_port,
        carrier, foreign_company, teus, metric_tons, tcvusd, trade_direction,
        cast(case when trade_direction = 'Import' then case when refrigerated >= 1 then 1 else refrigerated end
            when not boxed then 0 when cold then 1 else 0 end as int) as container_type_refrigerated,
        cast(case when trade_direction = 'Import' then case when dry >= 1 then 1 else dry end
            when not boxed then 0 when cold then 0 else 1 end as int) as container_type_dry
    from (select {", ".join(f"{e} as {c}" for c, e in RAW.items() if c != "foreign_company")}, trade_direction,
            case when trade_direction = 'Import' then {RAW["foreign_company"]} else 'Not Applicable to Exports' end as foreign_company,
            {IMPORT_ONLY["container_type_refrigerated"]} as refrigerated, {IMPORT_ONLY["container_type_dry"]} as dry,
            teus > 1 as described, status = 'F' as boxed,
            goods like '%REEF%' or goods like '%Cold%' or goods like '%Deg%' as cold from {shipments_sql(*SIDES)})
    where (trade_direction = 'Import' and date is not null)
        or (trade_direction = 'Export' and described and us_port is not null))"""


def fact(t):
    return warehouse.build_fact(raw_imports(t), raw_exports(t))


@query("build_fact", f"select * from {FACT_SQL}")
def build_fact(t):
    return fact(t)


CLASSED_SQL = f"""(select f.* exclude (hs, hs_description), g.hs_class, group_name, cast(length(hs) > 7 as int) as hs_mixed
    from (select *, try_cast(substr(hs_description, 1, 2) as int) as class from {FACT_SQL}) f
    left join (select c as hs_class, group_name from (select unnest([{HS_LIST}]) as c) left join {GROUPS_SQL} on c = hs_class) g
    on class = g.hs_class where class in ({HS_LIST}))"""


@query("classify_products", f"""
    select trade_direction, hs_class, group_name, hs_mixed, count(*) as n, round(sum(metric_tons), 4) as metric_tons
    from {CLASSED_SQL} group by all""")
def classify_products(t):
    classed = warehouse.classify_products(fact(t), _groups(t))
    return classed.groupBy("trade_direction", "hs_class", "group_name", "hs_mixed").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


@query("parse_parties", f"""
    select coalesce(us_company, 'Not Provided') as us_company,
        coalesce(case list_extract(string_split(us_company, ','), -1) when 'ND' then 'NOT DECLARED' when 'ED' then 'NOT DECLARED'
            else list_extract(string_split(us_company, ','), -1) end, 'Not Provided') as us_company_state,
        case when contains(us_company, ',') then array_to_string(list_slice(string_split(us_company, ','), 1, -2), ',') end as us_company_agg,
        coalesce(foreign_company, 'Not Provided') as foreign_company,
        coalesce(right(regexp_replace(foreign_company, '[()\\d]+', '', 'g'), 2), 'Not Provided') as foreign_company_country,
        count(*) as n
    from {FACT_SQL} group by all""")
def parse_parties(t):
    return warehouse.parse_parties(fact(t)).groupBy(
        "us_company", "us_company_state", "us_company_agg", "foreign_company", "foreign_company_country") \
        .agg(F.count(F.lit(1)).alias("n"))


def _size_sql(total: str) -> str:
    return (f"case when {total} <= 1000 then 'micro' when {total} <= 2000 then 'small' when {total} <= 10000 then 'medium' "
            f"when {total} <= 20000 then 'large' else 'huge' end")


SIZE_EDGES = [1000, 2000, 10000, 20000]


@query("entity_sizing", f"""
    with s as {shipments_sql("supplier", "customer")},
        u as (select us_company, {_size_sql("sum(metric_tons)")} as us_company_size from s group by 1 having sum(metric_tons) > 15000),
        a as (select s.*, us_company_size from s join u using (us_company)),
        f as (select foreign_company, {_size_sql("sum(metric_tons)")} as foreign_company_size from a group by 1 having sum(metric_tons) > 500)
    select us_company, us_company_size, foreign_company, foreign_company_size, count(*) as n,
        round(sum(metric_tons), 4) as metric_tons from a join f using (foreign_company) group by all""")
def entity_sizing(t):
    sized = warehouse.size_entities(t.shipments("supplier", "customer"), {
        "us_company": "us_company_size", "foreign_company": "foreign_company_size"}, least=[15000, 500], edges=SIZE_EDGES)
    return sized.groupBy("us_company", "us_company_size", "foreign_company", "foreign_company_size").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_tons"), 4).alias("metric_tons"))


def _exact(c: str) -> str:
    """Sum of amounts in cents, the same in any order of rows."""
    return f"cast(sum(cast({c} as decimal(18, 2))) as double) as {c}"


# groups of countries, as the tables of tariffs and prices name them
MEMBER_SQL = "case when foreign_nation < 5 then -1 else foreign_nation end"


@query("economic_enrichment", f"""
    with s as (select *, strftime(ship_date, '%Y-%m') as ym, {MEMBER_SQL} as place from {shipments_sql("part", "customer")}),
        rates as (select strftime(o_orderdate, '%Y-%m') as ym, max(o_totalprice) as us_unemployment_rate from orders group by 1),
        tariffs as (select place, hs_class, year as reported, max(value_usd) as average_tariff,
            case when max(status) = 'F' then 'true' else 'false' end as free_trade_agreement_with_us,
            case when place < 10 then 'true' else 'false' end as european_union
            from s where discount >= 0.1 and tax >= 0.05 group by all),
        prices as (select place, ym, max(segment) as currency, case when max(discount) >= 0.1 then max(tax) end as price
            from s where status = 'F' group by all)
    select s.year, free_trade_agreement_with_us, european_union, currency, count(*) as n,
        {_exact("us_unemployment_rate")}, {_exact("average_tariff")}, {_exact("price")}
    from s join rates using (ym)
    asof left join tariffs x on s.place = x.place and s.hs_class = x.hs_class and s.year >= x.reported
    left join prices p on s.place = p.place and s.ym = p.ym group by all""")
def economic_enrichment(t):
    s = settle(time_features(t.shipments("part", "customer"), "ship_date").select(
        "foreign_nation", "hs_class", "year", "year_month", "value_usd", "status", "discount", "tax", "segment"), "rows")
    year_month = F.date_format("year_month", "yyyy-MM")
    unemployment = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("year_month")) \
        .agg(F.max("o_totalprice").alias("unemployment_rate"))
    # five nations report as one group
    place = F.when(F.col("foreign_nation") < 5, -1).otherwise(F.col("foreign_nation")).alias("country")
    members = t.nation.filter("n_nationkey < 5").select(F.lit(-1).alias("country"), F.col("n_nationkey").cast("int").alias("member"))
    tariffs = s.filter("discount >= 0.1 and tax >= 0.05").groupBy(
        place, F.col("hs_class").alias("hs_family"), F.col("year").alias("tariff_year")).agg(
        F.format_number(F.max("value_usd"), 2).alias("average_tariff"),
        F.when(F.max("status") == "F", "Yes").otherwise("No").alias("free_trade_agreement_with_us")) \
        .withColumn("european_union", F.when(F.col("country") < 10, "Yes").otherwise("No"))
    currencies = s.filter("status = 'F'").groupBy(place, year_month.alias("month_year")) \
        .agg(F.max("segment").alias("currency"), F.when(F.max("discount") >= 0.1, F.max("tax")).alias("price"))
    out = warehouse.enrich_economic(s.select("foreign_nation", "hs_class", "year", "year_month"), unemployment, tariffs, currencies,
                                    "foreign_nation", members)
    return out.groupBy("year", "free_trade_agreement_with_us", "european_union", "currency").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c)
                                        for c in ("us_unemployment_rate", "average_tariff", "price")))


CASES_SQL = f"""(select event_id, date, country as state, cast(floor(value) as bigint) as cases,
    cast(floor(value / 50) as bigint) as deaths, event_type from
    (select events.*, cast(ts as date) as date from events) join {NATIONS_SQL} on user_id % 25 = nation_key)"""


def cases(t):
    return t.events.join(t.nations, F.pmod("user_id", F.lit(25)) == F.col("nation_key")).select(
        "event_id", F.to_date("ts").alias("date"), F.col("country").alias("state"),
        F.floor("value").alias("cases"), F.floor(F.col("value") / 50).alias("deaths"), "event_type")


SHOCK_SQL = f"""
    states as (select n_name as state, concat('N', cast(n_nationkey as varchar)) as state_code from nation where n_nationkey <> 7),
    weekly as (select state_code, week as date_weekly, strftime(week, '%Y-w%U') as year_week, cases_weekly, deaths_weekly
        from (select state, {WEEK_SQL.replace("date +", "date - 7 +")} as week, cast(sum(cases) as bigint) as cases_weekly,
            cast(sum(deaths) as bigint) as deaths_weekly from {CASES_SQL} where event_type = 'error' group by all)
        join states using (state)),
    trade as (select concat('N', cast(user_id % 25 as varchar)) as us_port_state, strftime(ts, '%Y-w%U') as year_week,
        event_id, value as metric_tons, cast(user_id % 2 as int) as hs_mixed
        from events where event_type = 'purchase' and value > 100)"""


def shock_inputs(t):
    states = t.nation.filter("n_nationkey <> 7").select(
        F.col("n_name").alias("state"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state_code"))
    weekly = warehouse.weekly_cases(cases(t).filter("event_type = 'error'"), states, last_year=None)
    trade = t.events.filter("event_type = 'purchase' and value > 100").select(
        F.concat(F.lit("N"), F.pmod("user_id", F.lit(25)).cast("string")).alias("us_port_state"),
        year_week(F.to_date("ts")).alias("year_week"), "event_id", F.col("value").alias("metric_tons"),
        F.pmod("user_id", F.lit(2)).cast("int").alias("hs_mixed"))
    return trade, weekly


SHOCKED_SQL = """(select coalesce(us_port_state, state_code) as us_port_state,
        coalesce(trade.year_week, weekly.year_week) as year_week, event_id,
        case when hs_mixed is null then 0 else metric_tons end as metric_tons, hs_mixed, date_weekly,
        coalesce(cases_weekly, 0) as cases_weekly, coalesce(deaths_weekly, 0) as deaths_weekly
    from trade full join weekly on us_port_state = state_code and trade.year_week = weekly.year_week)"""


@query("weekly_shock_features", f"with {SHOCK_SQL} select * from {SHOCKED_SQL}")
def weekly_shock_features(t):
    return warehouse.weekly_shocks(*shock_inputs(t))


@query("baseline_change", f"""
    with {SHOCK_SQL}, shocked as {SHOCKED_SQL},
        per as (select us_port_state, date_weekly, min(deaths_weekly) as v from shocked where date_weekly is not null group by all),
        base as (select us_port_state, min_by(date_weekly, (v = 0, date_weekly)) as t0, min_by(v, (v = 0, date_weekly)) as v0
            from per group by 1)
    select s.us_port_state, year_week, event_id, date_weekly, deaths_weekly,
        case when date_weekly is null then 'Not Applicable' else cast(t0 as varchar) end as time0_state_death,
        case when date_weekly is null then 0 else v0 end as deaths_state_firstweek,
        round(case when date_weekly is null then 0 when v0 <> 0 then (deaths_weekly - v0) / v0 * 100 end, 6) as deaths_pctdelta
    from shocked s left join base b on s.us_port_state = b.us_port_state and year(date_weekly) = year(t0)""")
def baseline_change(t):
    shocked = warehouse.weekly_shocks(*shock_inputs(t)).drop("metric_tons", "hs_mixed", "cases_weekly")
    out = warehouse.baseline_change(shocked, "us_port_state", "date_weekly", "deaths_weekly", "time0_state_death",
                                    "deaths_state_firstweek", "deaths_pctdelta")
    return rounded(out, 6, "deaths_pctdelta")


@query("closure_lead", f"""
    select carrier, case when ship_date is null then null else cast(ship_date - order_date as integer) end as state_closure_ea_diff,
        count(*) as n
    from (select carrier, order_date, case when tax > 0.0 then ship_date end as ship_date from {shipments_sql("order")}) group by all""")
def closure_lead(t):
    us_style = lambda c: F.date_format(c, "M/d/yyyy")
    written = t.shipments("order").select(
        "carrier", us_style("order_date").alias("date_announced"),
        F.when(F.col("tax") > 0.0, us_style("ship_date")).otherwise("NA").alias("effective_date"))
    return warehouse.closure_lead(written).groupBy("carrier", "state_closure_ea_diff").agg(F.count(F.lit(1)).alias("n"))


def extreme_values(shipments):
    """What tariffs and prices are made of, in one pass over the shipments: per nation, class, year and status
    the highest taxed value, and, where ``priced``, per nation, month and segment the highest tax.

    Statuses and segments are keys here and not maxima: a highest text would sort the rows of every task."""
    taxed, sold = (F.coalesce(F.expr(e), F.lit(False)) for e in ("discount >= 0.1 and tax >= 0.05", "status = 'F'"))
    rows = shipments.filter(taxed | sold).select("foreign_nation", "hs_class", "year", "status", F.trunc("ship_date", "month").alias("month"), "segment",
                                                 "value_usd", "tax", taxed.alias("taxed"), sold.alias("sold"))
    keys = [["foreign_nation", "hs_class", "year", "status"], ["foreign_nation", "month", "segment"]]
    return rows.groupingSets(keys, *dict.fromkeys(keys[0] + keys[1])).agg(
        (F.grouping("month") == 0).alias("priced"), F.max("taxed").alias("taxed"), F.max("sold").alias("sold"),
        F.max(F.when(F.col("taxed"), F.col("value_usd"))).alias("value_usd"), F.max(F.when(F.col("sold"), F.col("tax"))).alias("tax"))


def side_tables(t, values=None) -> warehouse.SideTables:
    """Side tables of the build from the test tables; some lack names, as the real ones do.
    ``values`` are the :func:`extreme_values` of the shipments, if they are known."""
    text = lambda c: F.col(c).cast("string")
    n, region = t.nation, t.nations
    month = lambda c: F.date_format(c, "yyyy-MM")
    key = text("n_nationkey")
    values = extreme_values(t.shipments("part", "customer")) if values is None else values
    s = values.join(n.select(F.col("n_nationkey").alias("foreign_nation"), "n_name"), "foreign_nation")
    # not from local rows, whose size the planner does not know: a name map with some would never be broadcast
    fillers = lambda raw, clean, **names: t.spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(a).alias(raw), F.lit(b).alias(clean)) for a, b in names.items()))))
    tariffs = s.filter("taxed and not priced").groupBy(F.col("n_name").alias("country"), F.col("hs_class").alias("hs_family"), F.col("year").alias("tariff_year")) \
        .agg(F.format_number(F.max("value_usd"), 2).alias("average_tariff"), F.when(F.max("status") == "F", "Yes").otherwise("No").alias("free_trade_agreement_with_us")) \
        .withColumn("european_union", F.when(F.col("country") < "NATION_2", "Yes").otherwise("No"))
    return warehouse.SideTables(
        hs_groups=_groups(t),
        us_companies=t.supplier.filter("s_suppkey % 10 <> 0").select(
            F.concat("s_name", F.lit(", INC, N"), text("s_nationkey")).alias("us_company"), F.col("s_name").alias("us_company_clustered"))
        .unionAll(fillers("us_company", "us_company_clustered", **{"Not Provided": "NOT AVAILABLE"})),
        foreign_companies=t.customer.filter("c_custkey % 10 <> 0").select(
            F.concat("c_name", F.lit(" ("), F.char(F.col("c_nationkey") + 65), F.lit("X)")).alias("foreign_company"), F.col("c_name").alias("foreign_company_clustered"))
        .unionAll(fillers("foreign_company", "foreign_company_clustered", **{"Not Provided": "NOT AVAILABLE", "Not Applicable to Exports": "Not Applicable to Exports"})),
        carriers=t.orders.select(F.col("o_orderpriority").alias("carrier")).distinct().filter("carrier not like '5%'")
        .select("carrier", F.col("carrier").alias("carrier_clustered"), F.when(F.col("carrier") < "3", "huge").otherwise("small").alias("carrier_size")),
        us_ports=region.select(F.concat(F.lit("PORT "), text("nation_key"), F.lit(", N"), text("nation_key")).alias("us_port"),
                               F.concat(F.lit("PORT "), text("nation_key"), F.lit(",N"), text("nation_key")).alias("us_port_clustered"),
                               F.col("region").alias("us_port_coastal_region")),
        company_countries=region.filter("nation_key < 20").select(F.concat(F.char(F.col("nation_key") + 65), F.lit("X")).alias("foreign_company_country"),
                                                                  F.col("country").alias("name"), F.col("region").alias("continent")),
        countries=region.filter("nation_key <> 3").select(F.concat(F.lit("NATION_"), text("nation_key")).alias("foreign_country"),
                                                          F.col("country").alias("name"), F.col("region").alias("continent")),
        regions=region.filter("nation_key <> 4").select(F.col("country").alias("name"), "region"),
        unemployment=t.orders.groupBy(month("o_orderdate").alias("year_month")).agg(F.max("o_totalprice").alias("unemployment_rate")),
        tariffs=tariffs,
        currencies=s.filter("sold and priced").groupBy(F.col("n_name").alias("country"), month("month").alias("month_year"))
        .agg(F.max("segment").alias("currency"), F.max("tax").alias("price")),
        states=region.select(F.col("country").alias("state"), F.concat(F.lit("N"), text("nation_key")).alias("state_code"), F.col("region").alias("state_region")),
        closures=n.filter("n_nationkey <> 7").select(F.col("n_name").alias("state"), F.concat(F.lit("3/"), F.col("n_nationkey") + 1, F.lit("/2020")).alias("date_announced"),
                                                     F.when(F.col("n_nationkey") % 5 == 0, "NA").otherwise(F.concat(F.lit("4/"), F.col("n_nationkey") + 1, F.lit("/2020"))).alias("effective_date")),
        cases=cases(t).filter("event_type = 'error'").select("date", "state", "cases", "deaths"))


BUILT = ["trade_direction", "carrier_size", "us_company_size", "foreign_company_size", "foreign_country_region",
         "foreign_company_country_region", "us_port_coastal_region", "state", "state_region", "year", "european_union",
         "time0_state_case", "state_closure_ea_diff"]


SIDES_SQL = f"""
    places as (select *, 'N' || nation_key as code from {NATIONS_SQL}),
    us_names as (select s_name || ', INC, N' || s_nationkey as raw, s_name as us from supplier where s_suppkey % 10 <> 0
        union all select 'Not Provided', 'NOT AVAILABLE'),
    foreign_names as (select c_name || ' (' || chr(65 + cast(c_nationkey as int)) || 'X)' as raw, c_name as abroad from customer where c_custkey % 10 <> 0
        union all select 'Not Provided', 'NOT AVAILABLE' union all select 'Not Applicable to Exports', 'Not Applicable to Exports'),
    parties as (select *, coalesce(us_company, 'Not Provided') as us_raw, coalesce(foreign_company, 'Not Provided') as foreign_raw,
        coalesce(right(regexp_replace(foreign_company, '[()\\d]+', '', 'g'), 2), 'Not Provided') as company_code from {CLASSED_SQL})"""


def _z_sql(source: str, column: str) -> str:
    return f"(select * from {source} where abs({column} - (select avg({column}) from {source})) < 3.5 * (select stddev_samp({column}) from {source}))"


def _class_sql(entity: str) -> str:
    return (f"case when {entity} = 'NOT AVAILABLE' then 'unknown' when sum(metric_tons) <= 1000 then 'micro' when sum(metric_tons) <= 10000 then 'small' "
            f"when sum(metric_tons) <= 100000 then 'medium' when sum(metric_tons) <= 1000000 then 'large' else 'huge' end")


def _first_sql(value: str) -> str:
    return f"select state_code, min_by(date_weekly, ({value} = 0, date_weekly)) as t0, min_by({value}, ({value} = 0, date_weekly)) as v0 from weekly group by 1"


BUILT_SQL = f"""
    with {SIDES_SQL},
    named as (select distinct date, foreign_country, us_port, teus, metric_tons, tcvusd, container_type_refrigerated, container_type_dry,
            trade_direction, hs_class, hs_mixed, group_name, company_code, us, abroad, case when carrier < '3' then 'huge' else 'small' end as carrier_size,
            p.region as us_port_coastal_region, p.code as port_code, h.country as home, h.region as foreign_country_region,
            c.region as foreign_company_country_region
        from parties join us_names u on us_raw = u.raw join foreign_names f on foreign_raw = f.raw
        join places p on us_port = 'PORT ' || p.nation_key || ', N' || p.nation_key
        join places h on foreign_country = 'NATION_' || h.nation_key and h.nation_key not in (3, 4)
        left join places c on company_code = chr(65 + cast(c.nation_key as int)) || 'X' and c.nation_key < 20 and c.nation_key <> 4
        where carrier not like '5%'),
    us_sizes as (select us, {_class_sql("us")} as us_company_size from named group by us having sum(metric_tons) > 500),
    sized as (select * from named join us_sizes using (us)),
    foreign_sizes as (select abroad, {_class_sql("abroad")} as foreign_company_size from sized group by abroad having sum(metric_tons) > 500),
    both_sized as (select * from sized join foreign_sizes using (abroad)),
    z1 as {_z_sql("both_sized", "metric_tons")}, z2 as (select * from z1 where metric_tons < 250),
    z3 as {_z_sql("z2", "teus")}, z4 as {_z_sql("z3", "tcvusd")},
    dated as (select *, cast(strptime(date, '%Y%m%d') as date) as ship_date from z4),
    timed as (select *, cast(year(ship_date) as int) as year, strftime(ship_date, '%Y-%m') as ym, strftime(ship_date, '%Y-w%U') as year_week from dated),
    s as (select s.*, n_name, strftime(ship_date, '%Y-%m') as ym from {shipments_sql("part", "customer")} s join nation on foreign_nation = n_nationkey),
    rates as (select strftime(o_orderdate, '%Y-%m') as ym, max(o_totalprice) as us_unemployment_rate from orders group by 1),
    tariffs as (select n_name as home, hs_class, year as reported, max(value_usd) as average_tariff, case when max(status) = 'F' then 'true' else 'false' end as fta,
        case when n_name < 'NATION_2' then 'true' else 'false' end as european_union from s where discount >= 0.1 and tax >= 0.05 group by all),
    prices as (select n_name as home, ym, max(segment) as currency, max(tax) as price from s where status = 'F' group by all),
    economic as (select t.*, us_unemployment_rate, average_tariff, fta, european_union, currency, price from timed t join rates using (ym)
        asof left join tariffs x on t.home = x.home and t.hs_class = x.hs_class and t.year >= x.reported left join prices p on t.home = p.home and t.ym = p.ym),
    closures as (select n_name as state, 'N' || n_nationkey as code, n_regionkey, case when n_nationkey % 5 = 0 then null else 31 end as lead
        from nation where n_nationkey <> 7),
    placed as (select e.*, c.state, p.region as state_region, c.lead from economic e join closures c on port_code = c.code join places p on port_code = p.code),
    weekly as (select code as state_code, {WEEK_SQL.replace("date +", "date - 7 +")} as date_weekly, cast(sum(cases) as bigint) as cases_weekly,
        cast(sum(deaths) as bigint) as deaths_weekly from {CASES_SQL} join places on state = country where event_type = 'error' group by all),
    first_cases as ({_first_sql("cases_weekly")}), first_deaths as ({_first_sql("deaths_weekly")}),
    based as (select w.*, strftime(date_weekly, '%Y-w%U') as week, cast(c.t0 as varchar) as time0_state_case, c.v0 as case0,
            cast(d.t0 as varchar) as time0_state_death, d.v0 as death0
        from weekly w left join first_cases c on w.state_code = c.state_code and year(date_weekly) = year(c.t0)
        left join first_deaths d on w.state_code = d.state_code and year(date_weekly) = year(d.t0)),
    joined as (select foreign_country, us_port, teus, metric_tons, tcvusd, container_type_refrigerated, container_type_dry, trade_direction, hs_mixed,
            group_name, company_code, carrier_size, us_port_coastal_region, foreign_country_region, foreign_company_country_region, us_company_size,
            foreign_company_size, ship_date, year, year_week, us_unemployment_rate, average_tariff, fta, european_union, currency, price, state,
            state_region, lead, b.* exclude (state_code, week)
        from placed left join based b on port_code = b.state_code and year_week = b.week
        union all by name
        select 0.0::double as teus, 0.0::double as metric_tons, 0.0::double as tcvusd, 0.0::double as us_unemployment_rate, 0.0::double as average_tariff,
            0.0::double as price, cast(year(date_weekly) as int) as year, week as year_week, * exclude (state_code, week)
        from based b where not exists (select 1 from placed where port_code = b.state_code and year_week = b.week)
        union all by name
        select 0.0::double as teus, 0.0::double as metric_tons, 0.0::double as tcvusd, 0.0::double as us_unemployment_rate, 0.0::double as average_tariff,
            0.0::double as price, state, lead from closures where state not in (select state from placed)),
    built as (select distinct * replace (coalesce(cases_weekly, 0) as cases_weekly, coalesce(deaths_weekly, 0) as deaths_weekly,
        case when date_weekly is null then 'Not Applicable' else time0_state_case end as time0_state_case) from joined)
    select trade_direction, carrier_size, us_company_size, foreign_company_size, foreign_country_region, foreign_company_country_region,
        us_port_coastal_region, state, state_region, year, european_union, time0_state_case, cast(lead as int) as state_closure_ea_diff, count(*) as n,
        {", ".join(_exact(c) for c in ("metric_tons", "tcvusd", "us_unemployment_rate", "average_tariff", "price", "cases_weekly", "deaths_weekly"))}
    from built group by all"""


@query("warehouse_build", BUILT_SQL)
def warehouse_build(t):
    # only some classes stay, so the parts, which have them, thin the rows out before these are shuffled for the orders
    side = side_tables(t, measured(extreme_values(t.shipments("part", "customer"))))
    built = warehouse.build_warehouse(raw_imports(t, "part"), raw_exports(t, "part"), side, min_total=500, last_count_year=None)
    cents = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c)
    return built.groupBy(*BUILT).agg(F.count(F.lit(1)).alias("n"), *(cents(c) for c in (
        "metric_tons", "tcvusd", "us_unemployment_rate", "average_tariff", "price", "cases_weekly", "deaths_weekly")))


@query("warehouse_losses", f"""
    with {SIDES_SQL},
    known as (select 'us_company' as step, raw from us_names union all select 'foreign_company', raw from foreign_names
        union all select distinct 'carrier', o_orderpriority from orders where o_orderpriority not like '5%'
        union all select 'us_port', 'PORT ' || nation_key || ', N' || nation_key from places
        union all select 'foreign_country', 'NATION_' || nation_key from places where nation_key <> 3),
    seen as (select 'us_company' as step, us_raw as name from parties union all select 'foreign_company', foreign_raw from parties
        union all select 'carrier', carrier from parties union all select 'us_port', us_port from parties
        union all select 'foreign_country', foreign_country from parties)
    select s.step, name, count(*) as n from seen s left join known k on s.step = k.step and s.name = k.raw where k.raw is null group by all
    union all select 'region', country, count(*) from parties join places on foreign_country = 'NATION_' || nation_key where nation_key = 4 group by all""")
def warehouse_losses(t):
    side = side_tables(t)
    return warehouse.lost_names(warehouse.parse_parties(warehouse.classify_products(fact(t), side.hs_groups)), side)
