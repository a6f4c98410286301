"""Aggregations."""

from pyspark.sql import functions as F

from quayside.fixed_values import HS_CLASSES
from quayside.operators import aggregates, quantiles
from quayside.operators.columns import filter_in
from quayside.operators.trials import trials_to_columns
from quayside.plans.catalog.joining import WEEK_SQL
from quayside.plans.registry import query
from quayside.plans.views import TRIALS_SQL, WEEKLY_SOURCE_SQL, shipments_sql


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("entity_totals_having", f"""
    select foreign_company, round(sum(metric_tons), 4) as total from {shipments_sql("customer")}
    group by foreign_company having sum(metric_tons) > 1000""")
def entity_totals_having(t):
    return rounded(aggregates.totals_over(t.shipments("customer"), "foreign_company", "metric_tons", 1000), 4, "total")


@query("weekly_sum_monday", f"""
    select 0 as shift, nation_key, {WEEK_SQL} as week, round(sum(value), 4) as cases from {WEEKLY_SOURCE_SQL} group by all
    union all select 7, nation_key, {WEEK_SQL.replace("date +", "date - 7 +")}, round(sum(value), 4)
    from {WEEKLY_SOURCE_SQL} group by all
    union all select -1, nation_key, week, round(sum(value), 4) from
        (select nation_key, event_type, {WEEK_SQL} as week, max(value) as value from {WEEKLY_SOURCE_SQL} group by all)
    group by all""")
def weekly_sum_monday(t):
    source = t.weekly_source()
    plain = aggregates.weekly_sum(source, ["nation_key"], "date", {"value": "cases"}).withColumn("shift", F.lit(0))
    shifted = aggregates.weekly_sum(source, ["nation_key"], "date", {"value": "cases"}, shift_back=7) \
        .withColumn("shift", F.lit(7))
    running = aggregates.weekly_sum(source, ["nation_key"], "date", {"value": "cases"}, cumulative_by=["event_type"]) \
        .withColumn("shift", F.lit(-1))
    return rounded(plain.unionByName(shifted).unionByName(running), 4, "cases")


@query("monthly_sum", f"""
    select us_nation, cast(date_trunc('month', ship_date) as date) as month, round(sum(metric_tons), 4) as metric_tons
    from {shipments_sql("supplier")} group by 1, 2""")
def monthly_sum(t):
    return rounded(aggregates.monthly_sum(t.shipments("supplier"), ["us_nation"], "ship_date", "metric_tons", "metric_tons"),
                   4, "metric_tons")


@query("moments", f"""
    select round(avg(metric_tons), 6) as metric_tons_mean, round(stddev_samp(metric_tons), 6) as metric_tons_sd,
        round(avg(value_usd), 4) as value_usd_mean, round(stddev_samp(value_usd), 4) as value_usd_sd
    from {shipments_sql()}""")
def moments(t):
    return rounded(rounded(aggregates.moments(t.shipments(), ["metric_tons", "value_usd"]), 6,
                           "metric_tons_mean", "metric_tons_sd"), 4, "value_usd_mean", "value_usd_sd")


@query("count_distinct", f"""
    select count(distinct us_company) as us_company, count(distinct foreign_company) as foreign_company,
        count(distinct hs_class) as hs_class, count(distinct ship_date) as ship_date
    from {shipments_sql("part", "supplier", "customer")}""")
def count_distinct(t):
    return aggregates.count_distinct(t.shipments("part", "supplier", "customer"),
                                     ["us_company", "foreign_company", "hs_class", "ship_date"])


COUNTED = ["us_company", "foreign_company", "hs_class", "ship_date"]


@query("approx_distinct", f"""
    select {", ".join(f"count(distinct {c}) as {c}, true as {c}_near" for c in COUNTED)}
    from {shipments_sql("part", "supplier", "customer")}""")
def approx_distinct(t):
    """Exact counts, and whether the sketch is within five of its standard errors."""
    s = t.shipments("part", "supplier", "customer")
    exact = aggregates.count_distinct(s, COUNTED)
    sketch = aggregates.count_distinct(s, COUNTED, approximate=True, rsd=0.02).select(F.struct(*COUNTED)).scalar()
    return exact.select(*COUNTED, *((F.abs(F.col(c) - sketch[c]) <= 0.1 * F.col(c)).alias(f"{c}_near") for c in COUNTED))


@query("profile_columns", """
    with o as (select o_orderkey as order_key, nullif(o_orderstatus, 'P') as status, o_totalprice as price,
        case when o_totalprice > 100000 then o_orderpriority end as carrier from orders)
    select 'order_key' as column_name, 'bigint' as data_type, count(*) - count(order_key) as count_missing,
        count(distinct order_key) as number_unique from o
    union all select 'status', 'string', count(*) - count(status), count(distinct status) from o
    union all select 'price', 'double', count(*) - count(price), count(distinct price) from o
    union all select 'carrier', 'string', count(*) - count(carrier), count(distinct carrier) from o""")
def profile_columns(t):
    return aggregates.profile(t.orders.select(
        F.col("o_orderkey").alias("order_key"), F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("carrier")))


@query("value_counts_pct", f"""
    select boosting_type, count(*) as n, round(100.0 * count(*) / (select count(*) from {TRIALS_SQL}), 6) as pct
    from {TRIALS_SQL} group by boosting_type""")
def value_counts_pct(t):
    return rounded(aggregates.value_counts(t.trials(), "boosting_type"), 6, "pct")


@query("five_number", f"""
    select trade_direction, min(value_usd) as "min", round(quantile_cont(value_usd, 0.25), 4) as q1,
        round(median(value_usd), 4) as median, round(avg(value_usd), 4) as mean,
        round(quantile_cont(value_usd, 0.75), 4) as q3, max(value_usd) as "max"
    from {shipments_sql()} group by trade_direction
    union all select 'Both', min(value_usd), round(quantile_cont(value_usd, 0.25), 4), round(median(value_usd), 4),
        round(avg(value_usd), 4), round(quantile_cont(value_usd, 0.75), 4), max(value_usd) from {shipments_sql()}""")
def five_number(t):
    s = t.shipments()
    by_direction = quantiles.five_number(s, "value_usd", ["trade_direction"])
    both = quantiles.five_number(s, "value_usd").withColumn("trade_direction", F.lit("Both"))
    return rounded(by_direction.unionByName(both), 4, "q1", "median", "mean", "q3")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_min", "select week, " + ", ".join(
    f"min(case when event_type = '{e}' then value end) as {e}" for e in EVENT_TYPES) + f"""
    from (select {WEEK_SQL} as week, event_type, value from {WEEKLY_SOURCE_SQL}) group by week""")
def pivot_min(t):
    from quayside.functions.timekeys import week_ending_monday
    source = t.weekly_source().withColumn("week", week_ending_monday("date"))
    return aggregates.pivot_min(source, "week", "event_type", EVENT_TYPES, "value")


@query("first_nonzero_period", f"""
    select nation_key, coalesce(min(case when v <> 0 then date end), min(date)) as first_time
    from (select nation_key, date, case when value > 200 then value else 0 end as v from {WEEKLY_SOURCE_SQL})
    group by nation_key""")
def first_nonzero_period(t):
    source = t.weekly_source().withColumn("v", F.when(F.col("value") > 200, F.col("value")).otherwise(0))
    return aggregates.first_nonzero(source, "nation_key", "date", "v")


@query("actual_vs_pred_extremes", f"""
    select 'flat' as run, year, max(value_usd) as max_actual, max(1500 * metric_tons) as max_predicted,
        round(avg(value_usd), 4) as mean_actual, round(avg(1500 * metric_tons), 4) as mean_predicted,
        min(value_usd) as min_actual, min(1500 * metric_tons) as min_predicted from {shipments_sql()} group by year
    union all
    select 'offset', year, max(value_usd), max(1000 + 1400 * metric_tons), round(avg(value_usd), 4),
        round(avg(1000 + 1400 * metric_tons), 4), min(value_usd), min(1000 + 1400 * metric_tons)
    from {shipments_sql()} group by year""")
def actual_vs_pred_extremes(t):
    from quayside.operators.evaluation import extremes_by
    s = t.shipments()
    runs = {"flat": s.withColumn("yhat", 1500 * F.col("metric_tons")),
            "offset": s.withColumn("yhat", 1000 + 1400 * F.col("metric_tons"))}
    return rounded(extremes_by(runs, "value_usd", "yhat", ["year"]), 4, "mean_actual", "mean_predicted")


@query("best_trial", f"select * from {TRIALS_SQL} order by loss, iteration limit 1")
def best_trial(t):
    return aggregates.best_by(t.trials(), "loss", "iteration")


@query("best_trial_per_group", f"""
    select * from {TRIALS_SQL} qualify row_number() over (partition by boosting_type order by loss, iteration) = 1""")
def best_trial_per_group(t):
    return aggregates.best_by(t.trials(), "loss", "iteration", ["boosting_type"])


@query("histogram", f"""
    with b as (select min(loss) as lo, max(loss) as hi from {TRIALS_SQL})
    select cast(least(floor((loss - lo) / (hi - lo) * 20) + 1, 20) as integer) as bin, count(*) as n,
        min(loss) as low, max(loss) as high from {TRIALS_SQL}, b group by 1""")
def histogram(t):
    return aggregates.histogram(t.trials(), "loss", 20)


@query("trend_regression", f"""
    select boosting_type, round(regr_slope(k, iteration), 9) as slope, round(regr_intercept(k, iteration), 5) as intercept,
        round(regr_r2(k, iteration), 9) as r2, cast(regr_count(k, iteration) as bigint) as n
    from (select boosting_type, iteration, cast(json_extract_string(params, '$.k') as double) as k from {TRIALS_SQL})
    group by boosting_type""")
def trend_regression(t):
    log = trials_to_columns(t.trials(), numeric=["k"])
    return rounded(rounded(aggregates.trend(log, "k", "iteration", ["boosting_type"]), 9, "slope", "r2"), 5, "intercept")


@query("composition_by_year", f"""
    select trade_direction, hs_group, year, count(*) as n, round(sum(metric_tons), 4) as volume
    from {shipments_sql("part")} where hs_class in ({", ".join(map(str, HS_CLASSES))})
    group by trade_direction, hs_group, year""")
def composition_by_year(t):
    s = filter_in(t.shipments("part"), "hs_class", HS_CLASSES)
    return rounded(aggregates.composition(s, ["trade_direction", "hs_group", "year"], "metric_tons"), 4, "volume")


for _kind in ("rollup", "cube"):
    @query(f"composition_{_kind}", f"""
        select trade_direction, hs_group, year, count(*) as n, round(sum(metric_tons), 4) as volume,
            cast(grouping(trade_direction, hs_group, year) as bigint) as level
        from {shipments_sql("part")} group by {_kind}(trade_direction, hs_group, year)""")
    def _composition(t, kind=_kind):
        return rounded(aggregates.composition(t.shipments("part"), ["trade_direction", "hs_group", "year"],
                                              "metric_tons", kind), 4, "volume")


@query("correlation", f"""
    with s as {shipments_sql("part")}
    select 'metric_tons' as a, 'value_usd' as b, round(corr(metric_tons, value_usd), 8) as corr from s
    union all select 'metric_tons', 'teus', round(corr(metric_tons, teus), 8) from s
    union all select 'value_usd', 'teus', round(corr(value_usd, teus), 8) from s""")
def correlation(t):
    return rounded(aggregates.corr_matrix(t.shipments("part"), ["metric_tons", "value_usd", "teus"]), 8, "corr")
