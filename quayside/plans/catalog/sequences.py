"""Ordered operators and outliers."""

from pyspark.sql import functions as F

from quayside.operators import outliers, windows
from quayside.operators.trials import best_so_far as running_best, rank_trials as ranked
from quayside.plans.catalog.aggregating import rounded
from quayside.plans.registry import query
from quayside.plans.views import SHIPMENT_KEY, TRIALS_SQL, shipments_sql

KEY = ", ".join(SHIPMENT_KEY)

MONTHLY_SQL = f"""(select us_nation, cast(date_trunc('month', ship_date) as date) as month,
    round(sum(metric_tons), 4) as tons, round(sum(value_usd), 2) as usd from {shipments_sql("supplier")} group by 1, 2)"""


def monthly(t):
    """One row per entity and month: the series the ordered operators work on."""
    return t.shipments("supplier").groupBy("us_nation", F.trunc("ship_date", "month").alias("month")).agg(
        F.round(F.sum("metric_tons"), 4).alias("tons"), F.round(F.sum("value_usd"), 2).alias("usd"))


@query("supervised_lag", f"""
    select * from (select us_nation, month, lag(tons, 1) over w as tons_t_minus_1, lag(usd, 1) over w as usd_t_minus_1,
        tons as tons_t, usd as usd_t from {MONTHLY_SQL} window w as (partition by us_nation order by month))
    where tons_t_minus_1 is not null and usd_t_minus_1 is not null""")
def supervised_lag(t):
    return windows.supervised(monthly(t), ["us_nation"], "month", ["tons", "usd"], 1, 1)


@query("supervised_lag_lead", f"""
    select * from (select us_nation, month, lag(tons, 3) over w as tons_t_minus_3, lag(tons, 2) over w as tons_t_minus_2,
        lag(tons, 1) over w as tons_t_minus_1, tons as tons_t, lead(tons, 1) over w as tons_t_plus_1
        from {MONTHLY_SQL} window w as (partition by us_nation order by month))
    where tons_t_minus_3 is not null and tons_t_plus_1 is not null""")
def supervised_lag_lead(t):
    return windows.supervised(monthly(t), ["us_nation"], "month", ["tons"], 3, 2)


@query("log_diff", f"""
    select * from (select us_nation, month, round(ln(tons), 8) as log_tons,
        round(ln(tons) - lag(ln(tons)) over (partition by us_nation order by month), 8) as log_change
        from {MONTHLY_SQL}) where log_change is not null""")
def log_diff(t):
    from quayside.operators.series import log_diff as change
    return rounded(change(monthly(t).drop("usd"), ["us_nation"], "month", "tons", "log_tons", "log_change")
                   .drop("tons"), 8, "log_tons", "log_change")


@query("undiff_roundtrip", f"""
    select us_nation, month, tons, round(tons, 3) as rebuilt from {MONTHLY_SQL}
    qualify row_number() over (partition by us_nation order by month) > 1""")
def undiff_roundtrip(t):
    from quayside.operators.series import log_diff as change
    series = monthly(t).drop("usd")
    start = series.groupBy("us_nation").agg(F.log(F.min_by("tons", "month")).alias("start"))
    changed = change(series, ["us_nation"], "month", "tons", "log_tons", "log_change")
    rebuilt = windows.undiff(changed.join(start, "us_nation"), ["us_nation"], "month", "log_change", "start", "rebuilt")
    return rounded(rebuilt.select("us_nation", "month", "tons", "rebuilt"), 3, "rebuilt")


@query("pct_from_first", f"""
    select us_nation, month, tons, round((tons - first_tons) / first_tons * 100, 6) as pct
    from {MONTHLY_SQL} join (select us_nation as n, min_by(tons, month) as first_tons from {MONTHLY_SQL} group by 1)
    on us_nation = n""")
def pct_from_first(t):
    series = monthly(t).drop("usd")
    first = series.filter("tons <> 0").groupBy("us_nation").agg(F.min_by("tons", "month").alias("first_tons"))
    return series.join(first, "us_nation").select(
        "us_nation", "month", "tons", F.round(windows.pct_from_baseline("tons", "first_tons"), 6).alias("pct"))


GAPS_SQL = f"""(select hs_class, foreign_nation, year, max(case when status = 'F' and discount >= 0.09 then tax end) as tariff
    from {shipments_sql("part", "customer")} group by all)"""


@query("carry_forward", f"""
    select hs_class, foreign_nation, year, last_value(tariff ignore nulls) over
        (partition by hs_class, foreign_nation order by year rows between unbounded preceding and current row) as tariff
    from {GAPS_SQL}""")
def carry_forward(t):
    known = F.when((F.col("status") == "F") & (F.col("discount") >= 0.09), F.col("tax"))
    tariffs = t.shipments("part", "customer").groupBy("hs_class", "foreign_nation", "year").agg(F.max(known).alias("tariff"))
    return windows.carry_forward(tariffs, ["hs_class", "foreign_nation"], "year", ["tariff"])


@query("rank_trials", f"""
    select iteration, loss, row_number() over (order by loss, iteration) as rank from {TRIALS_SQL}""")
def rank_trials(t):
    return ranked(t.trials()).select("iteration", "loss", "rank")


@query("best_so_far", f"""
    select iteration, loss, min(loss) over w as best_so_far, sum(train_time) over w as total_time
    from {TRIALS_SQL} window w as (order by iteration rows between unbounded preceding and current row)""")
def best_so_far(t):
    return running_best(t.trials()).select("iteration", "loss", "best_so_far", "total_time")


@query("zscore_filter", """
    with m as (select avg(value) as mean, stddev_samp(value) as sd from events)
    select event_id, event_type, value from events, m where abs((value - mean) / sd) < 3.5""")
def zscore_filter(t):
    return outliers.drop_outliers(t.events, "value").select("event_id", "event_type", "value")


@query("outlier_chain", """
    with e as (select event_id, value, cast(json_extract_string(props, '$.k') as double) as k from events),
        a as (select * from e where abs((value - (select avg(value) from e)) / (select stddev_samp(value) from e)) < 3.5),
        b as (select * from a where value < 150),
        c as (select * from b where abs((k - (select avg(k) from b)) / (select stddev_samp(k) from b)) < 1.5),
        d as (select * from c where abs((value - (select avg(value) from c)) / (select stddev_samp(value) from c)) < 2)
    select * from d""")
def outlier_chain(t):
    rows = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return outliers.outlier_chain(rows, [("z", "value", 3.5), ("cap", "value", 150), ("z", "k", 1.5), ("z", "value", 2)])


@query("zscore_by_group", """
    select event_id, event_type, value from events join (
        select event_type as g, avg(value) as mean, stddev_samp(value) as sd from events group by 1) on event_type = g
    where abs((value - mean) / sd) < 3.5""")
def zscore_by_group(t):
    return outliers.drop_outliers(t.events, "value", by=["event_type"]).select("event_id", "event_type", "value")
