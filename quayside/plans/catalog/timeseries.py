"""Monthly series, forecasts and simulation."""

from pyspark.sql import functions as F

from quayside.operators import quantiles, series
from quayside.operators.evaluation import forecast_errors as errors
from quayside.plans.catalog.aggregating import rounded
from quayside.plans.catalog.sequences import MONTHLY_SQL, monthly
from quayside.plans.registry import query
from quayside.plans.views import shipments_sql

CUTOFFS = [1998, 1999, 2000, 2001]


@query("expanding_windows", f"""
    select w as "window", us_nation, count(*) as n, min(month) as first_month, max(month) as last_month,
        round(sum(tons), 3) as tons
    from {MONTHLY_SQL}, (values (1998), (1999), (2000), (2001)) c(w) where year(month) < w group by all""")
def expanding_windows(t):
    return series.expanding_windows(monthly(t), "month", CUTOFFS).groupBy("window", "us_nation").agg(
        F.count(F.lit(1)).alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.round(F.sum("tons"), 3).alias("tons"))


@query("dickey_fuller", f"""
    with d as (select us_nation, ln(tons) - lag(ln(tons)) over w as dy, lag(ln(tons)) over w as y
            from {MONTHLY_SQL} window w as (partition by us_nation order by month)),
        f as (select us_nation, regr_slope(dy, y) as slope, cast(regr_count(dy, y) as bigint) as n, regr_sxx(dy, y) as sxx,
            regr_syy(dy, y) as syy from d group by 1)
    select us_nation, n, round(slope, 7) as slope,
        round(slope / sqrt((syy - slope * slope * sxx) / ((n - 2) * sxx)), 5) as statistic from f""")
def dickey_fuller(t):
    logs = monthly(t).withColumn("log_tons", F.log("tons"))
    out = series.dickey_fuller(logs, ["us_nation"], "month", "log_tons")
    return rounded(rounded(out, 7, "slope"), 5, "statistic")


@query("augmented_dickey_fuller")
def augmented_dickey_fuller(t):
    return series.augmented_dickey_fuller(monthly(t).withColumn("log_tons", F.log("tons")), ["us_nation"], "month", "log_tons")


@query("difference_order")
def difference_order(t):
    return series.difference_order(monthly(t).withColumn("log_tons", F.log("tons")), ["us_nation"], "month", "log_tons")


def windowed_changes(t):
    logs = series.log_diff(monthly(t), ["us_nation"], "month", "tons")
    return series.expanding_windows(logs, "month", CUTOFFS)


def fitted(t):
    changes = windowed_changes(t)
    fits = series.garch_grid(changes, ["us_nation", "window"], "month", "log_change")
    start = changes.groupBy("us_nation", "window").agg(F.max_by("log_value", "month").alias("start"))
    return fits.join(start, ["us_nation", "window"])


@query("garch_grid_fit")
def garch_grid_fit(t):
    return fitted(t)


@query("garch_forecast")
def garch_forecast(t):
    return series.garch_forecast(fitted(t), ["us_nation", "window"])


@query("simulate_paths")
def simulate_paths(t):
    return series.simulate_paths(fitted(t), ["us_nation", "window"], 300)


@query("path_intervals")
def path_intervals(t):
    return series.path_intervals(series.simulate_paths(fitted(t), ["us_nation", "window"], 300), ["us_nation", "window"])


@query("interval_quantiles", f"""
    select year, p as prob, round(quantile_cont(value_usd, 0.025), 4) as value from {shipments_sql()}, (values (0.025::double)) v(p) group by all
    union all
    select year, p, round(quantile_cont(value_usd, 0.975), 4) from {shipments_sql()}, (values (0.975::double)) v(p) group by all""")
def interval_quantiles(t):
    return rounded(quantiles.quantiles(t.shipments(), "value_usd", [0.025, 0.975], ["year"]), 4, "value")


@query("forecast_errors", f"""
    select f.us_nation, count(*) as n, round(avg(abs(a.tons - f.tons)), 4) as mae,
        round(avg((a.tons - f.tons) * (a.tons - f.tons)), 3) as mse,
        round(sqrt(avg((a.tons - f.tons) * (a.tons - f.tons))), 4) as rmse,
        round(1 - avg((a.tons - f.tons) * (a.tons - f.tons)) / var_pop(a.tons), 6) as r2
    from {MONTHLY_SQL} f join {MONTHLY_SQL} a on f.us_nation = a.us_nation and a.month = f.month + interval 12 month
    group by f.us_nation""")
def forecast_errors(t):
    actual = monthly(t).select("us_nation", "month", F.col("tons").alias("observed"))
    # the value a year before, as a forecast
    forecast = actual.select("us_nation", F.add_months("month", 12).alias("month"), F.col("observed").alias("predicted"))
    out = errors(forecast, actual, ["us_nation", "month"], "predicted", "observed", ["us_nation"])
    return rounded(rounded(rounded(out, 4, "mae", "rmse"), 3, "mse"), 6, "r2")
