"""Features, errors and comparisons with an exact answer."""

from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from quayside.fixed_values import SIZE_ORDER
from quayside.operators import evaluation, features, learners, sparse
from quayside.operators.aggregates import corr_matrix
from quayside.operators.columns import year_slice
from quayside.plans.catalog.aggregating import rounded
from quayside.plans.catalog.projections import KEY, NULLED_SQL, _nulled
from quayside.plans.registry import query
from quayside.plans.views import SHIPMENT_KEY, shipments_sql

SIZED_SQL = f"""(select part_key, case when sum(metric_tons) <= 750 then 'micro' when sum(metric_tons) <= 1000 then 'small'
    else 'medium' end as size from {shipments_sql()} group by part_key)"""


@query("ordinal_encode", f"""
    select part_key, cast(case size when 'micro' then 2 when 'small' then 3 when 'medium' then 4 end as int) as size
    from {SIZED_SQL}""")
def ordinal_encode(t):
    total = F.sum("l_quantity")
    sized = t.lineitem.groupBy(F.col("l_partkey").alias("part_key")).agg(
        F.when(total <= 750, "micro").when(total <= 1000, "small").otherwise("medium").alias("size"))
    return features.ordinal_encode(sized, "size", SIZE_ORDER)


LEVELS = {"hs_group": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], "trade_direction": ["Export", "Import"]}


@query("dummy_encode", f"select {KEY}, " + ", ".join(
    f"cast({c} = '{v}' as int) as {c}_{v}" for c, vs in LEVELS.items() for v in vs[1:]) + f"""
    from {shipments_sql("part")}""")
def dummy_encode(t):
    s = t.shipments("part").select(*SHIPMENT_KEY, "hs_group", "trade_direction")
    return features.dummy_encode(s, features.fit_levels(s, "hs_group", "trade_direction"))


SCALED = ["metric_tons", "value_usd"]
TRAIN_SQL = f"(select * from {shipments_sql()} where year < 2000)"


@query("minmax_scale", f"""
    with b as (select min(metric_tons) as t0, max(metric_tons) as t1, min(value_usd) as v0, max(value_usd) as v1 from {TRAIN_SQL})
    select {KEY}, round((metric_tons - t0) / (t1 - t0), 9) as metric_tons, round((value_usd - v0) / (v1 - v0), 9) as value_usd
    from {shipments_sql()}, b where year >= 2000""")
def minmax_scale(t):
    s = t.shipments()
    bounds = features.minmax_fit(year_slice(s, last=1999, date="ship_date"), SCALED)
    test = year_slice(s, 2000, date="ship_date").select(*SHIPMENT_KEY, *SCALED)
    return rounded(features.minmax_apply(test, bounds, SCALED), 9, *SCALED)


@query("standard_scale", f"""
    with b as (select avg(metric_tons) as tm, stddev_pop(metric_tons) as ts, avg(value_usd) as vm, stddev_pop(value_usd) as vs
        from {TRAIN_SQL})
    select {KEY}, round((metric_tons - tm) / ts, 7) as metric_tons, round((value_usd - vm) / vs, 7) as value_usd
    from {shipments_sql()}, b where year >= 2000""")
def standard_scale(t):
    s = t.shipments()
    stats = features.standard_fit(year_slice(s, last=1999, date="ship_date"), SCALED)
    test = year_slice(s, 2000, date="ship_date").select(*SHIPMENT_KEY, *SCALED)
    return rounded(features.standard_apply(test, stats, SCALED), 7, *SCALED)


@query("inverse_scale", f"""
    select {KEY}, metric_tons, round(metric_tons, 6) as restored from {shipments_sql()}""")
def inverse_scale(t):
    s = t.shipments().select(*SHIPMENT_KEY, "metric_tons", F.col("metric_tons").alias("restored"))
    scaled = features.minmax_apply(s, features.minmax_fit(s, ["restored"]), ["restored"])
    bounds = features.minmax_fit(s, ["metric_tons"])
    return rounded(features.inverse_scale(scaled, bounds, "metric_tons", ["restored"]), 6, "restored")


@query("question_dataset", f"""
    select 1 as question, value_usd, status from {NULLED_SQL} where value_usd is not null and status is not null
        and order_key is not null
    union all select 2, value_usd, null from {NULLED_SQL} where metric_tons is not null""")
def question_dataset(t):
    rows = _nulled(t)
    first = features.question_dataset(rows, "value_usd", drop=SHIPMENT_KEY, need=["value_usd", "status"],
                                      rows=F.col("order_key").isNotNull(), without=["metric_tons"])
    second = features.question_dataset(rows, "value_usd", drop=[*SHIPMENT_KEY, "status"], need=["metric_tons"],
                                       without=["metric_tons"])
    return first.withColumn("question", F.lit(1)).unionByName(second.withColumn("question", F.lit(2)), allowMissingColumns=True)


@query("pca_components")
def pca_components(t):
    cols = ["metric_tons", "value_usd", "teus", "discount", "tax"]
    s = t.shipments("part").select(*SHIPMENT_KEY, *cols)
    scaled = features.standard_apply(s, features.standard_fit(s, cols), cols)
    return features.pca(scaled, cols, 2)[1].select(*SHIPMENT_KEY, "pc_1", "pc_2")


ERRORS_SQL = """count(*) as n, round(avg(abs(y - p)), 4) as mae, round(avg((y - p) * (y - p)), 2) as mse,
    round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) as r2"""


def _errors(df):
    return rounded(rounded(rounded(df, 4, "mae", "rmse"), 2, "mse"), 8, "r2")


@query("regression_metrics", f"""
    select trade_direction, {ERRORS_SQL} from (select trade_direction, value_usd as y, 1500 * metric_tons as p
        from {shipments_sql()}) group by trade_direction""")
def regression_metrics(t):
    scored = t.shipments().withColumn("yhat", 1500 * F.col("metric_tons"))
    return _errors(evaluation.regression_metrics(scored, "value_usd", "yhat", ["trade_direction"]))


@query("cross_period_matrix", f"""
    with m as (select year as train_set, regr_slope(value_usd, metric_tons) as s, regr_intercept(value_usd, metric_tons) as i
        from {shipments_sql()} group by year)
    select train_set, test_set, {ERRORS_SQL} from (select train_set, year as test_set, value_usd as y, i + s * metric_tons as p
        from {shipments_sql()}, m) group by all""")
def cross_period_matrix(t):
    s = t.shipments()
    # one line per training year; they come as an array on each test row
    lines = s.groupBy(F.col("year").alias("train_set")).agg(
        F.regr_slope("value_usd", "metric_tons").alias("s"), F.regr_intercept("value_usd", "metric_tons").alias("i"))
    models = lines.agg(F.collect_list(F.struct("train_set", "s", "i")).alias("models")).scalar()
    test = s.select(F.col("year").alias("test_set"), "metric_tons", "value_usd",
                                                         models.alias("m"))
    scored = test.select("test_set", "metric_tons", "value_usd", F.inline("m")) \
        .withColumn("yhat", F.col("i") + F.col("s") * F.col("metric_tons"))
    return _errors(evaluation.cross_period_matrix(scored, "value_usd", "yhat"))


@query("importance_rank_compare", f"""
    with s as {shipments_sql("part")}, w as (
        select trade_direction as model, unnest([{{'f': 'metric_tons', 'w': round(abs(corr(value_usd, metric_tons)), 8)}},
            {{'f': 'teus', 'w': round(abs(corr(value_usd, teus)), 8)}}, {{'f': 'tax', 'w': round(abs(corr(value_usd, tax)), 8)}}]) as e
        from s group by 1)
    select model, e.f as feature, e.w as weight, cast(rank() over (partition by model order by e.w desc) as int) as rank from w""")
def importance_rank_compare(t):
    s = t.shipments("part")
    tables = {d: corr_matrix(s.filter(F.col("trade_direction") == d), ["value_usd", "metric_tons", "teus", "tax"])
              .filter("a = 'value_usd'").select(F.col("b").alias("feature"), F.round(F.abs("corr"), 8).alias("weight"))
              for d in ("Import", "Export")}
    return evaluation.compare_importances(tables)


@query("sparse_level_means", f"""
    with s as {shipments_sql()}, base as (select avg(value_usd) as b from s where cast(part_key as varchar) = (select min(cast(part_key as varchar)) from s))
    select 'part_key' as "column", cast(part_key as varchar) as level, round(avg(value_usd) - any_value(b), 1) as coefficient from s, base group by part_key""")
def sparse_level_means(t):
    # least squares on the dummies of one category: differences of the levels' means
    s = t.shipments().select("part_key", "value_usd")
    levels = sparse.fit_level_table(s, ["part_key"])
    fitted = learners.fit_least_squares(sparse.sparse_matrix(s, levels, [], ["part_key"]), "value_usd")
    return rounded(sparse.coefficient_table(fitted.coefficients, levels, []), 1, "coefficient")


@query("sparse_matrix_rows", f"""
    with s as {shipments_sql("part", "supplier")}, level as (
        select c, l, row_number() over (order by c, l) + 1 as place from (
            select distinct 0 as c, us_company as l from s where us_company <> (select min(us_company) from s)
            union all select distinct 1, hs_group from s where hs_group <> (select min(hs_group) from s)))
    select {KEY}, round(list_sum(v), 6) as total, list_sum(p)::bigint as places, len(p)::int as n_set from (
        select s.*, [metric_tons, teus] || [1.0::double for x in [a.place, b.place] if x is not null] as v,
            [0, 1] || [x for x in [a.place, b.place] if x is not null] as p
        from s left join level a on a.c = 0 and a.l = us_company left join level b on b.c = 1 and b.l = hs_group)""")
def sparse_matrix_rows(t):
    s = t.shipments("part", "supplier").select(*SHIPMENT_KEY, "metric_tons", "teus", "us_company", "hs_group")
    levels = sparse.fit_level_table(s, ["us_company", "hs_group"])
    rows = sparse.sparse_matrix(s, levels, ["metric_tons", "teus"], ["us_company", "hs_group"])
    unwrapped = rows.withColumn("v", unwrap_udt("features"))
    add = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)
    return unwrapped.select(*SHIPMENT_KEY, F.round(add("v.values", "double"), 6).alias("total"),
                            add(F.transform("v.indices", lambda i: i.cast("long")), "long").alias("places"), F.size("v.indices").alias("n_set"))
