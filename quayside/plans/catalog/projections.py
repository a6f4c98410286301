"""Projections, filters, predicates, sorts, set operations."""

from pyspark.sql import functions as F

from quayside.fixed_values import HS_CLASSES, SIZE_LABELS
from quayside.functions import numbers, text
from quayside.operators import columns, sets
from quayside.plans.registry import query
from quayside.plans.views import SHIPMENT_KEY, TRIALS_SQL, shipments_sql

HS_LIST = ", ".join(map(str, HS_CLASSES))
KEY = ", ".join(SHIPMENT_KEY)


@query("conform_names", """
    select l_orderkey as order_key, l_partkey as part_key, l_quantity as metric_tons, l_extendedprice as tcvusd
    from lineitem""")
def conform_names(t):
    chosen = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return columns.conform(chosen, {
        "l_orderkey": "order_key", "l_partkey": "part_key", "l_quantity": "metric_tons",
        "l_extendedprice": "tcvusd"}, drop=["l_tax"])


@query("tag_direction", """
    select l_orderkey as order_key, l_linenumber as line_number, 'Export' as trade_direction,
           'Not Applicable to Exports' as foreign_company
    from lineitem where l_returnflag <> 'R'""")
def tag_direction(t):
    exports = t.lineitem.filter("l_returnflag <> 'R'").selectExpr("l_orderkey as order_key", "l_linenumber as line_number")
    return columns.with_constants(exports, trade_direction="Export", foreign_company="Not Applicable to Exports")


NULLED_SQL = f"""(select {KEY}, nullif(metric_tons, 50.0) as metric_tons,
    case when discount = 0.0 then null else value_usd end as value_usd,
    case when tax < 0.01 then null else status end as status from {shipments_sql()})"""


def _nulled(t):
    """Shipments with gaps, derived from the data."""
    return t.shipments().select(
        *SHIPMENT_KEY, F.nullif("metric_tons", F.lit(50.0)).alias("metric_tons"),
        F.when(F.col("discount") != 0.0, F.col("value_usd")).alias("value_usd"),
        F.when(F.col("tax") >= 0.01, F.col("status")).alias("status"))


@query("require_columns", f"select * from {NULLED_SQL} where metric_tons is not null and status is not null")
def require_columns(t):
    return columns.require(_nulled(t), "metric_tons", "status")


@query("complete_cases", f"""select * from {NULLED_SQL}
    where metric_tons is not null and status is not null and value_usd is not null""")
def complete_cases(t):
    return columns.complete_cases(_nulled(t))


@query("hs_class_filter", f"""
    select {KEY}, hs_class from {shipments_sql("part")} where hs_class in ({HS_LIST})""")
def hs_class_filter(t):
    return columns.filter_in(t.shipments("part"), "hs_class", HS_CLASSES).select(*SHIPMENT_KEY, "hs_class")


@query("year_slice", f"""
    select 'early' as slice, year, count(*) as n from {shipments_sql()} where year < 1997 group by year
    union all select 'one', year, count(*) from {shipments_sql()} where year = 2000 group by year
    union all select 'late', year, count(*) from {shipments_sql()} where year > 1999 group by year""")
def year_slice(t):
    s = t.shipments()
    slices = {"early": (None, 1996), "one": (2000, 2000), "late": (2000, None)}
    counted = [columns.year_slice(s, lo, hi, date="ship_date").groupBy("year").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("slice", F.lit(name)) for name, (lo, hi) in slices.items()]
    return sets.union_conformed(*counted)


@query("range_cap", f"select {KEY}, metric_tons from {shipments_sql()} where metric_tons < 25")
def range_cap(t):
    return columns.cap(t.shipments(), "metric_tons", 25).select(*SHIPMENT_KEY, "metric_tons")


@query("binary_flag", """
    select event_id, case when k >= 1 then 1 else k end as refrigerated, case when k >= 50 then 1 else k end as dry
    from (select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events)""")
def binary_flag(t):
    counts = t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return counts.select("event_id", numbers.to_flag("k").alias("refrigerated"), numbers.to_flag("k", 50).alias("dry"))


@query("container_flags", f"""
    select {KEY}, case when status <> 'F' then 0 when goods like '%hot%' or goods like '%Cold%' or goods like '%re%'
        then 1 else 0 end as refrigerated,
        case when status <> 'F' then 0 when goods like '%hot%' or goods like '%Cold%' or goods like '%re%'
        then 0 else 1 end as dry
    from {shipments_sql("part")}""")
def container_flags(t):
    refrigerated, dry = text.container_flags("goods", F.col("status") == "F", ["hot", "Cold", "re"])
    return t.shipments("part").select(*SHIPMENT_KEY, refrigerated.alias("refrigerated"), dry.alias("dry"))


@query("size_bins", """
    select l_partkey as part_key, round(sum(l_quantity), 4) as total,
      case when sum(l_quantity) <= 250 then 'micro' when sum(l_quantity) <= 500 then 'small'
           when sum(l_quantity) <= 750 then 'medium' when sum(l_quantity) <= 1000 then 'large' else 'huge' end as size
    from lineitem group by l_partkey""")
def size_bins(t):
    totals = t.lineitem.groupBy(F.col("l_partkey").alias("part_key")).agg(F.sum("l_quantity").alias("total"))
    size = numbers.bin_by_thresholds("total", [250, 500, 750, 1000], SIZE_LABELS)
    return totals.select("part_key", F.round("total", 4).alias("total"), size.alias("size"))


@query("hs_mixed_flag", """
    select p_partkey as part_key, case when length(p_brand) > 7 then 1 else 0 end as hs_mixed,
           length(trim(p_name)) as name_length from part""")
def hs_mixed_flag(t):
    return t.part.select(F.col("p_partkey").alias("part_key"), numbers.code_is_mixed("p_brand").alias("hs_mixed"),
                         F.length(F.trim("p_name")).cast("long").alias("name_length"))


@query("fill_defaults", f"""
    select {KEY}, coalesce(metric_tons, 0.0) as metric_tons, coalesce(value_usd, 0.0) as value_usd,
           coalesce(status, 'Not Provided') as status from {NULLED_SQL}""")
def fill_defaults(t):
    return columns.fill(_nulled(t), {"metric_tons": 0.0, "value_usd": 0.0, "status": "Not Provided"})


@query("recode_values", """
    select o_orderkey as order_key,
      case o_orderpriority when '1-URGENT' then 'URGENT' when '5-LOW' then 'LOW' else o_orderpriority end as carrier,
      case o_orderstatus when 'O' then true when 'F' then false end as open from orders""")
def recode_values(t):
    yes_no = numbers.recode("o_orderstatus", {"O": "Yes", "F": "No"})
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        numbers.recode("o_orderpriority", {"1-URGENT": "URGENT", "5-LOW": "LOW"}).alias("carrier"),
        numbers.yes_no_to_bool(yes_no).alias("open"))


@query("coerce_number", """
    select p_partkey as part_key, try_cast(replace(p_brand, 'Brand#', '') as double) as hs_class,
           try_cast(p_brand as double) as not_a_number, p_retailprice as tariff from part""")
def coerce_number(t):
    written = F.format_number("p_retailprice", 2)  # with thousands separators
    return t.part.select(
        F.col("p_partkey").alias("part_key"), numbers.to_number(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("hs_class"),
        numbers.to_number("p_brand").alias("not_a_number"), numbers.to_number(written).alias("tariff"))


@query("cast_narrow", """
    select l_orderkey as order_key, l_linenumber as line_number, l_partkey as part_key, l_suppkey as supplier_key,
           cast(l_discount as float) as discount, cast(trunc(l_extendedprice) as integer) as value_usd from lineitem""")
def cast_narrow(t):
    rows = t.shipments().select(*SHIPMENT_KEY, "discount", "value_usd")
    return columns.narrow(rows, floats=["discount"], ints=["value_usd"])


@query("dedupe_rows", "select distinct l_suppkey as supplier_key, l_quantity as metric_tons, l_returnflag as flag from lineitem")
def dedupe_rows(t):
    return columns.dedupe(t.lineitem.selectExpr(
        "l_suppkey as supplier_key", "l_quantity as metric_tons", "l_returnflag as flag"))


@query("sorted_output", f"select {KEY}, value_usd from {shipments_sql()} order by value_usd desc, {KEY}")
def sorted_output(t):
    return t.shipments().select(*SHIPMENT_KEY, "value_usd").orderBy(F.desc("value_usd"), *SHIPMENT_KEY)


@query("top_k", f"select * from {TRIALS_SQL} order by loss, iteration limit 15")
def top_k(t):
    return t.trials().orderBy("loss", "iteration").limit(15)


@query("union_by_name", """
    select l_orderkey as order_key, l_quantity as metric_tons, 'Import' as trade_direction, l_tax as duty,
           cast(null as double) as rebate from lineitem where l_returnflag = 'R'
    union all
    select l_orderkey, l_quantity, 'Export', null, l_discount from lineitem where l_returnflag <> 'R'""")
def union_by_name(t):
    imports = t.lineitem.filter("l_returnflag = 'R'").selectExpr(
        "l_orderkey as order_key", "l_quantity as metric_tons", "'Import' as trade_direction", "l_tax as duty")
    exports = t.lineitem.filter("l_returnflag <> 'R'").selectExpr(
        "l_orderkey as order_key", "l_quantity as metric_tons", "'Export' as trade_direction", "l_discount as rebate")
    return sets.union_conformed(imports, exports)


@query("split_apply_union", f"""
    select {KEY}, case when trade_direction = 'Import' then 'Provided' when status = 'F' then 'Not Provided'
        else status end as status,
      case when trade_direction = 'Import' then metric_tons when status = 'F' then 0.0 else -1.0 end as tons
    from {shipments_sql()}""")
def split_apply_union(t):
    split = columns.split_apply(t.shipments(), [
        (F.col("trade_direction") == "Import", {"status": "Provided", "tons": F.col("metric_tons")}),
        (F.col("status") == "F", {"status": "Not Provided", "tons": 0.0}),
    ], otherwise={"tons": -1.0})
    return split.select(*SHIPMENT_KEY, "status", "tons")


@query("union_distinct", """
    select distinct n as nation_key from (select c_nationkey as n from customer union all select s_nationkey from supplier)""")
def union_distinct(t):
    return sets.union_distinct(t.customer.select(F.col("c_nationkey").alias("nation_key")),
                               t.supplier.select(F.col("s_nationkey").alias("nation_key")))


@query("set_except", """
    select c_custkey as customer_key from customer where c_custkey not in (select o_custkey from orders)""")
def set_except(t):
    return sets.set_diff(t.customer.select(F.col("c_custkey").alias("customer_key")), t.orders.select("o_custkey"))


@query("set_intersect", """
    select c_custkey as customer_key from customer intersect select o_custkey from orders""")
def set_intersect(t):
    return sets.set_common(t.customer.select(F.col("c_custkey").alias("customer_key")), t.orders.select("o_custkey"))
