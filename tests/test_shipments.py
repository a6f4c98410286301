"""What queries on shipments join and shuffle, on a few rows of their own."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quayside.operators import explain, features, joins
from quayside.plans import catalog, studies
from quayside.plans.catalog import composites
from quayside.plans.registry import QUERIES
from quayside.plans.views import Tables

catalog.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    day = lambda i: datetime(1996 + i % 6, 1 + i % 12, 1 + i % 28)
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION_{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, f"S{i}", i % 4, 1.0) for i in range(3)] + [(1, "S1b", 2, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(i, f"C{i}", i % 4, 1.0, f"SEG{i % 2}") for i in range(5)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(i, f"goods {i}", f"Brand#{i}", f"T{i % 2}", i, 1.0) for i in range(6)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, i % 6, "O", 10.0, day(i), f"{1 + i % 5}-X") for i in range(20)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        # orders, parts and suppliers that no table has, null keys, whole copies
        "lineitem": ([(i % 22 if i % 9 else None, i % 7, i % 4, i % 3, float(i % 5), 10.0 * i, 0.1, 0.05, "R" if i % 2 else "N", "F", day(i)) for i in range(60)] * 2,
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(i, datetime(2024, 1, 1 + i), i, "error", 1.0, "{}") for i in range(5)],
                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / f"{name}.parquet"))
    return str(base)


def reads(df, table):
    return any(f"/{table}.parquet/" in f for f in df.inputFiles())


def test_the_period_study_joins_shipments_once(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(studies, "period_study", lambda fact, *_, **__: seen.append(fact) or (None, None))
    QUERIES["period_study"](spark, folder)
    assert not reads(seen[0], "lineitem") and seen[0].count() > 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dealt_rows_meet_the_orders_without_another_shuffle(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = Tables(spark, folder).shipments("part", "order")
        dealt = Tables(spark, folder).shipments("part", "order", deal=("order_key",))
        assert shuffles(dealt) == shuffles(plain) == 4
        assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keys_do_not_travel_with_shuffled_copies(spark, capsys):
    rows = features.assemble(spark.range(50).select(F.col("id").alias("the_key"), (F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("y")), ["x"], "y")
    out = explain.shuffled_features(rows, ["the_key"], 2, 42, "features", 7).select("repeat", "y", "_f", "_other")
    capsys.readouterr()
    out.explain(mode="formatted")
    nodes = capsys.readouterr().out.split("\n\n")
    moved = [n for n in nodes if ") Exchange" in n and "Input [" in n]
    assert moved and not [n for n in moved if "the_key#" in n]


def test_name_maps_of_the_build_have_a_known_size(spark, folder):
    side = composites.side_tables(Tables(spark, folder))
    for names, fillers in ((side.us_companies, 1), (side.foreign_companies, 2)):
        assert int(str(names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
        assert names.filter(F.col(names.columns[0]).startswith("Not ")).count() == fillers


def test_tariffs_and_prices_come_from_one_pass(spark, folder):
    rows = [(n, h, y, s, datetime(y, m, 9), g, v, d, t) for n in (1, 2, 9, None) for h in (2, None) for y, m in ((1996, 1), (1996, 2), (1997, 1))
            for s, g, v, d, t in (("F", "A", 10.0, 0.1, 0.05), ("F", "B", 1e4, 0.05, 0.07), ("O", "C", 30.0, 0.2, 0.06), (None, "D", 2e3 + m, 0.1, 0.08),
                                  ("F", None, None, None, None), ("O", "E", 99.0, 0.0, 0.0))][7:]
    schema = "foreign_nation int, hs_class int, year int, status string, ship_date timestamp, segment string, value_usd double, discount double, tax double"
    shipments = spark.createDataFrame(rows, schema).repartition(5)
    values = composites.extreme_values(shipments)
    assert "SortAggregate" not in values._jdf.queryExecution().executedPlan().toString()
    side = composites.side_tables(Tables(spark, folder), values)
    tariffs, prices = {}, {}
    most = lambda old, new: new if old is None or (new is not None and new > old) else old
    for n, h, y, s, at, g, v, d, t in rows:
        if n not in (1, 2):
            continue
        if d is not None and d >= 0.1 and t >= 0.05:
            old = tariffs.get((f"NATION_{n}", h, y), (None, None))
            tariffs[f"NATION_{n}", h, y] = most(old[0], v), most(old[1], s)
        if s == "F":
            old = prices.get((f"NATION_{n}", f"{at:%Y-%m}"), (None, None))
            prices[f"NATION_{n}", f"{at:%Y-%m}"] = most(old[0], g), most(old[1], t)
    expected = [(*k, f"{v:,.2f}", "Yes" if s == "F" else "No", "Yes" if k[0] < "NATION_2" else "No") for k, (v, s) in tariffs.items()]
    columns = ["country", "hs_family", "tariff_year", "average_tariff", "free_trade_agreement_with_us", "european_union"]
    assert Counter(map(tuple, side.tariffs.select(columns).collect())) == Counter(expected)
    assert Counter(map(tuple, side.currencies.select("country", "month_year", "currency", "price").collect())) == Counter(
        (*k, *v) for k, v in prices.items())


def test_sides_without_trade_are_found_on_the_known_keys(spark):
    fact = spark.createDataFrame([("a", "w1", 1), ("a", "w1", 2), ("b", None, 3), (None, "w2", 4)], "k string, w string, n int")
    dim = spark.createDataFrame([("a", "w1", "A"), ("c", "w2", "C"), ("b", "w3", "B")], "k string, w string, name string")
    seen = fact.select("k", "w").distinct()
    as_bag = lambda df: Counter(map(tuple, df.collect()))
    for join, plain, known in (("preserve_dim", (dim.drop("w"), {"k": "k"}), (dim.drop("w"), {"k": "k"}, seen)), ("outer_period_join", (dim, ["k", "w"]), (dim, ["k", "w"], seen))):
        assert as_bag(getattr(joins, join)(fact, *known)) == as_bag(getattr(joins, join)(fact, *plain))


def test_what_is_joined_first_changes_no_rows(spark, folder):
    t = Tables(spark, folder)
    plain, other = t.shipments("part", "supplier", "customer"), t.shipments("part", "supplier", "customer", first="part")
    assert plain.columns == other.columns
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, other.collect()))
