"""Trade view of the star-schema tables, as DataFrames and as the same SQL text."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

# The columns that name a shipment row.
SHIPMENT_KEY = ["order_key", "line_number", "part_key", "supplier_key"]

# Line numbers repeat, so draws by hash also use the date to tell rows apart.
DRAW_KEY = [*SHIPMENT_KEY, "ship_date"]

SIDES = {
    "part": ("part_key", "part", "p_partkey"),
    "supplier": ("supplier_key", "supplier", "s_suppkey"),
    "order": ("order_key", "orders", "o_orderkey"),
    "customer": ("customer_key", "customer", "c_custkey"),
}
# The order in which sides are joined: the widest tables first, so that rows which a join shuffles
# do not carry the names of the others yet.
JOINED = ["order", "customer", "part", "supplier"]
COLUMNS = {
    "part": {"goods": "p_name", "brand": "p_brand", "hs_group": "p_type", "teus": "cast(p_size as double)",
             "hs_class": "cast(replace(p_brand, 'Brand#', '') as int)"},
    "supplier": {"us_company": "s_name", "us_nation": "s_nationkey"},
    "order": {"customer_key": "o_custkey", "carrier": "o_orderpriority",
              "order_date": "cast(o_orderdate as date)"},
    "customer": {"foreign_company": "c_name", "foreign_nation": "c_nationkey", "segment": "c_mktsegment"},
}
SHIPMENT = {
    "order_key": "l_orderkey", "line_number": "l_linenumber", "part_key": "l_partkey",
    "supplier_key": "l_suppkey", "metric_tons": "l_quantity", "value_usd": "l_extendedprice",
    "discount": "l_discount", "tax": "l_tax", "status": "l_linestatus",
    "trade_direction": "case when l_returnflag = 'R' then 'Import' else 'Export' end",
    "ship_date": "cast(l_shipdate as date)", "year": "cast(year(l_shipdate) as int)",
}


class Tables:
    """The Parquet tables of one folder, read lazily."""

    names = ("region nation customer supplier part orders lineitem events documents "
             "embeddings pages benchmark labels conversations").split()

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Tables.names:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shipments(self, *sides: str, deal: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
        """Shipment rows with the attributes of the named sides only, so that a query
        pays for no join it does not use. ``deal`` names columns that the rows are dealt out
        by before the joins: a join on them then shuffles the rows no second time. ``first``
        is joined before the other sides, for a query that drops many rows by its attributes."""
        sides = _ordered(sides)
        out = self.lineitem.selectExpr(*(f"{e} as {n}" for n, e in SHIPMENT.items()))
        if deal:
            out = out.repartition(*deal)
        for side in sorted(sides, key=lambda s: (s != first, JOINED.index(s))):
            fact_key, table, key = SIDES[side]
            dim = getattr(self, table).selectExpr(f"{key} as _key", *(f"{e} as {n}" for n, e in COLUMNS[side].items()))
            out = out.join(dim, F.col(fact_key) == F.col("_key")).drop("_key")
        return out.select(*SHIPMENT, *(n for side in sides for n in COLUMNS[side]))

    @cached_property
    def nations(self) -> DataFrame:
        """Country with its region."""
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("country"),
            F.col("r_name").alias("region"))

    def weekly_source(self) -> DataFrame:
        """Dated counts per entity, the shape of daily case rows."""
        return self.events.select(
            (F.col("user_id") % 25).cast("int").alias("nation_key"),
            F.to_date("ts").alias("date"), F.col("event_type"), F.col("value"))

    def trials(self) -> DataFrame:
        """A search log: loss, parameters as text, iteration, group and time."""
        return self.events.select(
            F.col("value").alias("loss"), F.col("props").alias("params"),
            F.col("event_id").alias("iteration"), F.col("event_type").alias("boosting_type"),
            (F.col("user_id") % 60).cast("double").alias("train_time"))


def _ordered(sides: tuple[str, ...]) -> list[str]:
    wanted = set(sides)
    if "customer" in wanted:
        wanted.add("order")
    unknown = wanted - set(SIDES)
    if unknown:
        raise ValueError(f"unknown sides: {sorted(unknown)}")
    return [s for s in SIDES if s in wanted]


def shipments_sql(*sides: str) -> str:
    """The SQL of :meth:`Tables.shipments`, as a parenthesised subquery."""
    columns = [f"{e} as {n}" for n, e in SHIPMENT.items()]
    joins = ""
    for side in _ordered(sides):
        fact_key, table, key = SIDES[side]
        source = "o_custkey" if fact_key == "customer_key" else SHIPMENT[fact_key]
        joins += f" join {table} on {source} = {key}"
        columns += [f"{e} as {n}" for n, e in COLUMNS[side].items()]
    return f"(select {', '.join(columns)} from lineitem{joins})"


NATIONS_SQL = ("(select n_nationkey as nation_key, n_name as country, r_name as region "
               "from nation join region on n_regionkey = r_regionkey)")
WEEKLY_SOURCE_SQL = ("(select cast(user_id % 25 as int) as nation_key, cast(ts as date) as date, "
                     "event_type, value from events)")
TRIALS_SQL = ("(select value as loss, props as params, event_id as iteration, event_type as boosting_type, "
              "cast(user_id % 60 as double) as train_time from events)")
