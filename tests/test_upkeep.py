"""Checked reading, deliveries and sketches against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from quayside.operators import sketches
from quayside.plans import warehouse
from quayside.plans.increments import SizedFact
from quayside.sources.checked import file_headers, read_checked

SCHEMA = T.StructType([T.StructField("Date", T.StringType()), T.StructField("Tons", T.DoubleType()), T.StructField("Day", T.DateType()),
                       T.StructField("Port", T.StringType())])


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


# ---- rejects

def test_every_line_is_kept_or_rejected(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", 'Date,Tons,Day,Port\n1,2.5,2020-01-02,"LYON, FR"\n2,x,2020-01-02,P\n,1,,P\n3,4\n4,5,2020-13-01,P\n5,6,2020-01-03,P,extra\n6, 7 ,,\n')
    write(folder, "b.csv", "﻿Port,Extra,Tons,Date\nQ,e,1.5,7\nQ,e,,8\n")  # another order, a title too many, one missing
    write(folder, "c.csv", "Tons,Port\n1,P\n2,P\n")
    write(folder, "d.csv", "Date,Tons,Day,Port\n")
    read = read_checked(spark, str(folder), SCHEMA, required=["Date"])
    kept = [tuple(r) for r in read.kept.orderBy("Date").collect()]
    assert [(r[0], r[1], str(r[2]), r[3]) for r in kept] == [("1", 2.5, "2020-01-02", "LYON, FR"), ("6", 7.0, "None", None), ("7", 1.5, "None", "Q"), ("8", None, "None", "Q")]
    lost = Counter((r.file.rsplit("/", 1)[1], r.reason) for r in read.rejected.collect())
    assert lost == {("a.csv", "Tons is no double"): 1, ("a.csv", "Date is missing"): 1, ("a.csv", "malformed"): 2, ("a.csv", "Day is no date"): 1,
                    ("c.csv", "header lacks Date"): 2}
    assert {r.line for r in read.rejected.filter("reason = 'malformed'").collect()} == {"3,4", "5,6,2020-01-03,P,extra"}
    assert read.kept.schema.fieldNames() == SCHEMA.fieldNames()


def test_nothing_required_and_no_lines(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "Date,Tons,Day,Port\n")
    read = read_checked(spark, str(tmp_path / "in"), SCHEMA)
    assert read.kept.count() == 0 and read.rejected.count() == 0
    write(tmp_path / "in", "b.csv", "Other\nx\n")
    read = read_checked(spark, str(tmp_path / "in"), SCHEMA)
    assert [tuple(r) for r in read.kept.collect()] == [(None, None, None, None)]


def test_headers_are_found_without_sorting_lines(spark, tmp_path):
    for name in "abc":
        write(tmp_path / "in", f"{name}.csv", f"Z,{name},A\n" + "".join(f"{i},0,0\n" for i in range(50)))
    found = file_headers(spark, str(tmp_path / "in"))
    assert sorted((r.file[-5:], *r.titles) for r in found.select("file", "titles").collect()) == [(f"{n}.csv", "Z", n, "A") for n in "abc"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan


# ---- deliveries

ENTITIES = {"us": "us_size", "abroad": "abroad_size"}


def deliveries(spark, rng, n):
    rows = [(f"u{rng.randrange(6)}", rng.choice(["x", "y", "z", None]), rng.choice([2010, 2011, 2012, None]), float(rng.randrange(1, 90)), i) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], "us string, abroad string, year int, metric_tons double, row long")


def whole(rows, least, edges):
    return warehouse.size_entities(rows.dropDuplicates(), ENTITIES, least=least, edges=edges)


def test_deliveries_equal_one_build(spark, tmp_path):
    rng = random.Random(1)
    one, two, three = (deliveries(spark, rng, 120).cache() for _ in range(3))
    two = two.filter("year >= 2011 or year is null")
    fact = SizedFact(spark, str(tmp_path / "fact"), ENTITIES)
    least, edges = [800.0, 500.0], [900, 1000, 1500, 2000]
    columns = ["us", "abroad", "year", "metric_tons", "row", "us_size", "abroad_size"]
    so_far = None
    for part in (one, two, one, three):  # the third repeats the first and changes nothing
        fact.deliver(part)
        so_far = part if so_far is None else so_far.unionAll(part)
        got = fact.read(least, edges).select(*columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole(so_far, least, edges).select(*columns).collect()))
    some = fact.read(least, edges, years=[2011]).select(*columns)
    assert Counter(map(tuple, some.collect())) == Counter(map(tuple, whole(so_far, least, edges).filter("year = 2011").select(*columns).collect()))


def test_other_years_are_not_rewritten(spark, tmp_path):
    rng = random.Random(2)
    rows = deliveries(spark, rng, 80).filter("year is not null").cache()
    fact = SizedFact(spark, str(tmp_path / "fact"), ENTITIES)
    fact.deliver(rows)
    files = {p.name for p in (tmp_path / "fact/fact/year=2010").iterdir()}
    assert fact.deliver(rows.filter("year = 2012").limit(3), replace=True) == [2012]
    assert {p.name for p in (tmp_path / "fact/fact/year=2010").iterdir()} == files
    assert spark.read.parquet(str(tmp_path / "fact/fact")).filter("year = 2012").count() <= 3
    assert fact.deliver(rows.limit(0)) == []


def stored_files(folder):
    return {str(p) for p in folder.rglob("*.parquet")}


def test_a_delivery_writes_new_rows_only(spark, tmp_path):
    rows = deliveries(spark, random.Random(3), 120).withColumn("metric_tons", F.when(F.col("row") % 9 > 0, F.col("metric_tons"))).cache()
    fact = SizedFact(spark, str(tmp_path / "fact"), ENTITIES)
    years = fact.deliver(rows)
    before = stored_files(tmp_path)
    assert sorted(fact.deliver(rows), key=str) == sorted(years, key=str) and stored_files(tmp_path) == before
    more = rows.filter("year = 2012").withColumn("row", F.col("row") + 1000)
    fact.deliver(rows.unionAll(more).unionAll(more))
    after = stored_files(tmp_path)
    assert {p for p in before if "/fact/fact/" in p or "year=2012" not in p} <= after
    assert all("year=2012" in p for p in after - before)
    stored = spark.read.parquet(str(tmp_path / "fact/fact")).select(rows.columns)
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, rows.unionAll(more).distinct().collect()))
    sums = spark.read.parquet(str(tmp_path / "fact/sums")).agg(F.sum("metric_tons")).first()[0]
    assert sums == stored.agg(F.sum("metric_tons")).first()[0]


def test_a_delivery_that_failed_can_be_repeated(spark, tmp_path):
    rng = random.Random(4)
    one, two = deliveries(spark, rng, 60).cache(), deliveries(spark, rng, 60).withColumn("row", F.col("row") + 1000).cache()
    fact = SizedFact(spark, str(tmp_path / "fact"), ENTITIES)
    fact.deliver(one)
    kept = fact.fact_path
    fact.fact_path = kept + "-lost"  # the rows of the second delivery go astray after its sums
    fact.spark.read.parquet(kept).write.partitionBy("year").parquet(fact.fact_path)
    fact.deliver(two)
    fact.fact_path = kept
    fact.deliver(two)
    columns = ["us", "abroad", "year", "metric_tons", "row", "us_size", "abroad_size"]
    got = fact.read([400.0, 200.0], [900, 1000, 1500, 2000]).select(*columns)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, whole(one.unionAll(two), [400.0, 200.0], [900, 1000, 1500, 2000]).select(*columns).collect()))


# ---- sketches

def test_merged_sketches_equal_one_pass(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 12).cast("int").alias("month"), F.when(F.col("id") % 7 > 0, (F.xxhash64("id") % 5000)).alias("v"),
        F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(900))).alias("name"), F.lit(None).cast("double").alias("void"))
    cols = ["v", "name", "void"]
    kept = sketches.period_sketches(df, cols, ["month"])
    assert kept.count() == 36
    merged = {r.column: r for r in sketches.read_sketches(sketches.merge_sketches(kept)).collect()}
    steps = sketches.merge_sketches(kept.withColumn("half", F.col("month") < 6), ["half"])
    assert {r.half for r in steps.collect()} == {True, False}
    twice = {r.column: r for r in sketches.read_sketches(sketches.merge_sketches(steps)).collect()}
    exact = df.agg(F.count_distinct("v").alias("v"), F.count_distinct("name").alias("name"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                   F.avg("v").alias("mean"), F.count_if(F.col("v").isNull()).alias("missing")).first()
    for got in (merged, twice):
        for c in ("v", "name"):
            assert got[c].distinct == pytest.approx(exact[c], rel=0.05)
        assert (got["v"].n, got["v"].missing, got["v"].low, got["v"].high) == (60_000, exact.missing, exact.lo, exact.hi)
        assert got["v"].mean == pytest.approx(exact["mean"])
        for p in (25, 50, 75):
            rank = df.agg(F.avg((F.col("v") <= got["v"][f"q_{p}"]).cast("double"))).first()[0]
            assert rank == pytest.approx(p / 100, abs=0.02)
        assert got["name"].q_50 is None and got["name"].low is None
        assert (got["void"].distinct, got["void"].missing, got["void"].q_50, got["void"]["mean"]) == (0, 60_000, None, None)


def test_sketches_of_an_empty_table(spark):
    none = spark.createDataFrame([], "month int, v double")
    assert sketches.period_sketches(none, ["v"], ["month"]).count() == 0
