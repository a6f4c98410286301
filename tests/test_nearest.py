"""As-of and interval joins, streaming sums, groups of names and sparse matrices against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.operators import asof, features, intervals, learners, name_groups, names, sparse
from quayside.plans import warehouse
from quayside.plans.catalog import nearest, searching
from quayside.plans.views import Tables
from quayside.streaming import weekly

DAY = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


# ---- as of

def brute_asof(rows, side, direction, exact, tolerance):
    best = {}
    for k, at, v in side:
        if k is not None and at is not None:
            best[k, at] = max(v, best.get((k, at), v))
    out = []
    for i, k, at in rows:
        found = [(a, v) for (b, a), v in best.items() if b == k and at is not None and (exact or a != at)]
        if direction == "backward":
            found = [x for x in found if x[0] <= at]
        elif direction == "forward":
            found = [x for x in found if x[0] >= at]
        found = [x for x in found if tolerance is None or abs(x[0] - at) <= tolerance]
        hit = min(found, key=lambda x: (abs(x[0] - at), x[0])) if found else (None, None)
        out.append((i, k, day(at), day(hit[0]), hit[1]))
    return Counter(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("exact", "tolerance"), [(True, None), (False, None), (True, 5)])
def test_asof(spark, direction, exact, tolerance):
    rng = random.Random(1)
    # one key has most rows; keys without reports, times before the first and after the last
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "none", None]), rng.choice([None, *range(0, 90)])) for i in range(400)]
    side = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(20, 70)]), rng.randrange(9)) for _ in range(60)]
    df = spark.createDataFrame([(i, k, day(a)) for i, k, a in rows], "i long, k string, at date").repartition(5)
    known = spark.createDataFrame([(k, day(a), v) for k, a, v in side], "country string, reported date, v int")
    got = asof.asof_join(df, known, {"k": "country"}, "at", "reported", direction, exact, tolerance)
    assert got.columns == ["i", "k", "at", "reported", "v"]
    assert Counter(map(tuple, got.collect())) == brute_asof(rows, side, direction, exact, tolerance)
    inner = asof.asof_join(df, known, {"k": "country"}, "at", "reported", direction, exact, tolerance, how="inner")
    assert Counter(map(tuple, inner.collect())) == Counter(r for r in brute_asof(rows, side, direction, exact, tolerance).elements() if r[3])


def test_asof_plan_and_errors(spark):
    df = spark.createDataFrame([("a", 2001, 1.0)], "k string, year int, x double")
    side = spark.createDataFrame([("a", 1999, None, 3), ("a", 1998, "old", None)], "k string, reported int, note string, v int")
    out = asof.asof_join(df, side, {"k": "k"}, "year", "reported")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert [tuple(r) for r in out.collect()] == [("a", 2001, 1.0, 1999, None, 3)]
    empty = asof.asof_join(df, side.limit(0), {"k": "k"}, "year", "reported")
    assert [tuple(r) for r in empty.collect()] == [("a", 2001, 1.0, None, None, None)]
    with pytest.raises(ValueError):
        asof.asof_join(df, side.withColumn("x", F.lit(1)), {"k": "k"}, "year", "reported")
    with pytest.raises(ValueError):
        asof.asof_join(df, side, {"k": "k"}, "year", "note")


def test_tariffs_hold_until_the_next_report(spark):
    fact = spark.createDataFrame([(c, 10, y, dt.date(y, 3, 1)) for c in ("A", "B", "M", "Z") for y in range(2010, 2016)],
                                 "country string, hs_class int, year int, year_month date")
    rates = spark.createDataFrame([(f"{y}-03", 5.0) for y in range(2010, 2016)], "year_month string, unemployment_rate double")
    tariffs = spark.createDataFrame([("A", 10, 2010, "1.5", "Yes", "No"), ("A", 10, 2013, "2.5", "No", "No"), ("A", 10, 2014, None, "No", "No"),
                                     ("B", 10, 2012, "9", "No", "No"), ("EU", 10, 2011, "4", "No", "Yes")],
                                    "country string, hs_family int, tariff_year int, average_tariff string, free_trade_agreement_with_us string, european_union string")
    prices = spark.createDataFrame([("EU", "2012-03", "euro", 0.8), ("M", "2013-03", "own", 0.9), ("A", "2010-03", "a", 2.0), ("A", "2011-03", None, None)],
                                   "country string, month_year string, currency string, price double")
    members = spark.createDataFrame([("EU", "M")], "country string, member string")
    got = {(r.country, r.year): r for r in warehouse.enrich_economic(fact, rates, tariffs, prices, "country", members).collect()}
    assert [got["A", y].average_tariff for y in range(2010, 2016)] == [1.5, 1.5, 1.5, 2.5, 2.5, 2.5]
    assert [got["B", y].average_tariff for y in range(2010, 2016)] == [None, None, 9, 9, 9, 9]
    assert [got["M", y].average_tariff for y in range(2010, 2016)] == [None, 4, 4, 4, 4, 4]
    assert got["Z", 2015].average_tariff is None and len(got) == 24
    assert [got["M", y].price for y in range(2010, 2016)] == [None, None, 0.8, 0.9, None, None]
    assert [got["A", y].price for y in (2010, 2011)] == [2.0, None]
    carried = {(r.country, r.year): r.price for r in warehouse.enrich_economic(fact, rates, tariffs, prices, "country", members, carry_prices=True).collect()}
    assert [carried["A", y] for y in (2010, 2011)] == [2.0, 2.0]


# ---- intervals

def spans(rng, n, most):
    out = []
    for i in range(n):
        a = rng.choice([None, *range(-50, 300)])
        b = None if a is None else a + rng.choice([0, 0, 1, 2, 5, 30, most, -3])
        out.append((i, rng.choice(["hot", "hot", "hot", "a", None]), a, b))
    return out


@pytest.mark.parametrize("closed", [True, False])
def test_point_in_interval(spark, closed):
    rng = random.Random(2)
    held = spans(rng, 80, 400)
    points = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-60, 500)])) for i in range(300)]
    df = spark.createDataFrame([(i, k, day(p)) for i, k, p in points], "i long, k string, at date")
    iv = spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in held], "closure long, country string, start date, stop date")
    pairs = Counter((i, j) for i, k, p in points for j, c, a, b in held
                    if k is not None and k == c and None not in (p, a, b) and a <= p and (p <= b if closed else p < b))
    got = intervals.point_in_interval(df, iv, "at", "start", "stop", {"k": "country"}, closed=closed)
    assert Counter((r.i, r.closure) for r in got.collect()) == pairs
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    left = intervals.point_in_interval(df, iv, "at", "start", "stop", {"k": "country"}, "left", closed)
    outside = Counter((i, None) for i, *_ in points if not any(x == i for x, _ in pairs))
    assert Counter((r.i, r.closure) for r in left.collect()) == pairs + outside
    free = intervals.point_in_interval(df, iv, "at", "start", "stop", closed=closed)
    assert free.count() == sum(1 for i, k, p in points for j, c, a, b in held if None not in (p, a, b) and a <= p and (p <= b if closed else p < b))


def test_intervals_of_timestamps_and_nothing(spark):
    df = spark.sql("select timestamp'2020-01-01 00:00:01' as at, 1 as i union all select timestamp'2020-01-05 00:00:00', 2")
    iv = spark.sql("select timestamp'2020-01-01 00:00:00' as a, timestamp'2020-01-01 00:00:01' as b, 7 as j")
    assert [(r.i, r.j) for r in intervals.point_in_interval(df, iv, "at", "a", "b").collect()] == [(1, 7)]
    assert intervals.point_in_interval(df, iv, "at", "a", "b", closed=False).count() == 0
    assert intervals.point_in_interval(df, iv.limit(0), "at", "a", "b").count() == 0
    assert [(r.i, r.j) for r in intervals.point_in_interval(df, iv.limit(0), "at", "a", "b", how="left").orderBy("i").collect()] == [(1, None), (2, None)]


def test_overlaps(spark):
    rng = random.Random(3)
    one, two = spans(rng, 90, 120), spans(rng, 90, 9)
    a = spark.createDataFrame([(i, k, day(x), day(y)) for i, k, x, y in one], "i long, k string, x date, y date")
    b = spark.createDataFrame([(j, c, day(x), day(y)) for j, c, x, y in two], "j long, c string, p date, q date")
    got = intervals.overlap_join(a, b, ("x", "y"), ("p", "q"), {"k": "c"})
    assert got.columns == ["i", "k", "x", "y", "j", "p", "q"]
    assert Counter((r.i, r.j) for r in got.collect()) == Counter(
        (i, j) for i, k, x, y in one for j, c, p, q in two
        if k is not None and k == c and None not in (x, p) and x <= y and p <= q and x <= q and p <= y)

    most = intervals.overlap_join(a.withColumn("one", F.lit(1).cast("long")).unionAll(a.withColumn("one", F.lit(1).cast("long"))), b, ("x", "y"), ("p", "q"), {"k": "c"},
                                  {"n": ("sum", "one"), "first": ("min", "x"), "last": ("max", "y")})
    assert most.columns == ["j", "k", "p", "q", "n", "first", "last"]
    of = {}
    for r in got.collect():
        of.setdefault(r.j, []).append(r)
    assert {r.j: (r.n, r.first, r.last) for r in most.collect()} == {
        j: (2 * len(found), min(r.x for r in found), max(r.y for r in found)) for j, found in of.items()}


@pytest.mark.parametrize("name", ["shipments_in_closures", "shipments_by_open_closures", "closure_overlaps"])
def test_pairs_do_not_follow_the_shipments(spark, tmp_path, monkeypatch, name):
    """The intervals meet as many rows when every order comes ten times under other keys."""
    def tables(folder, copies):
        orders = [(10 * i + c, i % 2, str(day(3 * i)), 480_500.0 if i % 4 == 0 and c == 0 else 1000.0) for i in range(40) for c in range(copies)]
        spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double") \
            .withColumn("o_orderpriority", F.lit("1")).write.parquet(f"{folder}/orders.parquet")
        spark.createDataFrame([(0, 5), (1, 6)], "c_custkey long, c_nationkey int").withColumns({"c_name": F.lit("x"), "c_mktsegment": F.lit("y")}) \
            .write.parquet(f"{folder}/customer.parquet")
        items = [(k, n, 2.0, "R" if n else "A", str(dt.date.fromisoformat(at) + dt.timedelta(days=4 + n))) for k, _, at, _ in orders for n in (0, 1)]
        spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate string").selectExpr(
            "*", "1L as l_partkey", "1L as l_suppkey", "1.0D as l_extendedprice", "0.0D as l_discount", "0.0D as l_tax", "'O' as l_linestatus") \
            .withColumn("l_shipdate", F.col("l_shipdate").cast("date")).write.parquet(f"{folder}/lineitem.parquet")
        return Tables(spark, folder)

    met = []
    plain = intervals.point_in_interval

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        met.append(out.count())
        return out

    monkeypatch.setattr(intervals, "point_in_interval", counted)
    n = {copies: sum(r.n for r in getattr(nearest, name)(tables(str(tmp_path / str(copies)), copies)).collect()) for copies in (1, 10)}
    half = len(met) // 2
    assert met[:half] == met[half:] and sum(met) > 0 and n[10] == 10 * n[1]


# ---- streaming

def write_rows(spark, rows, path):
    spark.createDataFrame(rows, "k string, at timestamp, v long").coalesce(1).write.mode("append").parquet(path)


def monday(at, back=0):
    d = at.date() - dt.timedelta(days=back)
    return d + dt.timedelta(days=(7 - d.weekday()) % 7)


@pytest.mark.parametrize("back", [0, 7])
def test_streamed_weeks_equal_the_batch(spark, tmp_path, back):
    rng = random.Random(4)
    at = lambda n: dt.datetime(2020, 3, 1) + dt.timedelta(hours=n)
    rows = [[(rng.choice("ab"), at(rng.randrange(24 * 7 * part, 24 * 7 * (part + 2))), rng.randrange(100)) for _ in range(60)] for part in range(4)]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], "k string, at timestamp, v long").schema
    wanted = Counter()
    for part in rows:  # each run is a restart from the state the last one left
        write_rows(spark, part, folder)
        done = weekly.run_weekly_totals(weekly.read_arrivals(spark, folder, schema, files_per_batch=1), ["k"], "at", {"v": "total"}, out, state,
                                        "30 days", back)
        assert done == {"read": 60, "late": 0}
        for k, t, v in part:
            wanted[k, monday(t, back)] += v
        assert {(r.k, r.week): r.total for r in weekly.current_totals(spark, out, ["k"]).collect()} == dict(wanted)
    again = weekly.run_weekly_totals(weekly.read_arrivals(spark, folder, schema), ["k"], "at", {"v": "total"}, out, state, "30 days", back)
    assert again["read"] == 0
    weekly.compact(spark, out, str(tmp_path / "sums"), ["k"])
    assert sum(r.n_rows for r in spark.read.parquet(str(tmp_path / "sums")).collect()) == 240


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = spark.createDataFrame([], "k string, at timestamp, v long").schema
    run = lambda: weekly.run_weekly_totals(weekly.read_arrivals(spark, folder, schema), ["k"], "at", {"v": "total"}, out, state, "7 days")
    write_rows(spark, [("a", dt.datetime(2020, 1, 1), 1), ("a", dt.datetime(2020, 3, 2), 2)], folder)
    run()
    write_rows(spark, [("a", dt.datetime(2020, 1, 2), 100), ("a", dt.datetime(2020, 3, 1), 4)], folder)
    assert run()["late"] == 1
    assert {(r.week, r.total) for r in weekly.current_totals(spark, out, ["k"]).collect()} == {(dt.date(2020, 1, 6), 1), (dt.date(2020, 3, 2), 6)}


def test_a_batch_that_runs_twice_replaces_itself(spark, tmp_path):
    sums = spark.createDataFrame([("a", dt.date(2020, 1, 6), 5)], "k string, week date, total long")
    for _ in range(2):
        sums.write.mode("overwrite").parquet(str(tmp_path / "out/batch=0"))
    sums.withColumn("total", F.lit(9).cast("long")).write.parquet(str(tmp_path / "out/batch=1"))
    assert [r.total for r in weekly.current_totals(spark, str(tmp_path / "out"), ["k"]).collect()] == [9]


# ---- groups of names

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def brute_groups(rows, near, spread):
    n = Counter(r for r in rows if r is not None)
    root = {a: a for a in n}
    moved = True
    while moved:
        moved = False
        for a in n:
            for b in n:
                if edits(a, b) <= near and root[b] < root[a]:
                    root[a], moved = root[b], True
    out = []
    for a in n:
        mine = [b for b in n if root[b] == root[a]]
        centre = min(mine, key=lambda b: (-n[b], b))
        away = edits(a, centre)
        out.append((a, n[a], root[a], len(mine), centre if away <= spread else a, away if away <= spread else None, away > spread))
    return Counter(out)


def test_groups_do_not_stretch_along_chains(spark):
    rng = random.Random(5)
    chain = ["a" * i + "b" * (8 - i) for i in range(9)]
    typed = [*chain, "port of lyon", "port of lyom", "prot of lyon", "lone", None, "", "x"] * 2 + ["port of lyon", "aaaabbbb"]
    typed += ["".join(rng.choice("pq") for _ in range(5)) for _ in range(20)]
    df = spark.createDataFrame([(x,) for x in typed], "name string")
    got = name_groups.group_similar(df, "name", 1, 2)
    assert Counter(map(tuple, got.collect())) == brute_groups(typed, 1, 2)
    table = {r.raw: r.clean for r in name_groups.merge_table(got).collect()}
    assert table["port of lyom"] == "port of lyon" and "lone" not in table
    cleaned = names.mass_edit(df, "name", name_groups.merge_table(got))
    assert cleaned.filter("name = 'port of lyom'").count() == 0
    worst = name_groups.conflicts(got).first()
    assert worst.left_out > 0


def test_connected_follows_long_chains(spark):
    rows = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100 + i, 200) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in name_groups.connected(spark.createDataFrame(rows, "left long, right long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, **{100 + i: 100 for i in range(50)}, 200: 100}
    assert name_groups.connected(spark.createDataFrame([], "left long, right long")).count() == 0


# ---- sparse matrices

def test_sparse_matrix_gives_the_same_coefficients(spark):
    rng = random.Random(6)
    rows = [(rng.choice("wxyz"), rng.choice(["p 1", "q.2", "r"]), rng.random(), rng.random(), rng.gauss(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, u double, v double, y double")
    levels = sparse.fit_level_table(df, ["a", "b"])
    thin = learners.fit_least_squares(sparse.sparse_matrix(df, levels, ["u", "v"], ["a", "b"]), "y")
    wide = features.dummy_encode(df, features.fit_levels(df, "a", "b"))
    cols = ["u", "v", *(c for c in wide.columns if c[:2] in ("a_", "b_"))]
    full = learners.fit_least_squares(features.assemble(wide, cols, "y"), "y")
    table = {(r.column, r.level): r.coefficient for r in sparse.coefficient_table(thin.coefficients, levels, ["u", "v"]).collect()}
    by_name = {"u": ("u", None), "v": ("v", None)} | {features.dummy_name(c, x): (c, x) for c, x in table if x}
    for name, value in zip(cols, full.coefficients, strict=True):
        assert table[by_name[name]] == pytest.approx(value, abs=1e-8)
    assert table["a", "w"] == 0 and table["b", "p 1"] == 0
    assert thin.intercept == pytest.approx(full.intercept, abs=1e-8)


def test_files_of_a_matrix_have_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(sparse, "FILE_ROWS", 100)
    df = spark.range(950).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c")).coalesce(1)
    matrix = sparse.sparse_matrix(df, sparse.fit_level_table(df, ["c"]), ["x"], ["c"])
    files = [r["count"] for r in matrix.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 950 and max(files) <= 100


def test_training_and_test_rows_are_tables_of_their_own(spark, tmp_path):
    """A learner's pass over one side does not unpack the rows of the other."""
    items = [(i % 20, i, 0, 0, float(i), float(i), 0.1, 0.2, "R" if i % 2 else "A", "O", dt.datetime(1998 + i % 4, 5, 1) if i % 9 else None) for i in range(60)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, "n", "Brand#1", "t", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 0, str(k % 3), DAY) for k in range(20)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate date") \
        .write.parquet(str(tmp_path / "orders.parquet"))
    train, test, names = searching.split(Tables(spark, str(tmp_path)))
    dated = [i for i in range(60) if i % 9]
    assert sorted(r.value_usd for r in train.collect()) == [i for i in dated if i % 4 < 2]
    assert sorted(r.value_usd for r in test.collect()) == [i for i in dated if i % 4 >= 2]
    assert not set(train.inputFiles()) & set(test.inputFiles()) and all(r.features.size == len(names) for r in train.unionAll(test).collect())


def test_sparse_matrix_of_many_levels_and_odd_ones(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("c"), F.col("id").cast("double").alias("x"), F.col("id").alias("k"))
    levels = sparse.fit_level_table(df.filter("k < 2500"), ["c"])
    assert levels.filter("place is not null").agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place")).first() == (2499, 0, 2498, 2499)
    odd = df.unionAll(spark.sql("select cast(null as string), 1.5d, -1L"))
    rows = {r.k: r.features for r in sparse.sparse_matrix(odd, levels, ["x"], ["c"]).collect()}
    assert rows[-1].size == 2500 and rows[-1].indices.tolist() == [0]
    assert rows[2999].indices.tolist() == [0] and rows[0].indices.tolist() == [0]
    assert rows[7].indices.tolist() == [0, 1 + next(r.place for r in levels.filter("level = 'c7'").collect())]
    with pytest.raises(Exception, match="x is null"):
        sparse.sparse_matrix(df.withColumn("x", F.lit(None).cast("double")), levels, ["x"], ["c"]).count()
    whole = sparse.fit_level_table(df, ["c"], drop_first=False)
    assert whole.filter("place is null").count() == 0 and whole.count() == 3000
