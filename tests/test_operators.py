import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import aggregates, columns, joins, names, outliers, quantiles, sampling, sets, windows


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# ---- columns and sets

def test_drop_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError):
        columns.drop_columns(spark.range(1), ["nope"])


def test_split_parts_are_disjoint_and_complete(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 1.0)
    out = columns.split_apply(df, [(F.col("id") < 60, {"part": "a"}), (F.col("id") < 80, {"part": "b"})], {"part": "c"})
    assert rows(out.groupBy("part").count()) == [("a", 60), ("b", 20), ("c", 20)]


def test_union_counts_add_up(spark):
    a, b = spark.range(5).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    out = sets.union_conformed(a, b)
    assert out.count() == 8 and set(out.columns) == {"id", "x", "y"}


def test_year_slice_by_date_equals_by_year(spark):
    df = spark.range(4_000).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    df = df.withColumn("year", F.year("d"))
    for first, last in ((None, 1997), (2000, 2000), (1998, None), (None, None)):
        assert rows(columns.year_slice(df, first, last)) == rows(columns.year_slice(df, first, last, date="d"))


# ---- joins

@pytest.fixture()
def fact(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("z", 5)], "k string, v int")


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), (None, "N")], "k string, label string")


def test_null_keys_match_only_when_asked(fact, dim):
    assert rows(joins.enrich(fact, dim, {"k": "k"}, "inner"), "v", "label") == [(1, "A"), (2, "A"), (3, "B")]
    assert (4, "N") in rows(joins.enrich(fact, dim, {"k": "k"}, "inner", null_safe=True), "v", "label")


def test_keyed_prevents_fan_out(fact, dim):
    twice = joins.keyed(dim.union(dim), "k")
    assert joins.enrich(fact, twice, {"k": "k"}).count() == fact.count()


def test_unmatched_keeps_null_keys(fact, dim):
    assert rows(joins.unmatched(fact, dim, {"k": "k"}), "v") == [(4,), (5,)]


def test_preserve_dim_is_a_right_join(fact, dim):
    expected = fact.join(dim, fact.k == dim.k, "right").select(dim.k, "v", "label")
    assert rows(joins.preserve_dim(fact, dim, {"k": "k"}), "k", "v", "label") == rows(expected)


def test_outer_period_join_is_a_full_outer_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.randrange(6), i) for i in range(40)], "s string, w int, i int")
    right = spark.createDataFrame([(s, w, float(w)) for s in ["a", "c", None] for w in range(4)], "s string, w int, n double")
    r = right.withColumnsRenamed({"s": "s2", "w": "w2"})
    expected = left.join(r, (left.s == r.s2) & (left.w == r.w2), "full_outer").select(
        F.coalesce("s", "s2"), F.coalesce("w", "w2"), "i", "n")
    assert rows(joins.outer_period_join(left, right, ["s", "w"]), "s", "w", "i", "n") == rows(expected)


def test_joins_on_tables_derived_from_the_fact(fact):
    totals = aggregates.totals_over(fact, "k", "v", 2)
    assert rows(joins.semi_qualifying(fact, totals, {"k": "k"}), "v") == [(1,), (2,), (3,), (5,)]
    assert rows(joins.keep_qualifying(fact, totals, "k"), "v", "total") == [(1, 3), (2, 3), (3, 3), (5, 5)]


def test_expand_group(spark):
    df = spark.createDataFrame([("EU", 2.0), ("Chile", 6.0)], "place string, tariff double")
    members = spark.createDataFrame([("EU", "France"), ("EU", "Malta")], "place string, country string")
    assert rows(joins.expand_group(df, members, "place", "country"), "country", "tariff", "is_member") == [
        ("Chile", 6.0, False), ("France", 2.0, True), ("Malta", 2.0, True)]


def test_no_broadcast_hints_in_the_library():
    import pathlib
    import quayside
    for path in pathlib.Path(quayside.__file__).parent.rglob("*.py"):
        assert "broadcast(" not in path.read_text(), path


# ---- aggregates

def test_first_nonzero_of_an_all_zero_entity_is_its_first_period(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 1), ("b", 4, 0), ("b", 5, None)], "k string, t int, v int")
    assert rows(aggregates.first_nonzero(df, "k", "t", "v")) == [("a", 2), ("b", 4)]


def test_histogram_of_a_constant(spark):
    out = aggregates.histogram(spark.range(4).withColumn("x", F.lit(2.0)), "x", 5)
    assert rows(out, "bin", "n") == [(1, 4)]


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=500)
    got = dict(rows(aggregates.histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 10), "bin", "n"))
    counts, _ = np.histogram(x, 10)
    assert [got.get(i + 1, 0) for i in range(10)] == list(counts)


def test_best_by_breaks_ties(spark):
    df = spark.createDataFrame([(1.0, 2, "x"), (1.0, 1, "y"), (None, 0, "z")], "loss double, i int, n string")
    assert rows(aggregates.best_by(df, "loss", "i"), "n") == [("y",)]


def test_weekly_sum_of_running_counts(spark):
    # two counties with running totals: the week's value is the sum of their last totals
    df = spark.createDataFrame([("s", "a", "2020-03-03", 1), ("s", "a", "2020-03-09", 4), ("s", "b", "2020-03-04", 10)],
                               "state string, county string, d string, n int").withColumn("d", F.to_date("d"))
    assert [r.c for r in aggregates.weekly_sum(df, ["state"], "d", {"n": "c"}).collect()] == [15]
    assert [r.c for r in aggregates.weekly_sum(df, ["state"], "d", {"n": "c"}, cumulative_by=["county"]).collect()] == [14]


# ---- quantiles

@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 999])
def test_quantiles_of_small_tables(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = dict(rows(quantiles.quantiles(df, "x", probs)))
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_quantiles_beyond_the_sketch_and_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.xxhash64("id") / 1e18).alias("x"))
    pdf = df.toPandas()
    probs = [0.025, 0.5, 0.9, 0.975]
    got = {(r.g, r.prob): r.value for r in quantiles.quantiles(df, "x", probs, ["g"], accuracy=1_000).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(part.x, p), rel=1e-12)
    whole = dict(rows(quantiles.quantiles(df, "x", probs, accuracy=1_000)))
    for p in probs:
        assert whole[p] == pytest.approx(np.quantile(pdf.x, p), rel=1e-12)


# ---- outliers

def test_constant_column_keeps_all(spark):
    constant = spark.range(10).withColumn("x", F.when(F.col("id") > 0, 1.0))
    assert outliers.drop_outliers(constant, "x").count() == 9  # a null has no distance
    assert outliers.drop_outliers(constant.withColumn("k", F.col("id") % 3), "x", by=["k"]).count() == 9


def test_chain_uses_fresh_moments(spark):
    x = [float(i % 10) for i in range(500)] + [1e6, 900.0, 800.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    kept = np.array(x)
    for _ in range(2):
        kept = kept[np.abs((kept - kept.mean()) / kept.std(ddof=1)) < 3.5]
    out = outliers.outlier_chain(df, [("z", "x", 3.5), ("z", "x", 3.5)])
    assert sorted(r.x for r in out.collect()) == sorted(kept)


# ---- sampling

def brute_force_split(data, fraction):
    import hashlib
    import math
    chosen = set()
    for stratum, part in itertools.groupby(sorted(data, key=lambda r: (str(r[0]), r[1])), key=lambda r: r[0]):
        part = sorted(part, key=lambda r: hashlib.md5(f"{r[1]}|42".encode()).hexdigest())
        chosen |= {r[1] for r in part[:math.ceil(fraction * len(part))]}
    return chosen


def test_split_is_exact_with_a_hot_and_a_null_stratum(spark):
    data = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 17}", i) for i in range(5_000)]
    out = sampling.stratified_split(spark.createDataFrame(data, "s string, i int"), ["s"], 0.2, ["i"])
    got = out.collect()
    assert len(got) == len(data)
    assert {r.i for r in got if r.is_test} == brute_force_split(data, 0.2)


def test_buckets_of_the_hash_do_not_change_the_sample(spark, monkeypatch):
    df = spark.range(2_000)
    expected = {r.id for r in sampling.sample_n(df, 123, ["id"]).collect()}
    assert len(expected) == 123
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", 1)  # buckets of 125 rows: the edge bucket is ranked
    assert {r.id for r in sampling.sample_n(df.repartition(13), 123, ["id"]).collect()} == expected


def test_approximate_split(spark):
    df = spark.range(20_000).withColumn("s", F.col("id") % 3)
    first = {r.id for r in sampling.approximate_split(df, 0.2, ["id"]).filter("is_test").collect()}
    again = {r.id for r in sampling.approximate_split(df.repartition(5), 0.2, ["id"]).filter("is_test").collect()}
    assert first == again and abs(len(first) - 4_000) < 250
    assert all(abs(sum(i % 3 == s for i in first) - 1_333) < 150 for s in range(3))


def test_sample_of_more_than_there_is(spark):
    assert sampling.sample_n(spark.range(10), 100, ["id"]).count() == 10


def test_time_split_never_cuts_a_period(spark):
    df = spark.range(100).select((F.col("id") / 10).cast("int").alias("p"))
    out = sampling.time_split(df, "p", train_rows=35)
    assert out.filter("not is_test").count() == 30
    assert sampling.time_split(df, "p", first_test=7).filter("is_test").count() == 30


# ---- windows

def test_row_numbers_with_a_hot_value(spark):
    df = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("loss"))
    df = df.withColumn("loss", F.round("loss", 3))
    got = windows.row_numbers(df, [F.col("loss"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5_001))
    assert [(r.loss, r.id) for r in got] == sorted((r.loss, r.id) for r in got)


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 5.0)], "k string, x double")
    assert {(r.k, r.value) for r in quantiles.quantiles(df, "x", [0.5], ["k"]).collect()} == {(None, 4.0), ("a", 5.0)}
    running = windows.running(df.withColumn("i", F.col("x").cast("int")), "i", F.floor(F.col("i") / 4), {"s": ("sum", "x")}, ["k"])
    assert running.count() == 10 and running.filter("k is null").agg(F.max("s")).first()[0] == 36.0
    assert outliers.drop_outliers(df, "x", 3.5, ["k"]).count() == 10


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_running_over_blocks(spark, block):
    rng = random.Random(block)
    data = [(k, i, rng.randrange(1000), rng.randrange(9)) for k in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(data, "k string, i int, v int, s int")
    out = windows.running(df, "i", F.floor(F.col("i") / block), {"lo": ("min", "v"), "hi": ("max", "v"), "sum": ("sum", "s")}, ["k"])
    got = {(r.k, r.i): (r.lo, r.hi, r["sum"]) for r in out.collect()}
    for k in ("a", "b"):
        part = [d for d in data if d[0] == k]
        for n in range(1, 301):
            seen = part[:n]
            assert got[k, n - 1] == (min(d[2] for d in seen), max(d[2] for d in seen), sum(d[3] for d in seen))


def test_supervised_frame(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 0, 9.0)], "k string, t int, x double")
    out = windows.supervised(df, ["k"], "t", ["x"], n_in=2, n_out=2)
    assert out.columns == ["k", "t", "x_t_minus_2", "x_t_minus_1", "x_t", "x_t_plus_1"]
    assert rows(out) == [("a", 2, 0.0, 1.0, 2.0, 3.0), ("a", 3, 1.0, 2.0, 3.0, 4.0)]


def test_carry_forward_and_pct(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("b", 1, None)], "k string, t int, x double")
    assert rows(windows.carry_forward(df, ["k"], "t", ["x"])) == [("a", 1, None), ("a", 2, 4.0), ("a", 3, 4.0), ("b", 1, None)]
    pct = spark.createDataFrame([(6.0, 4.0), (1.0, 0.0)], "x double, f double").select(windows.pct_from_baseline("x", "f"))
    assert [r[0] for r in pct.collect()] == [50.0, None]


# ---- names

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if (prev := row) is None else _next_row(row, x, b, i)
    return row[-1]


def _next_row(prev, x, b, i):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_names_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    pool = {"NORVAL", "NORVALE", "SANDRIK", "SENDRIKA", "A", "", "AB", "BA"}
    pool |= {"".join(rng.choice("ABC") for _ in range(rng.randrange(2, 8))) for _ in range(60)}
    df = spark.createDataFrame([(n,) for n in pool for _ in range(3)], "name string")
    expected = {(a, b, levenshtein(a, b)) for a in pool for b in pool if a < b and levenshtein(a, b) <= distance}
    assert {tuple(r) for r in names.cluster_similar(df, "name", distance).collect()} == expected


def test_fingerprint_clusters_and_canonical(spark):
    df = spark.createDataFrame([("PORT ZAHN",), ("PORT-ZAHN",), ("PORT ZAHN",), ("TAMPA",), (None,)], "p string")
    clusters = names.cluster_fingerprint(df, "p")
    assert rows(clusters, "name", "n", "cluster_size") == [("PORT ZAHN", 2, 2), ("PORT-ZAHN", 1, 2)]
    assert rows(names.canonical_name(clusters)) == [("PORTZAHN", "PORT ZAHN")]


def test_recipe_rejects_unknown_steps(spark):
    with pytest.raises(ValueError):
        names.apply_recipe(spark.range(1), '[{"op": "core/unheard-of"}]')


def test_recipe_runs_in_order(spark):
    df = spark.createDataFrame([("NORVÀL", "7"), ("TAMPA", "x"), (None, None)], "port string, n string")
    recipe = """[{"op": "core/text-transform", "columnName": "n", "expression": "value.toNumber()"},
      {"op": "core/column-addition", "baseColumnName": "port", "newColumnName": "clean"},
      {"op": "core/mass-edit", "columnName": "clean", "edits": [{"from": ["NORVAL", "NORVÀL"], "to": "NORVAL"}]},
      {"op": "core/column-removal", "columnName": "port"}]"""
    assert rows(names.apply_recipe(df, recipe), "clean", "n") == [("NORVAL", "7.0"), ("TAMPA", "x"), (None, None)]
