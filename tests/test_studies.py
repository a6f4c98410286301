import pytest
from pyspark.sql import functions as F

from quayside.operators import learners
from quayside.plans import studies


@pytest.fixture(scope="module")
def fact(spark):
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    df = spark.range(3_000).select(
        "id", (2014 + h("y", 3)).cast("int").alias("year"), F.concat(F.lit("w"), h("w", 5).cast("string")).alias("year_week"),
        (h("t", 40) + 1.0).alias("teus"), h("v", 900).cast("double").alias("tcvusd"),
        F.when(h("d", 2) == 0, "Import").otherwise("Export").alias("trade_direction"),
        F.when(h("s", 2) == 0, "micro").otherwise("huge").alias("us_company_size"),
        F.when(h("c", 10) > 0, "Asia").alias("foreign_country_continent"), F.lit("East").alias("foreign_country_region"),
        h("a", 7).cast("double").alias("average_tariff"))
    return df.withColumn("metric_tons", 3 * F.col("teus") + F.when(F.col("us_company_size") == "huge", 20.0).otherwise(0.0))


def test_question_rows(fact):
    rows = studies.question_rows(fact, "composition", reduced=True)
    assert not {"year", "year_week", "trade_direction", "teus", "tcvusd"} & set(rows.columns)
    assert rows.count() == fact.filter("year < 2016 and foreign_country_continent is not null").count() > 0
    assert "teus" in studies.question_rows(fact, "composition").columns


def test_importance_study(fact):
    _, table = studies.importance_study(fact.drop("id"), "composition", trees=5, depth=4)
    assert table.first().variable == "teus"
    assert "metric_tons" not in {r.variable for r in table.collect()}


def test_period_study(fact):
    years = {str(y): F.col("year") == y for y in (2014, 2015, 2016)}
    rows = fact.drop("foreign_country_continent")
    _, errors, weights = studies.period_study(rows, "metric_tons", years, "2015", ["id"], drop=["year"],
                                              make=lambda target: learners.linear(target, alpha=1e-4))
    got = {r.test_set: r for r in errors.collect()}
    assert set(got) == {"2015 (training rows)", "2015", "2014", "2016"}
    assert all(r.train_set == "2015" and r.r2 > 0.99 for r in got.values())
    own = fact.filter("year = 2015").groupBy("year_week").count().collect()
    assert got["2015"].n == sum(-(-r["count"] // 5) for r in own)
    top = {r.feature: r.weight for r in weights.collect()}
    assert top["teus"] > top["us_company_size"] > abs(top["tcvusd"])
