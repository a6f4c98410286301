"""Modelling studies on the warehouse: what drives tonnage, and how models of one period do
on another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, functions as F

from quayside.fixed_values import SIZE_ORDER
from quayside.operators import explain, features, learners, sparse
from quayside.operators.evaluation import cross_period_matrix
from quayside.operators.sampling import stratified_split
from quayside.session import settle

TARGET = "metric_tons"

# Columns that belong to no question, per question those that do not belong to
# it, the drivers that must be known, its years, and the volume columns close to the target.
TIME_COLUMNS = ["ship_date", "year", "year_week", "date_weekly"]
PLACE_COLUMNS = ["foreign_company_country_region", "us_port_clustered"]
QUESTIONS = {
    "composition": {
        "drop": [*TIME_COLUMNS, *PLACE_COLUMNS, "trade_direction", "free_trade_agreement_with_us", "european_union",
                 "price", "currency", "cases_weekly", "deaths_weekly"],
        "need": ["foreign_country_continent", "foreign_country_region", "average_tariff"],
        "years": (None, 2015),
    },
    "pandemic": {
        "drop": [*TIME_COLUMNS, *PLACE_COLUMNS],
        "need": ["foreign_country_continent", "foreign_country_region", "average_tariff", "price", "currency"],
        "years": (2020, 2020),
    },
    "confounding": {
        "drop": [*TIME_COLUMNS, *PLACE_COLUMNS],
        "need": ["foreign_country_continent", "foreign_country_region", "average_tariff", "price", "currency"],
        "years": (None, None),
    },
}
VOLUME_COLUMNS = ["teus", "tcvusd"]
SIZE_COLUMNS = ["us_company_size", "foreign_company_size"]


def question_rows(fact: DataFrame, question: str, reduced: bool = False) -> DataFrame:
    """Rows and columns for a question, ``reduced`` without the volume columns."""
    spec = QUESTIONS[question]
    first, last = spec["years"]
    rows = F.lit(True)
    if first is not None:
        rows = rows & (F.col("year") >= first)
    if last is not None:
        rows = rows & (F.col("year") <= last)
    drop = [c for c in spec["drop"] if c in fact.columns]
    return features.question_dataset(fact, TARGET, drop, spec["need"], rows, VOLUME_COLUMNS if reduced else ())


class ModelFrame:
    """Encoding learnt on training rows: ranks for sizes, dummies without the first level
    for other text, whatever the number of levels, numbers scaled to 0..1 when asked for."""

    def __init__(self, train: DataFrame, target: str, keep: list[str], scale: bool = True):
        kinds = {c: k for c, k in train.dtypes if c != target and c not in keep}
        self.target, self.keep = target, keep
        self.sizes = [c for c in SIZE_COLUMNS if c in kinds]
        self.flags = [c for c, k in kinds.items() if k == "boolean"]
        text = [c for c, k in kinds.items() if k == "string" and c not in self.sizes]
        self.text = text
        self.levels = sparse.fit_level_table(train, text) if text else None
        self.numbers = [c for c in kinds if c not in text]
        self.names = sparse.feature_names(self.levels, self.numbers) if text else self.numbers
        self.bounds = features.minmax_fit(self._coded(train), self.numbers) if scale else None

    def _coded(self, df: DataFrame) -> DataFrame:
        for c in self.sizes:
            df = features.ordinal_encode(df, c, SIZE_ORDER)
        return df.withColumns({c: F.col(c).cast("int") for c in self.flags}) if self.flags else df

    def apply(self, df: DataFrame) -> DataFrame:
        """``keep``, target and feature vector, written once as learners read it often."""
        coded = self._coded(df)
        if self.bounds is not None:
            coded = features.minmax_apply(coded, self.bounds, self.numbers)
        if self.levels is not None:
            return sparse.sparse_matrix(coded.select(*self.keep, self.target, *self.numbers, *self.text), self.levels, self.numbers, self.text)
        return settle(features.assemble(coded, self.names, self.target)
                      .select(*self.keep, self.target, "features"), "features")


def importance_study(fact: DataFrame, question: str, reduced: bool = False, **forest) -> tuple[Model, DataFrame]:
    """Random forest for a question, and its importance table."""
    rows = settle(question_rows(fact, question, reduced), "question")
    frame = ModelFrame(rows, TARGET, [], scale=False)
    model = learners.fit_random_forest(frame.apply(rows), TARGET, **forest)
    return model, explain.impurity_importance(fact.sparkSession, model, frame.names)


def period_study(fact: DataFrame, target: str, periods: dict[str, Column], train: str, key: list[str],
                 stratum: str = "year_week", drop: list[str] = (), test: float = 0.2,
                 make: Callable[[str], Estimator] = learners.linear) -> tuple[Model, DataFrame, DataFrame]:
    """A model of one period scored on held-out rows of it and on the other periods, with
    the permutation importance on the held-out rows.

    The period is split within each ``stratum``; encoders, scalers and model see its
    training part only. Returns model, errors by ``train_set, test_set``, importances.
    """
    own = settle(stratified_split(fact.filter(periods[train]), [stratum], test, key), "period")
    rest = [*key, "is_test"]
    learnt = own.filter(~F.col("is_test")).drop(stratum, *drop)
    frame = ModelFrame(learnt, target, rest)
    training = frame.apply(learnt)
    held_out = frame.apply(own.filter("is_test").drop(stratum, *drop))
    model = make(target).fit(training)
    sets = {f"{train} (training rows)": training, train: held_out}
    for name, rows in periods.items():
        if name != train:
            sets[name] = frame.apply(fact.filter(rows).withColumn("is_test", F.lit(True)).drop(stratum, *drop))
    scored = None
    for name, rows in sets.items():
        part = model.transform(rows).select(F.lit(train).alias("train_set"), F.lit(name).alias("test_set"),
                                            F.col(target).cast("double").alias("y"), "prediction")
        scored = part if scored is None else scored.unionByName(part)
    errors = cross_period_matrix(scored, "y", "prediction")
    return model, errors, explain.permutation_importance(model, held_out, target, key, frame.names)
