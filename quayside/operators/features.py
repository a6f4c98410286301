"""Model features. Everything learnt from data is learnt on the training rows, kept as a
small table or model, and applied to any other rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from quayside.operators.columns import drop_columns, require
from quayside.operators.joins import measured


def ordinal_encode(df: DataFrame, col: str, order: list[str], out: str | None = None) -> DataFrame:
    """1-based rank in a given order, 0 for a value the order lacks. The order is explicit,
    so training and test rows always get the same codes."""
    expr = F
    for rank, value in enumerate(order, 1):
        expr = expr.when(F.col(col) == value, rank)
    return df.withColumn(out or col, expr.otherwise(0))


def fit_levels(df: DataFrame, *cols: str, most: int = 1_000) -> dict[str, list]:
    """Sorted levels of each category, in one pass. They become columns, so a column with
    more than ``most`` of them is an error: it is no category."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in cols))
    levels = df.select(F.inline(pairs)).filter(F.col("level").isNotNull()).distinct()
    rows = levels.limit(most * len(cols) + 1).collect()
    found = {c: sorted(r.level for r in rows if r.column == c) for c in cols}
    for c, values in found.items():
        if len(values) > most or len(rows) > most * len(cols):
            raise ValueError(f"more than {most} levels in {c if len(values) > most else cols}")
    return found


def dummy_name(col: str, level) -> str:
    return f"{col}_{level}".replace(" ", "_").replace(".", "_")


def dummy_encode(df: DataFrame, levels: dict[str, list], drop_first: bool = True) -> DataFrame:
    """0/1 column per level, the first (alphabetical) level left out; the source columns go.
    A value without a level gets zeros throughout."""
    out = {dummy_name(col, level): F.when(F.col(col) == F.lit(level), 1).otherwise(0)
           for col, values in levels.items() for level in values[1 if drop_first else 0:]}
    return df.withColumns(out).drop(*levels)


def dummy_pipeline(cols: list[str], drop_first: bool = True) -> Pipeline:
    """The same encoding as ML stages: with descending order the dropped last level is the
    alphabetically first. A value not seen in training is an error."""
    indexers = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols],
                             stringOrderType="alphabetDesc", handleInvalid="error")
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_dummies" for c in cols],
                            dropLast=drop_first, handleInvalid="error")
    return Pipeline(stages=[indexers, encoder])


def minmax_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of bounds, computed once."""
    return measured(df.agg(*(e for c in cols for e in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")))))


def minmax_apply(df: DataFrame, bounds: DataFrame, cols: list[str]) -> DataFrame:
    """Scaled to 0..1 by bounds fitted elsewhere; a column of one value becomes 0."""
    b = bounds.select(F.struct(*bounds.columns)).scalar()
    return df.withColumns({
        c: F.coalesce(F.try_divide(F.col(c) - b[f"{c}_min"], b[f"{c}_max"] - b[f"{c}_min"]),
                      F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in cols})


def standard_fit(df: DataFrame, cols: list[str], population: bool = True) -> DataFrame:
    """One row of means and standard deviations, computed once."""
    sd = F.stddev_pop if population else F.stddev_samp
    return measured(df.agg(*(e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), sd(c).alias(f"{c}_sd")))))


def standard_apply(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    s = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({
        c: F.coalesce(F.try_divide(F.col(c) - s[f"{c}_mean"], s[f"{c}_sd"]),
                      F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in cols})


def inverse_scale(df: DataFrame, bounds: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Scaled values of the target (actual, predicted) back to its units."""
    b = bounds.select(F.struct(f"{target}_min", f"{target}_max")).scalar()
    low, high = b[f"{target}_min"], b[f"{target}_max"]
    return df.withColumns({c: F.col(c) * (high - low) + low for c in cols})


def question_dataset(df: DataFrame, target: str, drop: list[str], need: list[str],
                     rows: Column | None = None, without: list[str] = ()) -> DataFrame:
    """Rows and columns for one research question: a period filter, columns that do not
    belong to the question, drivers that must be known, and optionally the volume columns
    that are close copies of the target. The target stays."""
    if target in drop or target in without:
        raise ValueError("the target cannot be dropped")
    if rows is not None:
        df = df.filter(rows)
    return drop_columns(require(df, *need), [*drop, *without])


def assemble(df: DataFrame, cols: list[str], target: str, out: str = "features") -> DataFrame:
    """Vector column for the learners. The target must not be among its own predictors, and a
    null in a feature is an error: :func:`question_dataset` says which rows are wanted."""
    if target in cols:
        raise ValueError(f"target {target} is among the features")
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error").transform(df)


def pca(df: DataFrame, cols: list[str], k: int) -> tuple[PipelineModel, DataFrame]:
    """Principal components fitted on all rows: the model, and the rows with ``pc_1..k``."""
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="error"),
                             PCA(k=k, inputCol="_v", outputCol="_pc")]).fit(df)
    scored = model.transform(df).withColumn("_a", vector_to_array("_pc"))
    return model, scored.withColumns({f"pc_{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_v", "_pc", "_a")
