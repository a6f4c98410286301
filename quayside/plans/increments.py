"""The sized fact built in steps: each delivery adds to the years it has new rows in.

Two tables make up the state: the fact by year, and the sums per year that company sizes
need. Sizes depend on all years, so they are not stored with the rows; they are taken from
the sums, which are few, whenever the fact is read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside import fixed_values as fixed
from quayside.operators.columns import dedupe
from quayside.operators.joins import keep_qualifying, semi_qualifying
from quayside.plans.warehouse import entity_sizes
from quayside.session import settle


class SizedFact:
    """A fact in a folder that grows by deliveries, and its companies' sizes.

    ``entities`` maps entity columns to size columns, as in :func:`warehouse.size_entities`;
    ``measure`` is what is summed. Rows without a year stand in a partition of their own.
    """

    def __init__(self, spark: SparkSession, path: str, entities: dict[str, str], measure: str = "metric_tons", year: str = "year"):
        self.spark, self.entities, self.measure, self.year = spark, entities, measure, year
        self.fact_path, self.sums_path = f"{path.rstrip('/')}/fact", f"{path.rstrip('/')}/sums"

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as missing:  # nothing was delivered yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _replace(self, rows: DataFrame, path: str) -> None:
        """Rewrites the years that ``rows`` has; the folders of other years are not touched."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.year).parquet(path)

    def _years(self, rows: DataFrame) -> list:
        return [r[0] for r in rows.select(self.year).distinct().collect()]  # calendar years

    def _of_years(self, stored: DataFrame, years: list, like: DataFrame) -> DataFrame:
        """Stored rows of these years, the year with the type it has in ``like``."""
        known = [y for y in years if y is not None]
        touched = F.col(self.year).isin(known) if known else F.lit(False)
        touched = touched | F.col(self.year).isNull() if None in years else touched
        return stored.filter(touched).withColumn(self.year, F.col(self.year).cast(like.schema[self.year].dataType))

    def deliver(self, rows: DataFrame, replace: bool = False) -> list:
        """Adds rows, or with ``replace`` puts them in place of the years they have; returns those years.

        Copies go, among the new rows and against the stored ones, in one distinct of both;
        only what is new is written, first to the shared folder, then beside the stored rows,
        which stay as they are. ``rows`` is read twice, so let it be a table. Sums follow
        from the stored and the new rows of the years that have new ones, and are replaced
        before the rows are added: a delivery that fails on the way finds the same new
        rows when it is repeated, and one that was delivered before changes nothing.
        """
        years = self._years(rows)
        stored = None if replace else self._read(self.fact_path)
        if stored is None:
            new, touched = settle(dedupe(rows), "delivery"), years
        else:
            stored = self._of_years(stored, years, rows)
            both = rows.withColumn("_stored", F.lit(False)).unionByName(stored.withColumn("_stored", F.lit(True)))
            new = both.groupBy(*rows.columns).agg(F.bool_or("_stored").alias("_stored")).filter(~F.col("_stored")).drop("_stored")
            new = settle(new, "delivery")
            touched = self._years(new)
        if touched:
            merged = new if stored is None else new.unionByName(self._of_years(stored, touched, rows))
            self._replace(merged.groupBy(self.year, *self.entities).agg(F.sum(self.measure).alias(self.measure)), self.sums_path)
            if stored is None:
                self._replace(new, self.fact_path)
            else:
                new.write.mode("append").partitionBy(self.year).parquet(self.fact_path)
        return years

    def sizes(self, least: list[float], edges: list[float] = fixed.SIZE_EDGES) -> dict[str, DataFrame]:
        """Size classes per entity column from the stored sums; totals of a later entity count what the earlier ones left.

        Sums of all years are not combined first: most combinations of entities have few rows, and the totals per
        entity are combined before their shuffle anyway."""
        sums = self.spark.read.parquet(self.sums_path)
        out = {}
        for (entity, size), at_least in zip(self.entities.items(), least):
            out[entity] = entity_sizes(sums, entity, size, self.measure, at_least, edges)
            sums = semi_qualifying(sums, out[entity], {entity: entity})
        return out

    def read(self, least: list[float], edges: list[float] = fixed.SIZE_EDGES, years: list[int] | None = None) -> DataFrame:
        """Rows of qualifying entities with their sizes; with ``years`` only those partitions are read, sizes being of all."""
        fact = self.spark.read.parquet(self.fact_path)
        if years is not None:
            fact = fact.filter(F.col(self.year).isin(years))
        for entity, sizes in self.sizes(least, edges).items():
            fact = keep_qualifying(fact, sizes, entity)
        return fact
