"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import body, held_out
from quayside.session import settle

# Labelled rows that a classifier is fitted on, at most.
MOST_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled documents that are not held out.

    The documents with the smallest hash of their id are taken, so the sample does not
    depend on partitioning. Their ids, at most ``most`` rows of a written table, meet the
    documents in one join, and the sample is written once for all passes of a fit. Rows with
    a null id or label do not count; several labels of one id count as the largest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "drawn").withColumnRenamed("doc_id", "drawn_id")
    texts = docs.select(F.col("doc_id"), body().cast("binary").alias("text")).join(drawn, F.col("doc_id") == F.col("drawn_id"))
    return settle(texts.select("text", "label"), "labelled")
