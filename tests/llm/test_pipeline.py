"""The pipeline: each stage on what the one before kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import decontaminate, mixing, simhash, toxicity
from quayside.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.samples import AWKWARD, SCHEMA, clashing, docs


def test_stages(spark, data, tmp_path):
    at = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = at.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, data).write.parquet(str(tmp_path / str(i)))
        before, at = at, spark.read.parquet(str(tmp_path / str(i)))
        kept.append((before, at))
        if i < 4:
            assert at.columns == columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(kept[0][0], labels)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(kept[0][0], model).collect()}
    assert {r.doc_id for r in kept[0][1].collect()} == {i for i, s in scores.items() if s < 0.5}
    classes = simhash.near_duplicate_classes(kept[1][0]).collect()
    assert Counter(r.doc_id for r in kept[1][1].collect()) == Counter({r.component_id for r in classes})
    found = {r.doc_id for r in decontaminate.contaminations(kept[2][0], spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in kept[2][1].collect()} == {r.doc_id for r in kept[2][0].collect()} - found
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(kept[3][0]).collect()})
    assert Counter(r.doc_id for r in kept[3][1].collect()) == +copies
    final = kept[4][1]
    assert Counter(r.doc_id for r in final.collect()) == +copies
    slots = final.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots)


def test_stages_take_awkward_documents(spark, data):
    at = clashing(docs(spark, AWKWARD, [None, None, *range(len(AWKWARD) - 4), 3, 3], [None] * 3 + ["a"] * (len(AWKWARD) - 3)))
    for df in (at, spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, data).count() <= 4 * len(AWKWARD)


def test_queries_with_sql(spark, data):
    con = connect(data)
    for name, sql in ORACLES.items():
        assert differences(QUERIES[name](spark, data), con, sql) is None
