"""The registered queries of the text operators; each takes its rows from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm import (alignment, decontaminate, exact_dedup, licenses, line_dedup, mixing, quality, render, search, shards, simhash,
                          substrings, toxicity)
from quayside.llm.oracles import OP1_SQL, OP4_SQL, OP6_SQL, OP12_SQL, OP13_SQL
from quayside.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


@_query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(t: Tables) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(t.documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op2_html_text")
def op2_html_text(t: Tables) -> DataFrame:
    return render.visible_text(t.pages)


@_query("op3_quality_classifier")
def op3_quality_classifier(t: Tables) -> DataFrame:
    return quality.score_documents(t.documents, quality.fit(t.documents, t.labels))


@_query("op4_license_scan", OP4_SQL)
def op4_license_scan(t: Tables) -> DataFrame:
    return licenses.license_labels(t.documents)


@_query("op5_sharding")
def op5_sharding(t: Tables) -> DataFrame:
    return shards.digest(shards.assign_shards(t.documents, 8))


@_query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(t: Tables) -> DataFrame:
    return exact_dedup.exact_groups(t.documents)


@_query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(t: Tables) -> DataFrame:
    classes = simhash.near_duplicate_classes(t.documents, shingle=3, radius=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op8_benchmark_decontamination")
def op8_benchmark_decontamination(t: Tables) -> DataFrame:
    return decontaminate.contaminations(t.documents, t.benchmark)


@_query("op9_toxicity")
def op9_toxicity(t: Tables) -> DataFrame:
    return toxicity.score_documents(t.documents, toxicity.fit(t.documents, t.labels))


@_query("op10_source_mix")
def op10_source_mix(t: Tables) -> DataFrame:
    return mixing.mix(t.documents).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(t: Tables) -> DataFrame:
    return alignment.align(t.documents)


@_query("op12_lexical_search", OP12_SQL)
def op12_lexical_search(t: Tables) -> DataFrame:
    return search.search(t.documents, t.benchmark)


@_query("op13_substring_dedup", OP13_SQL)
def op13_substring_dedup(t: Tables) -> DataFrame:
    kept = substrings.drop_repeated_passages(t.documents)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
