"""Mixing sources to target weights by fitting token budgets exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quayside.fixed_values import SEED
from quayside.llm.common import body, content_key, private
from quayside.operators.windows import row_numbers
from quayside.session import settle

MOST_TIMES = 3
# Words left over after the proportional part that the dynamic programme fits.
EXACT_BUDGET = 65_536

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def target_words(sources: DataFrame) -> DataFrame:
    """``sources`` ``(source, source_size)`` with ``weight`` and ``target``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Targets share the sum
    of all sizes by weight; none exceeds three times its source's size, and the excess goes
    to the others by weight until none is above: targets are ``min(3 * size, level *
    weight)``, and the level rises until they add up. The driver sees three sums per round.
    """
    placed = row_numbers(sources, [F.col("source").asc_nulls_last()], "rank")
    weighed = settle(placed.withColumn("weight", (F.col("rank") - 1) % 3 + 1), "weights")
    most = MOST_TIMES * F.col("source_size")
    total, level, capped = None, 0.0, -1
    while True:
        full = most <= level * F.col("weight")
        size, held, n, weight = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        total = size if total is None else total
        if n == capped or not weight:
            break
        capped, level = n, (total - held) / weight
    target = F.when(most <= level * F.col("weight"), most.cast("double")).otherwise(level * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.cast("double").alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, exact: int = EXACT_BUDGET) -> list[int]:
    """How many documents of each length make the sum nearest to ``budget``, as far as this can tell.

    All but ``exact`` words of the budget come from every length by its share of documents,
    rounded down, then from the longest first until at most ``exact`` words are left; a
    bounded-knapsack dynamic programme over the free documents fits the rest, going over it
    if that is nearer. Its table has twice ``exact`` entries whatever the budget.
    """
    total = sum(n * x for n, x in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * max(0, budget - exact) // total for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, taken, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n > 0), key=lambda i: -lengths[i])
    for i in order:
        if left <= exact:
            break
        more = min(counts[i] - taken[i], left // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    if left > exact:  # all free documents are longer than what is left
        free = [i for i in order if taken[i] < counts[i]]
        if free and lengths[free[-1]] < 2 * left:
            taken[free[-1]] += 1
        return taken
    reached, by = np.zeros(2 * left + 1, bool), np.full(2 * left + 1, -1, np.int64)
    reached[0] = True
    for i in order:
        if reached[left]:
            break
        layer, n = reached.copy(), lengths[i]
        for _ in range(counts[i] - taken[i]):  # one more document of this length per layer
            step = np.zeros_like(reached)
            step[n:] = layer[:len(layer) - n] if n < len(layer) else False
            layer = step & ~reached
            if not layer.any():
                break
            reached |= layer
            by[layer] = i
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        taken[by[at]] += 1
        at -= lengths[by[at]]
    return taken


def _plan(rows: pa.Table) -> pa.Table:
    """The documents of one source by length, at most a row per length: whole passes and how many of each length once more."""
    rows = rows.sort_by("size")
    sizes, counts = rows["size"].to_pylist(), rows["n"].to_pylist()
    size, goal = sum(x * n for x, n in zip(sizes, counts, strict=True)), round(rows["target"][0].as_py())
    passes = min(MOST_TIMES, goal // size) if size else 0
    budget = goal - passes * size if passes < MOST_TIMES else 0
    extra = fit_budget(sizes, counts, budget) if size else [0] * len(sizes)
    return pa.table({"s": rows["s"], "no_source": rows["no_source"], "size": rows["size"],
                     "passes": pa.array([passes] * len(sizes), pa.int32()), "extra": pa.array(extra, pa.int64())})


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, t1, t2, size, source_size, target, copies, taken)`` for every row.

    Sizes count words between ASCII blanks. Documents are counted by source and exact
    length; from these counts alone each source is fitted to its target: whole passes over
    the source, then the number of documents of each length that make up the rest
    (:func:`fit_budget`). Which documents of a length are taken follows a seeded hash of id
    and text, so reruns and other partitionings agree. Documents are numbered along one
    sort over all tasks, so neither a length that a third of all rows share nor rows that
    repeat one id and text are a single task.

    Null sources are a source, ordered last. Null and empty texts have size 0 and take part
    in whole passes only. Null ids are told apart by their text; of fully repeated rows any
    may be the taken one. An empty table gives an empty result; other columns are not read.
    """
    text = body(text_col)
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
                              *(h.alias(n) for h, n in zip(content_key(text), ("t1", "t2"), strict=True))), "sizes")
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
    targets = target_words(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = settle(targets.withColumn("no_source", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
                     .drop("source"), "targets")
    key = ["s", "no_source"]
    group = [*key, "size"]
    order = [F.col(c) for c in group] + [F.xxhash64("doc_id", "t1", F.lit(seed)), F.col("doc_id").asc_nulls_last(), F.col("t1"), F.col("t2")]
    ranked = row_numbers(rows, order, "place")
    # a row per source and length: where its documents begin, and how many there are
    lengths = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("begin"))
    lengths = settle(lengths.join(targets.select(*key, "target"), key), "lengths")
    schema = "s string, no_source boolean, size long, passes int, extra long"
    plan = lengths.groupBy(*key).applyInArrow(_plan, schema).join(lengths.select(*group, "begin"), group).join(targets, key)
    chosen = ranked.join(settle(plan, "plan"), group)
    copies = F.col("passes") + (F.col("place") - F.col("begin") < F.col("extra")).cast("int")
    return chosen.select("doc_id", "source", "t1", "t2", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, all columns kept.

    Rows that repeat id, source and text are one document here; it comes as often as all of
    them are taken. How often a document is taken is settled on narrow rows; texts move once.
    """
    i, t1, t2, s, n, k = private(docs, "mix_id", "mix_t1", "mix_t2", "mix_source", "mix_copies", "mix_rows")
    taken = mix(docs, seed, id_col, text_col, source_col).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("t1").alias(t1), F.col("t2").alias(t2)) \
        .agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(k)).filter(F.col(n) > 0)
    taken = settle(taken, "taken")
    h1, h2 = content_key(body(text_col))

    def rows_for(part: DataFrame) -> DataFrame:
        side = part.hint("shuffle_hash")
        return docs.join(side, docs[id_col].eqNullSafe(side[i]) & docs[source_col].eqNullSafe(side[s]) & (h1 == side[t1]) & (h2 == side[t2]))
    once, repeated = rows_for(taken.filter(F.col(k) == 1)), taken.filter(F.col(k) > 1)
    if not repeated.isEmpty():
        once = once.unionAll(rows_for(repeated).dropDuplicates([i, s, t1, t2]))
    times = F.sequence(F.lit(1), F.col(n))
    return once.withColumn(n, F.explode(times)).drop(i, t1, t2, s, n, k)
