"""Shards of near equal bytes: the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from quayside.llm.common import body
from quayside.session import settle

# Hex digits of a group's key that the first summary tells apart, and that each refinement adds.
FIRST_DIGITS, MORE_DIGITS = 3, 2


@dataclass
class Node:
    """Consecutive groups under one key prefix; a node of one group cannot be cut."""

    prefix: str
    first: str
    size: int
    largest: int
    groups: int


def _greedy(ends: list[int], largest: list[int], capacity: int, shards: int, fluid: list[bool] | None = None) -> list[int] | None:
    """Where each shard ends if every one takes as much as ``capacity`` allows; None if they cannot hold all.

    Cuts are at the ends of nodes; with ``fluid``, nodes marked so may also be cut inside.
    """
    total, start, at, cuts = ends[-1], 0, 0, []
    if max(largest) > capacity:
        return None
    for _ in range(shards):
        limit, reached = start + capacity, start
        while at < len(ends) and ends[at] <= limit:
            reached = ends[at]
            at += 1
        if at < len(ends) and fluid and fluid[at]:
            reached = limit
        start = reached
        cuts.append(min(reached, total))
    return cuts if cuts[-1] >= total else None


def _least(feasible, low: int, high: int) -> int:
    """Binary search for the smallest capacity that is feasible."""
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def _summary(groups: DataFrame, digits: int, within: list[Node] | None = None) -> list[Node]:
    """Groups summed by the first ``digits`` of their key, all or those under some nodes."""
    if within:
        length = len(within[0].prefix)
        groups = groups.filter(F.left("key", F.lit(length)).isin([n.prefix for n in within]))
    rows = groups.groupBy(F.left("key", F.lit(digits)).alias("prefix")).agg(
        F.min("key").alias("first"), F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"))
    return [Node(*row) for row in rows.orderBy("prefix").collect()]  # 16 ** FIRST_DIGITS rows, or 16 ** MORE_DIGITS per node


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity with which ``shards`` contiguous runs of the groups
    ``(key, size)``, ordered by their 32-digit key, hold everything; and the first key of each shard but the first.

    Groups stay distributed. The driver holds sums by key prefix: a binary search over the
    capacity checks greedily, once with prefixes as whole pieces (an upper bound) and once
    with prefixes that may be cut anywhere (a lower bound). Only prefixes that a cut may
    fall into between both bounds are split by further digits, until all of these are
    single groups; then both bounds are the answer. Among the partitions of this capacity
    the cuts are moved, from the last to the first, towards equal shares of what is left.
    """
    nodes = _summary(groups, FIRST_DIGITS)
    if not nodes:
        return 0, []
    while True:
        ends, total = [], 0
        for node in nodes:
            total += node.size
            ends.append(total)
        whole, parts, fluid = [n.size for n in nodes], [n.largest for n in nodes], [n.groups > 1 for n in nodes]
        floor = max(max(parts), -(-total // shards))
        low = _least(lambda c: _greedy(ends, parts, c, shards, fluid) is not None, floor, total)
        high = _least(lambda c: _greedy(ends, whole, c, shards) is not None, low, total)
        reach = _greedy(ends, parts, high, shards, fluid)
        near, start = [], 0
        for i in range(shards - 1):  # a cut of any capacity in between lies between these two
            start = max((e for e in ends if e <= start + low), default=0)
            near.append((start, reach[i]))
        open_nodes = [n for n, end in zip(nodes, ends, strict=True)
                      if n.groups > 1 and any(end > a and end - n.size < b for a, b in near)]
        if low == high and _greedy(ends, whole, high, shards) == reach or not open_nodes:
            return high, _balanced(nodes, ends, _greedy(ends, whole, high, shards), high)
        length = min(len(n.prefix) for n in open_nodes)
        open_nodes = [n for n in open_nodes if len(n.prefix) == length]
        split = {n.prefix for n in open_nodes}
        finer = _summary(groups, length + MORE_DIGITS, open_nodes)
        nodes = sorted([n for n in nodes if n.prefix not in split] + finer, key=lambda n: n.first)


def _balanced(nodes: list[Node], ends: list[int], reach: list[int], capacity: int) -> list[str]:
    """First keys of the shards but the first. ``reach`` has the furthest cuts of the capacity."""
    bounds, cuts = [0, *ends], [ends[-1]]
    for i in range(len(reach) - 1, 0, -1):
        after, furthest = cuts[0], reach[i - 1]
        target = after * i / (i + 1)
        allowed = [b for b in bounds if after - capacity <= b <= furthest]
        filled = [b for b in allowed if b < after]
        cuts.insert(0, min(filled or allowed, key=lambda b: abs(b - target)))
    starts = {end - n.size: n.first for n, end in zip(nodes, ends, strict=True)}
    return [starts.get(cut, "g") for cut in cuts[:-1]]  # "g" is above every hex digit: nothing follows


def shard_of(key: Column, cuts: list[str]) -> Column:
    """How many shards start at or before the key."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (key >= cut).cast("int")
    return out


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, text_md5, shard, slot)``, a row for every row of ``docs``.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty. Rows with
    equal texts are one group and share a shard; groups are ordered by the MD5 of their
    text, so one text that a third of all rows have is one summed size, and a shard is a
    comparison with a few keys, without a join. ``slot`` numbers the rows of a shard from 0
    without gaps, in the order of a hash of id and text: rows are numbered within 4,096
    pieces of each shard and shifted by the rows of the pieces before. Null ids share the
    hash of a null id and their text; repeated rows get a slot each. An empty table gives
    an empty result; other columns are not read. Only built-in functions run.
    """
    text = body(text_col)
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5")), "sizes")
    groups = settle(rows.groupBy(F.col("text_md5").alias("key")).agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    order = F.xxhash64("doc_id", "text_md5")
    placed = rows.withColumn("shard", shard_of(F.col("text_md5"), cuts)).withColumn("order", order) \
        .withColumn("piece", F.shiftrightunsigned("order", 52))
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    # at most 4,096 rows per shard
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "piece").orderBy("order", "doc_id", "text_md5")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["shard", "piece"])
    return numbered.select("doc_id", "size", "text_crc32", "text_md5", F.col("shard").cast(T.IntegerType()).alias("shard"),
                           (F.col("offset") + F.col("at")).cast("long").alias("slot"))


def digest(assigned: DataFrame) -> DataFrame:
    """The columns by which a shard plan is compared."""
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                           F.lit(None).cast("int").alias("grown_shard"), "text_md5")
