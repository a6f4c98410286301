"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quayside.llm.common import body, content_key, once_each, private, text_function
from quayside.llm.components import components
from quayside.session import settle

BITS, SEED = 64, 42
EDGE_SCHEMA = "a long, b long"


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The SimHash of a word sequence: a bit is 1 if over half of the shingle hashes have it.

    Shingles are counted as often as they occur. A sequence shorter than a shingle is one
    shingle; an empty one has the fingerprint 0.
    """
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[len(words) - n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        part = [digest(line[s:e], SEED) for s, e in zip(starts[at:at + 65_536], ends[at:at + 65_536], strict=True)]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int) -> Column:
    """SimHash as a signed long. Words are what stands between ASCII blanks, A-Z in lower case."""
    return text_function(lambda texts: [fingerprint(t.lower().split(), shingle) for t in texts], "long", pa.int64())(text)


def covering_masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks such that two fingerprints at ``radius`` or fewer
    differing bits agree under at least one of them.

    Each bit position gets a vector of ``radius + 1`` bits, dealt round robin; mask ``v``
    keeps the positions whose vector has an odd product with ``v``. The vectors of
    ``radius`` differing positions cannot span all dimensions, so some ``v`` is orthogonal
    to all of them and its mask keeps none of these positions. For radius 3 there are 15
    masks of 32 bits each.
    """
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if (i % size & v).bit_count() % 2) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def refining_masks(mask: int, radius: int, largest: int) -> list[int]:
    """Masks for the members of one overfull bucket, which agree on the bits of ``mask``.

    The other bits are cut into blocks; each refining mask leaves ``radius`` blocks out, and
    two members differ in at most ``radius`` blocks, so they agree under some mask. At most
    ``log2(largest)`` bits are left out, hence no refined bucket can hold more than
    ``largest`` different fingerprints.
    """
    free = [i for i in range(BITS) if not mask >> i & 1]
    width = max(1, (largest.bit_length() - 1) // radius)
    blocks = [free[i:i + width] for i in range(0, len(free), width)]
    everything = (1 << BITS) - 1
    return [everything ^ sum(1 << i for block in chosen for i in block) for chosen in combinations(blocks, min(radius, len(blocks)))]


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever links of at most ``radius`` bits connect among the members."""
    left, edges = np.arange(1, len(members)), []
    front = np.zeros(1, int)
    while len(left):  # breadth first: each member is reached once
        reached = []
        for at in front:
            near = np.bitwise_count(members[left] ^ members[at]) <= radius
            edges += [(members[at], m) for m in members[left[near]]]
            reached.append(left[near])
            left = left[~near]
        front = np.concatenate(reached)
        if not len(front) and len(left):
            front, left = left[:1], left[1:]
    return edges


def _link(radius: int):
    """Buckets, each a bounded list of fingerprints, to the links of a spanning forest."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            flat = flat if len(flat) == ends[-1] - ends[0] else flat[ends[0]:ends[-1]]
            ends = ends - ends[0]
            sizes = np.diff(ends)
            two = ends[:-1][sizes == 2]  # nearly all buckets
            near = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= radius]
            a, b = [flat[near]], [flat[near + 1]]
            for k in np.flatnonzero(sizes > 2):
                edges = np.array(_forest(flat[ends[k]:ends[k + 1]], radius), np.uint64).reshape(-1, 2)
                a.append(edges[:, 0])
                b.append(edges[:, 1])
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])
    return run


def _keys(masks: list[int]) -> Column:
    """One key per mask, as ``table`` and ``key``."""
    return F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("table", "key")


def links(prints: DataFrame, radius: int = 3, largest: int = 4096) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of the distinct
    ``fingerprint`` values at ``radius`` or fewer differing bits.

    Every value gets a key per covering mask, so each such pair shares a bucket. A bucket
    of up to ``largest`` values is searched in one piece and yields a spanning forest, not
    all pairs. The members of a larger bucket are dealt again under refining masks, whose
    buckets cannot exceed ``largest``: no bucket is cut off and none is unbounded.
    """
    masks = covering_masks(radius)
    keyed = settle(prints.select("fingerprint", _keys(masks)), "keys")
    sizes = settle(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    members = keyed.join(sizes, ["table", "key"])
    whole = members.filter(F.col("n") <= largest).groupBy("table", "key").agg(F.collect_list("fingerprint").alias("members"))
    buckets = whole.select("members")
    for (table,) in sizes.filter(F.col("n") > largest).select("table").distinct().collect():  # at most one row per mask
        crowded = members.filter((F.col("n") > largest) & (F.col("table") == table))
        fine = crowded.select(F.col("key").alias("bucket"), "fingerprint") \
            .select("bucket", "fingerprint", _keys(refining_masks(masks[table], radius, largest))) \
            .groupBy("bucket", "table", "key").agg(F.collect_list("fingerprint").alias("members"))
        buckets = buckets.unionAll(fine.filter(F.size("members") > 1).select("members"))
    return buckets.mapInArrow(_link(radius), EDGE_SCHEMA).distinct()


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
                           text_col: str = "text", largest: int = 4096) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for every row of ``docs``.

    Documents are linked when their SimHash fingerprints differ in ``radius`` bits or
    fewer; ``component_id`` is the smallest id that links reach, the own one included.
    Equal fingerprints become one value before any bucket is built. Null texts are empty,
    and empty texts have the fingerprint 0, which links like any other. A null id is never
    the smallest unless all ids of the component are null. Repeated rows are repeated in
    the result; an empty table gives an empty one; other columns are not read.
    """
    prints = settle(docs.select(F.col(id_col).alias("doc_id"), fingerprints(body(text_col), shingle).alias("fingerprint")), "prints")
    placed = _rooted(prints, radius, largest)
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(placed.select("fingerprint", "root").join(first, "root").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(prints: DataFrame, radius: int, largest: int) -> DataFrame:
    """``(fingerprint, first_id, root)`` of the different fingerprints: the smallest id they come
    with, null only if there is no other, and the smallest fingerprint that links reach."""
    distinct = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, radius, largest))
    return distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left") \
        .withColumn("root", F.coalesce("root", "fingerprint"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id",
                         text_col: str = "text", largest: int = 4096) -> DataFrame:
    """``docs`` with one row of each component of linked fingerprints, all columns kept.

    Components are those of the fingerprints, whatever the ids: rows without an id, or with
    one id for several texts, stay apart unless their texts are linked. The row with the
    smallest id stays, a null one only if the component has no other; of several texts with
    that id the one with the smallest fingerprint, then hash; of rows that repeat id and
    text any one. Null texts are empty; an empty table gives an empty result.

    What stays is settled on narrow rows: id, hashes of the text and fingerprint. Texts are
    fingerprinted once and move once, past the kept keys of their partition.
    """
    text = body(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), *(h.alias(n) for h, n in zip(content_key(text), ("t1", "t2"), strict=True)),
                         fingerprints(text, shingle).alias("fingerprint"))
    prints = settle(narrow, "prints")
    placed = settle(_rooted(prints, radius, largest).select("fingerprint", "root"), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint", "t1", "t2")
    best = prints.join(placed, "fingerprint").groupBy("root").agg(F.min(order).alias("kept"))
    key = private(docs, "kept_id", "kept_t1", "kept_t2", "kept_rows")
    kept = best.select(*(F.col(f"kept.{c}").alias(k) for c, k in zip(("doc_id", "t1", "t2"), key, strict=False)))
    rows = prints.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias(key[3]))
    same_row = kept[key[0]].eqNullSafe(rows["doc_id"]) & (kept[key[1]] == rows["t1"]) & (kept[key[2]] == rows["t2"])
    kept = settle(kept.join(rows, same_row).select(*key), "kept")
    return once_each(docs, kept, key, id_col, text_col)
