"""Exact deduplication: counting quotient filters find what repeats, bytes decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quayside.llm.common import body, private
from quayside.session import settle

# A fingerprint has 64 bits: 12 name the block, 6 the quotient within it, 46 are the remainder.
BLOCK_BITS, QUOTIENT_BITS, REMAINDER_BITS = 12, 6, 46
_BYTES = (REMAINDER_BITS + 7) // 8

FILTER_SCHEMA = "block int, occupied binary, run_ends binary, remainders binary, counts binary"
REPEATED_SCHEMA = "fingerprint long, n_rows long"


def encode(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """One block of a counting quotient filter from sorted distinct fingerprints.

    The slots hold the remainders in order. ``occupied`` has a bit per quotient that owns a
    run of slots, ``run_ends`` a bit per slot that ends a run, so the quotients follow from
    the two bit vectors and only remainders and counts are stored per slot.
    """
    quotients = (fingerprints >> np.uint64(REMAINDER_BITS)) & np.uint64((1 << QUOTIENT_BITS) - 1)
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True)
    remainders = fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)
    low = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
    return (np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), low.tobytes(),
            counts.astype("<u8").tobytes())


def decode(block: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints, in order, and their counts: the inverse of :func:`encode`."""
    numbers = np.frombuffer(counts, "<u8")
    wide = np.zeros((len(numbers), 8), np.uint8)
    wide[:, :_BYTES] = np.frombuffer(remainders, np.uint8).reshape(-1, _BYTES)
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(numbers))
    owners = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    quotients = owners[np.cumsum(ends) - ends].astype(np.uint64)
    high = (np.uint64(block) << np.uint64(QUOTIENT_BITS)) | quotients
    return (high << np.uint64(REMAINDER_BITS)) | wide.view("<u8").ravel(), numbers


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of several filters as one: equal fingerprints add their counts, nothing is lost."""
    prints, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, int)
    return prints[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of one partition, a row for each of its blocks; it holds 8 bytes for each row it read."""
    read = [b.column(0).to_numpy().view(np.uint64) for b in batches]
    prints, counts = np.unique(np.concatenate(read) if read else np.zeros(0, np.uint64), return_counts=True)
    blocks = (prints >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
    starts = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else [], len(blocks)).astype(int)
    rows = [(int(blocks[s]), *encode(prints[s:e], counts[s:e])) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    if rows:
        types = [pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                         ["block", "occupied", "run_ends", "remainders", "counts"])


def _merge_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: slots of a block are merged as they come, and those counted above one leave."""
    def flush(parts):
        prints, counts = merge(parts)
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(prints[often].view(np.int64)), pa.array(counts[often].astype(np.int64))],
                                          ["fingerprint", "n_rows"])
    current, parts = None, []
    for batch in batches:
        for block, *slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != current and parts:
                yield flush(parts)
                parts = []
            current = block
            parts.append(decode(block, *slots))
            if len(parts) >= 256:
                parts = [merge(parts)]
    if parts:
        yield flush(parts)


def repeated_fingerprints(docs: DataFrame, fingerprint: Column) -> DataFrame:
    """``(fingerprint, n_rows)`` of the 64-bit fingerprints that more than one row has.

    Each partition builds a counting quotient filter of its rows; filters travel block by
    block and merge by their sorted remainders. A fingerprint that a third of all rows
    share is one slot with a count in each partition's filter.
    """
    filters = docs.select(fingerprint.alias("fingerprint")).mapInArrow(_build, FILTER_SCHEMA)
    by_block = filters.repartition("block").sortWithinPartitions("block")
    return by_block.mapInArrow(_merge_blocks, REPEATED_SCHEMA)


def _route(repeated: DataFrame, bits: int):
    """A function that tells which fingerprints may be repeated.

    It looks up the first ``bits`` bits of a fingerprint in a bit table of fixed size
    (2 ** bits / 8 bytes, 8 MB by default), whatever the number of repeated fingerprints.
    Dropping bits only lets more texts pass on to the byte check, never fewer.
    """
    slot = F.shiftrightunsigned("fingerprint", 64 - bits) + 1
    words = repeated.groupBy(F.bitmap_bucket_number(slot).alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("word"))
    table = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for bucket, word in words.collect():  # at most 2 ** bits / 32768 rows of 4 KB
        table[bucket - 1] = np.frombuffer(word, np.uint8)
    flat = table.ravel()

    @F.pandas_udf(T.BooleanType())
    def passes(prints):
        import pandas as pd
        at = prints.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((flat[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)
    return passes


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", route_bits: int = 26) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when their bytes are; of equal texts the one with the largest id stays.
    Fingerprints that the merged filters count more than once send their texts to a
    grouping by the bytes themselves, copies of one partition being combined before the
    shuffle; all other rows never move their text. A null text counts as empty. Null ids
    are smaller than any number. Rows that repeat an id and its text count as rows of the
    group and get the same answer; :func:`drop_copies` then leaves one. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    repeated = settle(repeated_fingerprints(rows, F.col("fingerprint")), "repeated")
    suspects = rows.filter(_route(repeated, route_bits)("fingerprint"))
    groups = suspects.groupBy("fingerprint", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups.filter("group_size > 1").select("fingerprint", F.sha2("text", 256).alias("text_sha256"),
                                                           "keep_id", "group_size"), "copies")
    narrow = rows.select("doc_id", "fingerprint", F.sha2("text", 256).alias("text_sha256"))
    joined = narrow.join(groups, ["fingerprint", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per text, the one with the largest id, all columns kept."""
    key, sha = private(docs, "kept_id", "kept_sha")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    mine = F.sha2(body(text_col), 256)
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept[key]) & (mine == kept[sha]))
    return joined.dropDuplicates([key, sha]).drop(key, sha)
