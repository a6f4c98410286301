"""Line deduplication: range-partitioned line hashes, streamed in order, give keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quayside.llm.common import body, content_key
from quayside.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"

# What the streaming pass says of a row: its line goes; it depends on the partition before
# (the line opens the partition); it names the document that opens the partition's last key.
DROP, OPENS, CLOSES = 0, 1, 2
FOUND_SCHEMA = "doc_id long, no_id boolean, t1 long, t2 long, pos int, said int, h1 long, h2 long"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted rows (key, document, position), read once, in order.

    Within a key the first document owns the line; rows of later documents go. What opens
    the range may continue the key of the range before, so rows of its first document are
    passed on as ``OPENS``, and the owner of the last key as ``CLOSES``.
    """
    first_key, owner, last = None, None, None  # (h1, h2), (doc, no_id), (h1, h2)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, doc, none = (_numbers(batch, c) for c in ("h1", "h2", "doc_id", "no_id"))
        starts = np.empty(n, bool)
        starts[0] = last is None or (h1[0], h2[0]) != last
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if first_key is None:
            first_key = (h1[0], h2[0])
        group = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        old = group < 0
        owner_doc, owner_none = doc[group], none[group]
        if owner is not None:
            owner_doc, owner_none = np.where(old, owner[0], owner_doc), np.where(old, owner[1], owner_none)
        owned = (doc == owner_doc) & (none == owner_none)
        opening = (h1 == first_key[0]) & (h2 == first_key[1])
        said = np.where(owned, OPENS, DROP).astype(np.int32)
        leave = ~owned | opening
        owner, last = (owner_doc[-1], owner_none[-1]), (h1[-1], h2[-1])
        if leave.any():
            picked = batch.filter(pa.array(leave))
            yield pa.RecordBatch.from_arrays(
                [picked.column(c) for c in ("doc_id", "no_id", "t1", "t2", "pos")]
                + [pa.array(said[leave]), picked.column("h1"), picked.column("h2")],
                ["doc_id", "no_id", "t1", "t2", "pos", "said", "h1", "h2"])
    if last is not None:
        row = [owner[0], bool(owner[1]), 0, 0, -1, CLOSES, *last]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)],
                                         ["doc_id", "no_id", "t1", "t2", "pos", "said", "h1", "h2"])


def _resolve(found: DataFrame) -> DataFrame:
    """Rows that open a range go too if an earlier range closes with the same key and a smaller document.

    Two rows or one line of one document per range take part, not the rows of a key.
    """
    owner = F.struct("no_id", "doc_id")
    opens = found.filter(F.col("said") == OPENS)
    owners = found.filter(F.col("said") != DROP).groupBy("h1", "h2").agg(F.min(owner).alias("owner"))
    late = opens.join(owners, ["h1", "h2"]).filter(owner > F.col("owner"))
    columns = ["doc_id", "no_id", "t1", "t2", "pos"]
    return found.filter(F.col("said") == DROP).select(*columns).unionAll(late.select(*columns))


@F.pandas_udf(T.BinaryType())
def pack_bitmap(n_lines, dropped):
    """A zlib-compressed bitmap, a bit per line, 1 for the lines that stay."""
    import pandas as pd

    def pack(n, gone):
        bits = np.ones(n, np.uint8)
        bits[np.asarray(gone, np.int64)] = 0
        return zlib.compress(np.packbits(bits).tobytes(), 1)
    return pd.Series([pack(n, gone) for n, gone in zip(n_lines, dropped, strict=True)])


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The kept lines as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``(doc_id, t1, t2, n_lines, n_dropped, keep)`` for every document and text.

    Lines whose key (:func:`line_key`) has at least ``least`` code points and is found in
    two documents or more stay only in the document with the smallest id. ``keep`` is a
    compressed bitmap over the lines of the text; texts themselves are not moved. ``t1``
    and ``t2`` are the text's hashes, for the case that an id comes with several texts.

    The rows ``(key hash, document, position)`` are range-partitioned on all three, so a
    line that a third of all documents share is spread over many ranges; each range is
    read once in order. Repeated lines within a document are one decision each. Null texts
    are one empty line. Null ids are one document after all others. Repeated rows of an id
    and text share one result row. An empty table gives an empty result; other columns of
    ``docs`` are not read.
    """
    text = body(text_col)
    per_doc = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
                          *(h.alias(n) for h, n in zip(content_key(text), ("t1", "t2"), strict=True)),
                          F.split(text, "\n", -1).alias("lines"))
    # long lines become keys one at a time, after the explode; a line too short to count is left out here
    lines = per_doc.select("doc_id", "no_id", "t1", "t2", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line")))
    long_enough = F.length("key") >= least
    hashes = [F.when(long_enough, h) for h in content_key(F.col("key"))]
    table = settle(keyed.filter(long_enough | (F.col("pos") == 0)).select(
        "doc_id", "no_id", "t1", "t2", "n_lines", "pos", *(h.alias(n) for h, n in zip(hashes, ("h1", "h2"), strict=True))), "lines")
    order = ["h1", "h2", "no_id", "doc_id", "pos"]
    ranged = table.filter(F.col("h1").isNotNull()).select("doc_id", "no_id", "t1", "t2", "pos", "h1", "h2") \
        .repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle(ranged.mapInArrow(_stream, FOUND_SCHEMA), "found")
    dropped = _resolve(found).select("doc_id", "no_id", "t1", "t2", "pos", F.lit(None).cast("int").alias("n_lines"))
    # every document has a row for its first line, which brings the number of lines
    headers = table.filter(F.col("pos") == 0).select("doc_id", "no_id", "t1", "t2", F.lit(None).cast("int").alias("pos"), "n_lines")
    per_text = dropped.unionAll(headers).groupBy("doc_id", "no_id", "t1", "t2").agg(
        F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return per_text.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "t1", "t2", F.col("n_lines").cast("long").alias("n_lines"),
                           F.size("gone").cast("long").alias("n_dropped"), pack_bitmap("n_lines", "gone").alias("keep"))


@F.pandas_udf(T.StringType())
def apply_bitmap(text, n_lines, bitmap):
    """The kept lines of each text, joined again."""
    import pandas as pd

    def kept(t, n, bits):
        keep = unpack_bitmap(bits, n)
        return t if keep.all() else "\n".join([line for line, stays in zip(t.split("\n"), keep, strict=True) if stays])
    return pd.Series([kept(*row) for row in zip(text, n_lines, bitmap, strict=True)])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: every row with the lines that stay; see :func:`keep_bitmaps`."""
    maps = settle(keep_bitmaps(docs, id_col, text_col, least), "bitmaps").withColumnRenamed("doc_id", "map_id")
    text = body(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    joined = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("map_id")) & (F.xxhash64("text") == F.col("t1"))
                       & (F.xxhash64(F.lit(7), F.col("text")) == F.col("t2")))
    return joined.select("doc_id", "n_lines", "n_dropped",
                         F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(apply_bitmap("text", "n_lines", "keep")).alias("text"))
