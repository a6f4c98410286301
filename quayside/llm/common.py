"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def body(col: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def private(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``, whatever the case of its columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def content_key(col: Column) -> list[Column]:
    """128 bits that stand for a text: two 64-bit hashes of independent seeds."""
    return [F.xxhash64(col), F.xxhash64(F.lit(7), col)]


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def rows_of(batches: Iterable[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of few rows, so that long texts are not unpacked all at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def text_function(fn: Callable[[list[bytes]], list], returns: str, kind: pa.DataType, most: int = 256) -> Callable[[Column], Column]:
    """A column function of whole texts from ``fn``, which gets the UTF-8 of few texts at a time.

    Texts stay in their Arrow buffer but for ``most`` of them, so a worker's memory does
    not grow with the rows of a batch.
    """
    @F.arrow_udf(returns)
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array(fn(texts.slice(at, most).to_pylist()), kind) for at in range(0, len(texts), most)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)
    return lambda text: run(text.cast("binary"))


def once_each(docs: DataFrame, kept: DataFrame, key: list[str], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names, one for each of its rows, with the columns of ``docs``.

    ``key`` has the columns of ``kept`` for id, both hashes of the text, and how many rows of
    ``docs`` have them. The narrow side is what is held in memory, partition by partition,
    and rows with their texts stream past it; only rows that repeat id and text, if there
    are any, are compared among themselves.
    """
    i, t1, t2, n = key
    mine = content_key(body(text_col))

    def rows_for(part: DataFrame) -> DataFrame:
        side = part.hint("shuffle_hash")
        return docs.join(side, docs[id_col].eqNullSafe(side[i]) & (mine[0] == side[t1]) & (mine[1] == side[t2]))
    once, repeated = rows_for(kept.filter(F.col(n) == 1)), kept.filter(F.col(n) > 1)
    if not repeated.isEmpty():
        once = once.unionAll(rows_for(repeated).dropDuplicates([i, t1, t2]))
    return once.drop(*key)
