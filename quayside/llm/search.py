"""Ranked lexical search: accumulators of short lists inside document-at-a-time skipping over long ones."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from quayside.llm.common import body, rows_of
from quayside.session import settle

TOP = 10
# Documents and words of an index block, and bytes of text that are split into words at a time.
BLOCK_DOCS, BLOCK_WORDS, PIECE = 4096, 3_000_000, 1 << 20
# Lists are summed, shortest first, as long as they hold together at most this share of a block's documents.
SHORT_SHARE = 8
# Items that one pass over the index answers, and parts in which the best of an item are found first.
ITEMS_PER_PASS, PARTS = 10_000, 64

BLOCK_SCHEMA = "n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, docs binary, tfs binary"
HIT_SCHEMA = "query int, doc_id long, score long"

# Every ASCII character but letters and digits parts terms; only A-Z in lower case.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    at = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        part = text[at:stop].translate(_TO_TERMS)
        if stop < len(text):
            cut = part.rfind(b" ") + 1
            if cut:
                part, stop = part[:cut], at + cut
            else:  # a term longer than a piece: on to its end
                while stop < len(text) and _TO_TERMS[text[stop]] != 32:
                    stop += 1
                part = text[at:stop].translate(_TO_TERMS)
        yield part.split()
        at = stop


@dataclass
class Queries:
    """The items of one pass: the ids of the items, their terms as numbers, and what number a term has."""

    ids: list
    terms: list[list[int]]
    numbers: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Queries:
        numbers: dict[bytes, int] = {}
        found: dict = {}
        for item, text in rows:
            mine = found.setdefault(item, set())
            for part in terms_of((text or "").encode()):
                mine.update(numbers.setdefault(t, len(numbers)) for t in part)
        return cls(list(found), [sorted(found[i]) for i in found], numbers)


def _index(numbers: dict[bytes, int]):
    """Documents to blocks: postings of the terms that items have, lengths, and how many terms there are in all."""
    def block(ids: list, lengths: list[int], postings: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        owner = np.repeat(place, [len(p) for p in postings])
        keys, tfs = np.unique((np.concatenate(postings) << 32) | owner if postings else np.zeros(0, np.int64), return_counts=True)
        terms, sizes = np.unique(keys >> 32, return_counts=True)
        row = [[sum(n > 0 for n in lengths)], [sum(lengths)], [[ids[i] for i in order]], [[lengths[i] for i in order]], [terms.astype(np.int32)],
               [sizes.astype(np.int32)], [(keys & 0xFFFFFFFF).astype(np.int32).tobytes()], [tfs.astype(np.int32).tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["n_docs", "n_terms", "doc_ids", "lengths", "terms", "sizes", "docs", "tfs"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, postings, held = [], [], [], 0
        for batch in rows_of(batches, 256):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, known = 0, []
                for part in terms_of(text):
                    n += len(part)
                    known.append(np.array([k for k in map(numbers.get, part) if k is not None], np.int64))
                ids.append(doc)
                lengths.append(n)
                postings.append(np.concatenate(known) if known else np.zeros(0, np.int64))
                held += len(postings[-1])
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_WORDS:
                    yield block(ids, lengths, postings)
                    ids, lengths, postings, held = [], [], [], 0
        if ids:
            yield block(ids, lengths, postings)
    return run


class Best:
    """The highest-scoring documents of one query so far; of equal scores those with the smallest id."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def least(self) -> int:
        """A document below this score cannot enter; one at it may, by its id."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -(doc or 0))
        if score > 0 and len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif score > 0 and entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], ids: list, best: Best, n_docs: int) -> None:
    """One query over one block; ``lists`` has the documents, ascending, and the score parts of each term.

    Term at a time: the shortest lists are summed into accumulators, which become one more
    list, bounded by its highest sum. Document at a time: lists are ordered by their bounds;
    those whose bounds together stay under the score that is needed are no source of
    candidates. Candidates come in ascending order from the other lists, and each is looked
    up in the rest, highest bound first, until it is known that it cannot enter. As the
    needed score rises, more lists stop being sources.
    """
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    held, short = 0, 0
    while short < len(lists) and held + len(lists[short][0]) <= max(1, n_docs // SHORT_SHARE):
        held += len(lists[short][0])
        short += 1
    runs = lists[short:]
    if short > 1:
        docs, at = np.unique(np.concatenate([d for d, _ in lists[:short]]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([s for _, s in lists[:short]]))
        runs.append((docs, sums))
    elif short:
        runs.append(lists[0])
    runs = sorted(((int(s.max()), d, s) for d, s in runs), key=lambda r: r[0])
    if not runs:
        return
    # bounds[k]: what the k lists of the smallest bounds can give together
    bounds = np.append(0, np.cumsum([r[0] for r in runs])).tolist()
    docs, scores = [r[1].tolist() for r in runs], [r[2].tolist() for r in runs]
    sources = len(runs)  # all lists from here on up are sources; the first are not
    rest = 0
    while rest < sources and bounds[rest + 1] < best.least():
        rest += 1
    at = [0] * len(runs)
    heads = [(docs[k][0], k) for k in range(rest, len(runs))]
    heapq.heapify(heads)
    while heads:
        doc = heads[0][0]
        total = 0
        while heads and heads[0][0] == doc:
            k = heads[0][1]
            total += scores[k][at[k]]
            at[k] += 1
            if k < rest or at[k] == len(docs[k]):
                heapq.heappop(heads)
            else:
                heapq.heapreplace(heads, (docs[k][at[k]], k))
        need, k = best.least(), rest
        while k and total + bounds[k] >= need:
            k -= 1
            found = bisect_left(docs[k], doc, at[k])
            at[k] = found  # skips what lies before
            if found < len(docs[k]) and docs[k][found] == doc:
                total += scores[k][found]
        if not k and total >= need:
            best.add(total, ids[doc])
            more = rest
            while more < len(runs) and bounds[more + 1] < best.least():
                more += 1
            if more > rest:  # lists that are no longer sources
                heads = [h for h in heads if h[1] >= more]
                heapq.heapify(heads)
                rest = more


def _search(queries: list[list[int]], weights: dict[int, int], n_all: int, n_terms: int, top: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in ("doc_ids", "lengths", "terms", "sizes", "docs", "tfs")}
                ids, lengths = cell["doc_ids"].as_py(), cell["lengths"].values.to_numpy()
                docs, tfs = (np.frombuffer(cell[c].as_py(), np.int32).astype(np.int64) for c in ("docs", "tfs"))
                terms, sizes = (cell[c].values.to_numpy() for c in ("terms", "sizes"))
                share = 10 + (90 * lengths * n_all) // max(n_terms, 1)
                parts = (1_000_000_000 * tfs) // (1000 * tfs + 8 * share[docs])
                parts *= np.repeat([weights[t] for t in terms.tolist()], sizes).astype(np.int64)
                ends = np.cumsum(sizes)
                lists = {t: (docs[e - n:e], parts[e - n:e]) for t, n, e in zip(terms.tolist(), sizes.tolist(), ends.tolist(), strict=True) if weights[t]}
                for mine, found in zip(queries, best, strict=True):
                    search_block([lists[t] for t in mine if t in lists], ids, found, len(ids))
        rows = [(q, -d if known else None, s) for q, found in enumerate(best) for s, known, d in found.heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                         ["query", "doc_id", "score"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _answers(blocks: DataFrame, queries: Queries, top: int) -> DataFrame:
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = blocks.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df"))
    weights = {t: term_weight(n_docs, df) for t, df in counts.collect()}  # at most the terms of the pass's items
    hits = blocks.select("doc_ids", "lengths", "terms", "sizes", "docs", "tfs") \
        .mapInArrow(_search(queries.terms, weights, n_docs, n_terms, top), HIT_SCHEMA)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # the best of an item are found in parts first, so that no task reads what all others found for it
    parted = hits.withColumn("part", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(PARTS)))
    part = parted.withColumn("rank", F.row_number().over(W.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)
    names = blocks.sparkSession.createDataFrame(list(enumerate(queries.ids)), "query int, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, per_pass: int = ITEMS_PER_PASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item by lexical score, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z in
    lower case. Items are queries of all their different terms; several texts of one item
    id are one query. Weights and lengths come from the whole corpus. Texts are read once
    per pass of ``per_pass`` items, into blocks of postings of the pass's terms in the
    shared folder; every block is searched by every item (:func:`search_block`), a task
    keeping the best of all its blocks.

    Null, empty and termless texts have no score; items without terms have no rows.
    Repeated rows and null ids are documents of their own, null ids last among equals. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text"))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts, out = max(1, -(-rows.count() // per_pass)), None
    for k in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        queries = Queries.of([tuple(r) for r in mine.collect()])  # a pass's share of the items
        if queries.numbers:
            blocks = settle(texts.mapInArrow(_index(queries.numbers), BLOCK_SCHEMA), "postings")
            found = _answers(blocks, queries, top)
            out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], T.StructType.fromDDL("item_id long, rank int, doc_id long, score long")) if out is None else out
