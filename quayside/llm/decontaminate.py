"""Benchmark decontamination: item-sized SimHash windows, Hamming blocks, exact shingle similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import body, rows_of, text_function

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
# Items that one pass over the documents compares with; further items take further passes.
ITEMS_PER_PASS = 5_000

FOUND_SCHEMA = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"

# Every ASCII character but letters and digits parts words; A-Z in lower case.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _word_bits(word: bytes) -> np.ndarray:
    """+1 or -1 for each bit of the word's hash."""
    value = np.array([xxhash.xxh64_intdigest(word, 1)], ">u8").view(np.uint8)
    return np.unpackbits(value).astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def shingles(found: list) -> Counter:
    """Word shingles with their weights, the number of times they occur; short texts are one shingle."""
    size = min(SHINGLE, len(found))
    return Counter(tuple(found[i:i + size]) for i in range(len(found) - size + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: shared weight over total weight."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class Index:
    """What a pass looks documents up in: the items' vocabulary, shingles, and fingerprints by Hamming block."""

    ids: list[int]
    items: list[list[bytes]]
    radius: int = RADIUS
    least: float = SIMILARITY
    vocabulary: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        vocabulary: dict[bytes, int] = {}
        self.coded = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in item] for item in self.items]
        self.vocabulary = vocabulary
        self.bits = np.zeros((len(vocabulary) + 1, 64), np.int8)  # row 0: a word of no item
        for w, i in vocabulary.items():
            self.bits[i] = _word_bits(w)
        self.weights = [shingles(c) for c in self.coded]
        self.prints = np.array([_prints(self.bits[c].sum(axis=0, dtype=np.int32)[None])[0] for c in self.coded], np.uint64)
        # radius + 1 blocks of the fingerprint: within the radius, at least one block agrees
        edges = np.linspace(0, 64, self.radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables: list[dict[tuple[int, int], list[int]]] = [defaultdict(list) for _ in self.blocks]
        for i, (p, c) in enumerate(zip(self.prints, self.coded, strict=True)):
            for table, (shift, mask) in zip(self.tables, self.blocks, strict=True):
                table[len(c), int(p >> shift & mask)].append(i)
        # a window that is similar to an item holds at least one shingle of it
        owners = defaultdict(set)
        for i, c in enumerate(self.coded):
            size = min(SHINGLE, len(c))
            for at in range(len(c) - size + 1):
                owners[size, self._code(np.array(c[at:at + size], np.uint64)[None])[0]].add((len(c), at))
        self.sizes = sorted({s for s, _ in owners})
        self.anchors = {s: np.array(sorted(k for t, k in owners if t == s), np.uint64) for s in self.sizes}
        self.places = {(s, int(k)): sorted({n for n, _ in v}) for (s, k), v in owners.items()}

    @staticmethod
    def _code(columns: np.ndarray) -> np.ndarray:
        """Rows of word numbers as one number each."""
        out = np.zeros(len(columns), np.uint64)
        for column in columns.T:
            out = out * np.uint64(0x9E3779B97F4A7C15) + column
        return out

    def windows(self, coded: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows to fingerprint, by item size: those that hold a shingle of an item of that size."""
        starts = defaultdict(list)
        known = coded > 0
        for size in self.sizes:
            if len(coded) < size:
                continue
            run = np.convolve(known, np.ones(size, np.int64), "valid") == size if size > 1 else known
            at = np.flatnonzero(run)
            if not len(at):
                continue
            codes = self._code(np.stack([coded[at + i] for i in range(size)], axis=1))
            anchors = self.anchors[size]
            hit = anchors[np.minimum(np.searchsorted(anchors, codes), len(anchors) - 1)] == codes
            for p, code in zip(at[hit].tolist(), codes[hit].tolist(), strict=True):
                for n in self.places[size, code]:
                    low, high = max(0, p + size - n), min(p, max(0, len(coded) - n))
                    starts[n].append((low, max(low, high)))
        out = {}
        for n, ranges in starts.items():
            marks = np.zeros(len(coded) + 2, np.int32)
            for low, high in ranges:
                marks[low] += 1
                marks[high + 1] -= 1
            out[n] = np.flatnonzero(np.cumsum(marks)[:len(coded)] > 0)
        return out

    def search(self, text: bytes) -> dict[int, tuple[float, int, int, int]]:
        """For each item found: the best similarity, the Hamming distance, the window's start and length."""
        found = words(text)
        coded = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        best: dict[int, tuple[float, int, int, int]] = {}
        for n, starts in self.windows(coded.astype(np.uint64)).items():
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):  # windows far apart are looked up apart
                for begin in range(0, len(run), 4096):
                    self._look_up(found, coded, n, run[begin:begin + 4096], best)
        return best

    def _look_up(self, found, coded, n, starts, best):
        low, high = int(starts[0]), min(int(starts[-1]) + n, len(coded))
        part = self.bits[coded[low:high]].astype(np.int32)
        for i in np.flatnonzero(coded[low:high] == 0):
            part[i] = _word_bits(found[low + i])
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(part, axis=0, out=sums[1:])
        ends = np.minimum(starts + n, len(coded))
        prints = _prints(sums[ends - low] - sums[starts - low])
        for start, end, p in zip(starts.tolist(), ends.tolist(), prints, strict=True):
            near = {i for table, (shift, mask) in zip(self.tables, self.blocks, strict=True) for i in table.get((n, int(p >> shift & mask)), ())}
            weights = None
            for i in near:
                distance = int(p ^ self.prints[i]).bit_count()
                if distance > self.radius:
                    continue
                if weights is None:  # words of no item are told apart by themselves
                    weights = shingles([c or w for c, w in zip(coded[start:end].tolist(), found[start:end], strict=True)])
                got = similarity(weights, self.weights[i])
                if got >= self.least and (i not in best or (-got, start) < (-best[i][0], best[i][2])):
                    best[i] = (got, distance, start, end - start)


def _passes(benchmark: DataFrame, per_pass: int, radius: int, least: float) -> Iterator[Index]:
    """The items as indexes of at most ``per_pass`` items each."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    n = items.count()
    parts = -(-n // per_pass)
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        kept = [(i, words(t.encode())) for i, t in part.orderBy("item_id", "text").collect()]
        kept = [(i, w) for i, w in kept if w]
        if kept:
            yield Index([i for i, _ in kept], [w for _, w in kept], radius, least)


def contaminations(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY,
                   per_pass: int = ITEMS_PER_PASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, distance, first_word, n_words)``: a row per document and benchmark item it holds.

    A window of an item's number of words slides over the text. Its SimHash over words is
    looked up in the items' fingerprints by ``radius + 1`` blocks, which miss none within
    ``radius`` bits; candidates are verified by the similarity of their five-word shingles,
    weighted by how often they occur, ``least`` or more. Only windows that share a shingle
    with an item of their size are fingerprinted, since others cannot be similar. Reported
    is the best window, the first of equals.

    Documents are read in one pass per ``per_pass`` items and never shuffled. Texts shorter
    than an item are one window; items under five words are one shingle. Null, empty and
    wordless texts and items match nothing; an item id with several texts counts with each;
    null ids and repeated rows give rows of their own. Empty tables give an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text"))
    out = None
    for index in _passes(benchmark, per_pass, radius, least):
        def scan(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            for batch in rows_of(batches):
                hits = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    best = {}
                    for i, (got, *rest) in index.search(text).items():
                        key = index.ids[i]
                        best[key] = max(best.get(key, (-1,)), (got, *rest))
                    hits += [(doc, key, *row) for key, row in best.items()]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), types, strict=True)], names)
        part = rows.mapInArrow(scan, FOUND_SCHEMA)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], FOUND_SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY,
                      per_pass: int = ITEMS_PER_PASS, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (see :func:`contaminations`), all columns kept, nothing shuffled."""
    for index in _passes(benchmark, per_pass, radius, least):
        docs = docs.filter(_clean_of(index)(body(text_col)))
    return docs


def _clean_of(index: Index):
    """A function that tells which texts hold no item of the index."""
    return text_function(lambda texts: [not index.search(t) for t in texts], "boolean", pa.bool_())
