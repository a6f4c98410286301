"""Substring deduplication: windows of words travel as super-k-mers to the bucket of their minimiser."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quayside.fixed_values import SEED
from quayside.llm.common import body, rows_of
from quayside.session import settle

# Words of a window; words of the grams that minimisers are taken from.
WINDOW, GRAM = 20, 3
# Super-k-mers of one bucket that a task compares at a time, and (id, text) pairs a task remembers.
CHUNK, REMEMBERED = 8192, 200_000
# Documents in the sample that tells which buckets are crowded, the share of a partition that
# makes a bucket so, and in how many parts a partition's worth of one is dealt.
CROWD_SAMPLE, CROWD_SHARE, PARTS_EACH = 5_000, 0.1, 4
# Grams whose minimisers are searched at a time, for bounded memory in very long texts.
_STRETCH = 1 << 16
# Texts, and bytes of each, that the packing dictionary is made from; it only changes sizes.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 2000, 65_536

_KEY = ["doc_id", "no_id", "t1"]
KMER_SCHEMA = "bucket long, part int, doc_id long, no_id boolean, t1 long, start int, packed binary"
FOUND_SCHEMA = "doc_id long, no_id boolean, t1 long, first int, last int, h1 long, h2 long"
KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, text string"


def super_kmers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimiser: minimisers, first windows, and windows of each run.

    The minimiser of a window is the leftmost of its grams with the smallest hash. Windows
    belong together while that gram stays in the same place; so the windows of a run are
    all different, and equal windows always have equal minimisers.
    """
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        grams = (grams ^ hashes[i:i + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    width, places = window - gram + 1, []
    for at in range(0, n, _STRETCH):
        part = grams[at:at + _STRETCH + width - 1]
        places.append(at + np.arange(len(part) - width + 1) + np.lib.stride_tricks.sliding_window_view(part, width).argmin(axis=1))
    place = np.concatenate(places)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return grams[place[first]].view(np.int64), first, np.diff(np.append(first, n))


def packing_dictionary(docs: DataFrame, text_col: str) -> bytes | None:
    """A compression dictionary from the beginnings of a few texts. It makes packed strings
    smaller and decides nothing; without enough text there is none."""
    part = F.substring(body(text_col).cast("binary"), 1, SAMPLE_BYTES)
    samples = [bytes(t)[at:at + 200] for (t,) in docs.select(part).limit(SAMPLE_TEXTS).collect() for at in range(0, len(t), 200)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def _codec(dictionary: bytes | None) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _cut(dictionary: bytes | None, window: int, crowded: dict[int, int]):
    """Documents to super-k-mers, each packed as one string; repeated rows of a task are cut once.
    Those of a crowded bucket are dealt over its parts by document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False, write_dict_id=False, **_codec(dictionary)).compress
        seen: set = set()
        for batch in rows_of(batches, 64):
            out: list[list] = [[] for _ in range(7)]
            for doc, none, t1, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, none, t1) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((doc, none, t1))
                words = text.split()
                buckets, first, runs = super_kmers(words, window)
                if not len(first):
                    continue
                line = b" ".join(words)
                stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begin = np.append(0, stops[:-1] + 1)[first].tolist()
                end = stops[first + runs + window - 2].tolist()
                out[0].append(buckets)
                for column, value in zip(out[1:4], (doc, none, t1), strict=True):
                    column.extend([value] * len(first))
                out[4].append(first)
                out[5].extend(pack(line[a:b]) for a, b in zip(begin, end, strict=True))
                place = hash((doc, none, t1))
                out[6].extend(place % crowded[k] if k in crowded else -1 for k in buckets.tolist())
            if out[5]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0])), pa.array(out[6], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                     pa.array(out[3], pa.int64()), pa.array(np.concatenate(out[4]).astype(np.int32)), pa.array(out[5], pa.binary())],
                    ["bucket", "part", *_KEY, "start", "packed"])
    return run


def _count(window: int):
    """How many super-k-mers of a batch have each minimiser."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [super_kmers(t.as_py().split(), window)[0] for t in batch.column(0)]
            buckets, counts = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts)], ["bucket", "n"])
    return run


def crowded_buckets(texts: DataFrame, window: int, partitions: int) -> dict[int, int]:
    """The buckets that hold a good share of a partition or more, and in how many parts to deal each.

    Judged on a sample of documents, as only the load of tasks depends on it. At most
    ``partitions / CROWD_SHARE`` buckets can be crowded.
    """
    n = texts.count()
    sample = texts.select("text") if n <= CROWD_SAMPLE else texts.select("text").sample(CROWD_SAMPLE / n, SEED)
    counts = settle(sample.mapInArrow(_count(window), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1"), "buckets")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(32, CROWD_SHARE * total / partitions)
    return {b: max(2, -(-PARTS_EACH * k * partitions // total)) for b, k in counts.filter(F.col("n") >= least).collect()}


def _windows(text: bytes, window: int) -> Iterator[bytes]:
    """The windows of an unpacked super-k-mer. It has few words: a run ends when its minimiser leaves the window."""
    ends = [0, *accumulate(map(len, text.split(b" ")))]  # without the blanks before them
    return (text[ends[i] + i:ends[i + window] + i + window - 1] for i in range(len(ends) - window))


class _Found:
    """Output rows: words ``first`` to ``last`` of a document go, or, with hashes, the window
    that starts at ``first`` is the earliest of its part of a bucket."""

    def __init__(self):
        self.rows: list[tuple] = []

    def gone(self, row: tuple, first: int, last: int):
        self.rows.append((*row[:3], first, last, None, None))

    def pending(self, row: tuple, first: int, last: int, content: bytes):
        h1, h2 = xxhash.xxh3_64_intdigest(content) - (1 << 63), xxhash.xxh64_intdigest(content, 7) - (1 << 63)
        self.rows.append((*row[:3], first, last, h1, h2))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*_KEY, "first", "last", "h1", "h2"])


def _judge(rows: list[tuple], unpack, window: int, partial: bool, found: _Found) -> None:
    """Super-k-mers of one bucket, or of a part of it, in document order: which of their windows came before.

    Equal strings are settled at once; of the windows of the different ones, all go that an
    earlier one equals. In a part of a bucket (``partial``) the first ones are reported
    too, since other parts may hold earlier ones.
    """
    if len(rows) < 2 and not (rows and partial):
        return
    different, extents = [], {}
    for row in rows:
        packed = row[4]
        if packed in extents:
            found.gone(row, row[3], row[3] + extents[packed])
            continue
        text = unpack(packed)
        extents[packed] = text.count(b" ") + 1
        different.append((row, text))
    if len(different) == 1 and not partial:
        return
    before: set = set()
    for row, text in different:
        start, run = row[3], None  # neighbouring windows become one stretch
        for i, content in enumerate(_windows(text, window), start):
            if content in before:
                run = i if run is None else run
                continue
            before.add(content)
            if run is not None:
                found.gone(row, run, i - 1 + window)
                run = None
            if partial:
                found.pending(row, i, i + window, content)
        if run is not None:
            found.gone(row, run, start + extents[row[4]])


def _search(dictionary: bytes | None, window: int, chunk: int):
    """One partition of the super-k-mers, sorted by bucket, part, document and place, read once.

    A bucket of one string holds nothing to compare. The parts of a crowded bucket, and
    those of a bucket of more than ``chunk`` strings, are judged one by one: their earliest
    windows are reported as pending.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_codec(dictionary)).decompress
        found, held, current, parted, last = _Found(), [], None, False, ()
        for batch in rows_of(batches, chunk):
            places = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", *_KEY, "start")]
            again = np.append(tuple(c[0] for c in places) == last, np.all([c[1:] == c[:-1] for c in places], axis=0))
            last = tuple(c[-1] for c in places)
            once = np.flatnonzero(~again)  # repeated rows count once
            if not len(once):
                continue
            buckets, parts = places[0][once], places[1][once]
            starts = np.flatnonzero(np.append(True, (buckets[1:] != buckets[:-1]) | (parts[1:] != parts[:-1])))
            sizes = np.diff(np.append(starts, len(once)))
            # buckets of one string inside a batch need no look; those at its ends may go on, and parts have others
            look = (sizes > 1) | (starts == 0) | (starts + sizes == len(once)) | (parts[starts] >= 0)
            wanted = batch.take(pa.array(once[np.repeat(look, sizes)]))
            rows = list(zip(*(wanted.column(c).to_pylist() for c in (*_KEY, "start", "packed")), strict=True))
            stops = np.cumsum(sizes[look]).tolist()
            for now, begin, stop in zip(zip(buckets[starts[look]].tolist(), parts[starts[look]].tolist(), strict=True), [0, *stops], stops):
                if now != current:
                    _judge(held, unpack, window, parted, found)
                    held, current, parted = [], now, now[1] >= 0
                while begin < stop:
                    more = rows[begin:min(stop, begin + chunk - len(held))]
                    held.extend(more)
                    begin += len(more)
                    if len(held) >= chunk:
                        _judge(held, unpack, window, True, found)
                        held, parted = [], True
                if len(found.rows) >= 4096:
                    yield found.take()
        _judge(held, unpack, window, parted, found)
        if found.rows:
            yield found.take()
    return run


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row_id, doc_id, no_id, t1, text)``: ids as given, and what names a document. The
    text's hash is part of that only where ids are null or come more than once."""
    text = body(text_col)
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    tie = F.lit(0).cast("long") if rows == ids else F.xxhash64(text)
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("doc_id"),
                       F.col(id_col).isNull().alias("no_id"), tie.alias("t1"), text.cast("binary").alias("text"))


def repeated_stretches(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, no_id, t1, first, last)``: words ``first`` up to ``last`` of a document lie in
    windows whose words also start earlier, in a smaller document or further up in the same.

    Consecutive windows with one minimiser travel as one packed string to the bucket of the
    minimiser. A bucket that many documents share is dealt in parts by document, over as many
    tasks as its share of all rows asks for; a part's earliest windows are compared with
    those of the other parts by 128 bits of their content, a row per part and window.
    """
    spark = docs.sparkSession
    rows = keyed_texts(docs, id_col, text_col)
    dictionary = packing_dictionary(docs, text_col)
    crowded = crowded_buckets(rows, window, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kmers = rows.select(*_KEY, "text").mapInArrow(_cut(dictionary, window, crowded), KMER_SCHEMA).repartition("bucket", "part") \
        .sortWithinPartitions("bucket", "part", "no_id", "doc_id", "t1", "start")
    found = settle(kmers.mapInArrow(_search(dictionary, window, chunk), FOUND_SCHEMA), "stretches", remove_shuffles=True)
    place = F.struct("no_id", "doc_id", "t1", "first")
    pending = found.filter(F.col("h1").isNotNull())
    owners = pending.groupBy("h1", "h2").agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    late = pending.join(owners, ["h1", "h2"]).filter(place > F.col("owner"))
    stretch = [*_KEY, "first", "last"]
    return found.filter(F.col("h1").isNull()).select(*stretch).unionAll(late.select(*stretch))


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their stretches."""
    for batch in rows_of(batches, 256):
        n_words, n_removed, texts = [], [], []
        for text, stretches in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.split()
            n_words.append(len(words))
            if stretches.is_valid:
                packed = stretches.values.to_numpy()
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, packed >> 32, 1)
                np.add.at(steps, packed & 0xFFFFFFFF, -1)
                words = [w for w, over in zip(words, np.cumsum(steps).tolist(), strict=False) if not over]
            n_removed.append(n_words[-1] - len(words))
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "text"])


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, text)``: every row without the words of repeated windows.

    Words are what stands between ASCII blanks, unchanged. A window is ``window`` consecutive
    words; each word that a window covers goes, if the window's words also start earlier:
    in a document with a smaller id, or in the same one further up. Windows are judged on
    the input. The words that stay are joined by one space.

    Null and empty texts have no words; texts shorter than a window lose none. Rows of one
    id and text are one document and get the same answer; several texts of one id are
    documents in the order of their hashes; null ids come after all others, in the order of
    their texts' hashes. Repeated passages within a document lose all but the first. An
    empty table gives an empty result; other columns are not read.
    """
    packed = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("last").cast("long"))
    stretches = settle(repeated_stretches(docs, window, chunk, id_col, text_col).groupBy(*_KEY)
                       .agg(F.collect_list(packed).alias("stretches")), "removals").withColumnsRenamed({c: f"of_{c}" for c in _KEY})
    rows = keyed_texts(docs, id_col, text_col)
    same = (F.col("doc_id") == F.col("of_doc_id")) & (F.col("no_id") == F.col("of_no_id")) & (F.col("t1") == F.col("of_t1"))
    return rows.join(stretches, same, "left").select("row_id", "text", "stretches").mapInArrow(_without, KEPT_SCHEMA)
