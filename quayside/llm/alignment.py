"""Cross-tokenizer alignment of documents, in Arrow tables inside the tasks."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from quayside.llm.common import body
from quayside.session import settle

# Where the tokenizer files lie, unless the caller names them.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# A block of documents is aligned as one table; it closes at so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 21
# A pair of ids as one number: the A id stands above these bits.
B_BITS = 20

BLOCK_SCHEMA = ("doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
                "sha array<string>, codes array<long>, n_docs array<long>, n_rows long, docs binary, pairs binary, times binary")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

# How byte-level vocabularies split text before merging, and the characters
# whose class no Unicode version has changed since both libraries' tables were made.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile("[^\x00-ɏ‐-‧€]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    characters for themselves, the other bytes in order from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """The byte-level tokenizer of a ``tokenizers`` file.

    Its merges are in the order of its ids, so the vocabulary read as ranks gives the same
    ids; texts of characters whose Unicode class is beyond doubt take that faster way, all
    others the ``tokenizers`` library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        letters = byte_alphabet()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"] for t in described.get("added_tokens", [])}
        vocabulary = described["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if _SETTLED.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    """The tokenizer of a ``sentencepiece`` file; it puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            raw = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes.append(bytes([int(raw[1], 16)]) if raw else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def _tokens(kind: str, path: str):
    """A tokenizer, made once per worker, with its tokens' bytes and lengths as Arrow arrays."""
    made = ByteTokens(path) if kind == "byte" else PieceTokens(path)
    table = pa.array(made.bytes, pa.binary())
    return made, table, pc.binary_length(table)


def _whole(ids: list[list[int]], table: pa.Array, texts: list[bytes]) -> list[bool]:
    """Whether the tokens of each text, joined, are the text with a space before it."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, table.take(pc.list_flatten(lists))), b"")
    return [got == b" " + text for got, text in zip(joined.to_pylist(), texts, strict=True)]


def _ends(ids: list[list[int]], lengths: pa.Array, name: str) -> pa.Table:
    """A row per token: its document, its id, and where it ends in the document and in the block."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int32())
    place = pc.cumulative_sum(lengths.take(flat).cast(pa.int64()))
    # segmented sums: what the documents before add up to is taken off again
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), place]), lists.offsets.slice(0, len(lists)))
    end = pc.subtract(place, before.take(doc))
    return pa.table({"doc": doc, "end": end, "place": place, name: flat})


def align_block(a_ids: list[list[int]], b_ids: list[list[int]], a_length: pa.Array, b_length: pa.Array) -> tuple[pa.Table, list[str], pa.Table]:
    """Aligned documents: ``(doc, n_groups, n_links)``, the group texts, and ``(doc, code, times)`` of their linked id pairs.

    Both token sequences of a document cover the same bytes. A full hash join on document
    and end gives every place where a token ends. Where both end, a group ends; and each
    stretch between two neighbouring places lies in one A token and one B token, which are
    those of the next ends at or after it: that is a link, and every overlap is one.
    """
    a, b = _ends(a_ids, a_length, "a"), _ends(b_ids, b_length, "b").drop_columns(["place"])
    both = a.join(b, ["doc", "end"], join_type="full outer", use_threads=False)
    # documents have equally many bytes on both sides: document and end give the order
    both = both.combine_chunks()
    key = pc.add(pc.shift_left(both["doc"].cast(pa.int64()), 40), both["end"])
    both = both.take(pc.array_sort_indices(key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key)).combine_chunks()
    has_a, has_b = (both[c].is_valid().combine_chunks() for c in ("a", "b"))
    doc = both["doc"].combine_chunks()
    cut = pc.and_(has_a, has_b)
    totals = pa.table({"doc": doc, "cut": cut.cast(pa.int64())}).group_by("doc", use_threads=False) \
        .aggregate([("cut", "sum"), ([], "count_all")]).sort_by("doc")
    totals = pa.table({"doc": totals["doc"], "n_groups": totals["cut_sum"], "n_links": totals["count_all"]})
    texts = _group_texts(both["a"].combine_chunks().filter(has_a), both["b"].combine_chunks().filter(has_b), has_a, has_b, cut,
                         totals["n_groups"].combine_chunks())
    linked = [pc.fill_null_backward(both[c].combine_chunks()).cast(pa.int64()) for c in ("a", "b")]
    code = pc.add(pc.shift_left(linked[0], B_BITS), linked[1])
    pairs = pa.table({"doc": doc, "code": code}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    return totals, texts, pa.table({"doc": pairs["doc"], "code": pairs["code"], "times": pairs["count_all"]})


def _starts(flags: pa.Array, at: pa.Array) -> pa.Array:
    """List offsets: how many of ``flags`` hold up to each place of ``at``, after a 0."""
    upto = pc.cumulative_sum(flags.cast(pa.int32())).take(at)
    return pa.concat_arrays([pa.array([0], pa.int32()), upto])


def _group_texts(a: pa.Array, b: pa.Array, has_a: pa.Array, has_b: pa.Array, cut: pa.Array, per_doc: pa.Array) -> list[str]:
    at = pc.indices_nonzero(cut)
    sides = [pc.binary_join(pa.ListArray.from_arrays(_starts(has, at), ids.cast(pa.string())), ",") for ids, has in ((a, has_a), (b, has_b))]
    groups = pc.binary_join_element_wise(*sides, "|")
    ends = pc.cumulative_sum(per_doc).cast(pa.int32())
    lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), groups)
    return pc.binary_join(lists, ";").to_pylist()


def _packed(column: pa.Array | np.ndarray) -> bytes:
    return pa.compress(np.asarray(column).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _block(ids: list, texts: list[bytes | None], byte_path: str, piece_path: str) -> dict:
    """One block of documents as a row: counts per document, its id pairs with the documents
    that hold them, and which document has which pair how often."""
    first, a_table, a_length = _tokens("byte", byte_path)
    second, b_table, b_length = _tokens("piece", piece_path)
    tried = [i for i, t in enumerate(texts) if t]
    strings = {}
    for i in tried:
        try:
            strings[i] = texts[i].decode()
        except UnicodeDecodeError:  # bytes that are no text cannot be joined again
            continue
    tried = list(strings)
    a_ids, b_ids = [first.encode(" " + strings[i]) for i in tried], [second.encode(strings[i]) for i in tried]
    raw = [texts[i] for i in tried]
    good = [x and y for x, y in zip(_whole(a_ids, a_table, raw), _whole(b_ids, b_table, raw), strict=True)]
    kept = [i for i, ok in zip(tried, good, strict=True) if ok]
    a_ids, b_ids = ([x for x, ok in zip(ids_, good, strict=True) if ok] for ids_ in (a_ids, b_ids))
    n = len(ids)
    row = {"doc_ids": ids, "n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "sha": [""] * n,
           "codes": [], "n_docs": [], "n_rows": 0, "docs": b"", "pairs": b"", "times": b""}
    if not kept:
        return row
    totals, groups, pairs = align_block(a_ids, b_ids, a_length, b_length)
    for at, i, x, y, g, links, text in zip(range(n), kept, a_ids, b_ids, totals["n_groups"].to_pylist(), totals["n_links"].to_pylist(), groups):
        row["n_a"][i], row["n_b"][i], row["n_groups"][i], row["n_links"][i] = len(x), len(y), g, links
        row["sha"][i] = hashlib.sha256(text.encode()).hexdigest()
    # partial counts: the documents of this block that hold a pair
    counted = pairs.group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
    codes = counted["code"].to_numpy()
    place = np.searchsorted(codes, pairs["code"].to_numpy()).astype(np.int32)
    docs = np.array(kept, np.int32)[pairs["doc"].to_numpy()]
    order = np.lexsort((place, docs))
    return row | {"codes": codes, "n_docs": counted["count_all"].to_numpy(), "n_rows": len(order), "docs": _packed(docs[order]),
                  "pairs": _packed(place[order]), "times": _packed(pairs["times"].to_numpy()[order].astype(np.int32))}


_BLOCK_TYPES = {"doc_ids": pa.list_(pa.int64())} | {c: pa.list_(pa.int64()) for c in _COUNTS} | {
    "sha": pa.list_(pa.string()), "codes": pa.list_(pa.int64()), "n_docs": pa.list_(pa.int64()), "n_rows": pa.int64(),
    "docs": pa.binary(), "pairs": pa.binary(), "times": pa.binary()}


def _align(byte_path: str, piece_path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            row = _block(ids, texts, byte_path, piece_path)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in _BLOCK_TYPES.items()], list(_BLOCK_TYPES))
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()
    return run


def _score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the links of each document, from the corpus-wide counts of its block's pairs."""
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {c: batch.column(c)[row] for c in batch.schema.names}
            n, rows = len(cell["doc_ids"]), cell["n_rows"].as_py()
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if rows:
                docs, pairs, times = (pa.array(_unpacked(cell[c].as_py(), rows, np.int32)) for c in ("docs", "pairs", "times"))
                found, top = cell["counts"].values.take(pairs), cell["tops"].values.take(pairs)
                links = times.cast(pa.int64())
                sums = pa.table({"doc": docs, "count_sum": pc.multiply(links, found),
                                 "n_best": pc.multiply(links, pc.equal(found, top).cast(pa.int64()))}) \
                    .group_by("doc", use_threads=False).aggregate([("count_sum", "sum"), ("n_best", "sum")])
                at = sums["doc"].to_numpy()
                total[at], best[at] = sums["count_sum_sum"].to_numpy(), sums["n_best_sum"].to_numpy()
            yield pa.RecordBatch.from_arrays([cell["doc_ids"].values, *(cell[c].values for c in _COUNTS), pa.array(best), pa.array(total),
                                              cell["sha"].values],
                                             ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(code, count, top)``: how many documents hold an id pair linked, and the highest such count of its A id.

    Blocks have counted their own documents, so a pair of every document is one row per
    block, and partial sums meet before the shuffle. An A id has at most as many pairs as
    the B vocabulary has ids, which bounds the window.
    """
    counts = blocks.select(F.inline(F.arrays_zip("codes", "n_docs"))).groupBy(F.col("codes").alias("code")).agg(F.sum("n_docs").alias("count"))
    return counts.withColumn("top", F.max("count").over(W.partitionBy(F.shiftright("code", B_BITS))))


def align(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    Texts are encoded by a byte-level tokenizer (A, of a space and the text) and a piece
    tokenizer (B, which adds the space). Places where both end a token cut them into
    groups; tokens whose bytes overlap are linked. The count of an id pair is the number of
    documents that hold it linked, over the whole corpus.

    Documents are encoded and aligned once, in blocks of bounded size, and kept as packed
    rows in the shared folder. What is shuffled are the distinct pairs of a block, not those
    of a document, and the packed rows once, to meet their counts. Null, empty and
    undecodable texts, and texts whose tokens do not add up to them, have no tokens: zeros
    and an empty hash. Repeated rows and null ids are documents of their own; an empty
    table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text"))
    blocks = settle(texts.mapInArrow(_align(byte_path, piece_path), BLOCK_SCHEMA)
                    .withColumn("block", F.monotonically_increasing_id()), "blocks")
    counts = settle(pair_counts(blocks), "pair-counts")
    wanted = blocks.select("block", F.posexplode("codes").alias("pos", "code"))
    found = wanted.join(counts, "code").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "top"))).alias("found"))
    found = found.select("block", F.col("found.count").alias("counts"), F.col("found.top").alias("tops"))
    packed = blocks.select("block", "doc_ids", *_COUNTS, "sha", "n_rows", "docs", "pairs", "times")
    return packed.join(found, "block", "left").drop("block").mapInArrow(_score, RESULT_SCHEMA)
