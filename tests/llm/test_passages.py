"""Substring deduplication, lexical search and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quayside.llm import alignment, search, substrings
from tests.llm.samples import AWKWARD, SCHEMA, clashing, docs, words

BLANKS = "[^\x20\x09-\x0d]+"


# ---- substrings

def brute_passages(ids, texts, window=20):
    """Rows of one id and text are one document; null ids come last, in the order of their given hashes."""
    split = [re.findall(BLANKS, t or "") for t in texts]
    earlier, gone = set(), defaultdict(set)
    done = set()
    for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        if (ids[k], texts[k]) in done:
            continue
        done.add((ids[k], texts[k]))
        for at in range(len(split[k]) - window + 1):
            said = tuple(split[k][at:at + window])
            if said in earlier:
                gone[ids[k], texts[k]].update(range(at, at + window))
            earlier.add(said)
    out = []
    for i, t, found in zip(ids, texts, split, strict=True):
        kept = [w for at, w in enumerate(found) if at not in gone[i, t]]
        out.append((i, len(found), len(found) - len(kept), " ".join(kept)))
    return Counter(out)


def shared_texts(rng, n):
    passages = [words(rng, k) for k in (25, 40, 60, 120)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng, rng.randrange(1, 60), 30) for _ in range(rng.randrange(1, 5))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return texts


@pytest.mark.parametrize("chunk", [3, 8192])
def test_repeated_passages(spark, chunk):
    rng = random.Random(5)
    texts = shared_texts(rng, 150)
    texts += texts[:20] + [" ".join(["la"] * 70), " ".join(["la", "lo"] * 40), *AWKWARD]
    ids = list(range(len(texts) - 3)) + [None, 7, 7]
    texts[-1] = texts[-2] = texts[7]  # a repeated row of a document
    df = clashing(docs(spark, texts, ids)).repartition(6)
    got = substrings.drop_repeated_passages(df, chunk=chunk)
    assert Counter(map(tuple, got.collect())) == brute_passages(ids, texts)


def test_one_passage_in_every_document(spark):
    rng = random.Random(6)
    passage = words(rng, 30)
    texts = [f"{words(rng, 9)} {passage} {words(rng, 9)}" for _ in range(600)]
    df = docs(spark, texts).repartition(9)
    got = substrings.drop_repeated_passages(df, chunk=16).collect()
    assert Counter(map(tuple, got)) == brute_passages(list(range(600)), texts)
    assert sum(r.n_removed for r in got) >= 599 * 30


def test_null_ids_and_empty_table(spark):
    same = " ".join(f"w{i}" for i in range(30))
    got = substrings.drop_repeated_passages(docs(spark, [same, same + " x", same + " y"], [None, None, 4])).collect()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id == 4} == {4: 0}
    assert [r.n_removed for r in got if r.doc_id is None] == [30, 30]
    assert substrings.drop_repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_super_kmers_cover_every_window_once():
    rng = random.Random(7)
    for n in (0, 19, 20, 21, 300):
        found = [b"w%d" % rng.randrange(5) for _ in range(n)]
        keys, first, runs = substrings.super_kmers(found)
        covered = [s + i for s, r in zip(first.tolist(), runs.tolist(), strict=True) for i in range(r)]
        assert covered == list(range(max(0, n - 19)))
        by_window = defaultdict(set)
        for key, s, r in zip(keys.tolist(), first.tolist(), runs.tolist(), strict=True):
            mine = [tuple(found[at:at + 20]) for at in range(s, s + r)]
            assert len(set(mine)) == r
            for w in mine:
                by_window[w].add(key)
        assert all(len(k) == 1 for k in by_window.values())


@pytest.mark.parametrize("size", [1, 2, 3, 9])
def test_copies_are_settled_without_their_windows(monkeypatch, size):
    monkeypatch.setattr(substrings, "_windows", None)
    packed = zstandard.ZstdCompressor().compress(b" ".join(b"w%d" % i for i in range(24)))
    # a repeated row, a copy further up in one document, buckets of one string, one of them twice
    rows = [(3, -1, 1, 0), (7, -1, 1, 5), (7, -1, 2, 5), (7, -1, 2, 5), (7, -1, 2, 40), (7, -1, 3, 5), (9, -1, 4, 0), (9, -1, 4, 0), (11, -1, 5, 0)]
    buckets, parts, ids, starts = zip(*rows, strict=True)
    table = pa.table({"bucket": pa.array(buckets, pa.int64()), "part": pa.array(parts, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
                      "no_id": pa.array([False] * 9), "t1": pa.array([0] * 9, pa.int64()), "start": pa.array(starts, pa.int32()),
                      "packed": pa.array([packed] * 9, pa.binary())})
    found = [r for b in substrings._search(None, 20, 8192)(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    assert [(r["doc_id"], r["first"], r["last"], r["h1"]) for r in found] == [(2, 5, 29, None), (2, 40, 64, None), (3, 5, 29, None)]


def test_stretches_of_grams_join(monkeypatch):
    rng = random.Random(8)
    found = [b"w%d" % rng.randrange(9) for _ in range(500)]
    whole = substrings.super_kmers(found)
    monkeypatch.setattr(substrings, "_STRETCH", 37)
    assert all((a == b).all() for a, b in zip(whole, substrings.super_kmers(found), strict=True))


# ---- search

TERM = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM, lower)


def brute_search(ids, texts, items, top=10):
    counted = [Counter(terms(t)) for t in texts]
    n_docs, total = sum(bool(c) for c in counted), sum(c.total() for c in counted)
    df = Counter(t for c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in zip(ids, counted, strict=True):
            m = 10 + (90 * c.total() * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "share"), [(7, 8), (4096, 2), (50, 10_000)])
def test_search(spark, monkeypatch, block, share):
    rng = random.Random(9)
    common = ["the", "of", "and", "Größe", "x1"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"t{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(1, 80)))
             for _ in range(400)] + AWKWARD
    texts += texts[:30]  # ties
    ids = list(range(len(texts) - 2)) + [None, 3]
    items = [(k, " ".join(rng.choice(texts).split()[:12]) + " the of") for k in range(25)] + [(100, None), (101, ""), (102, "nowhere-found"), (None, "the t5")]
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "SHORT_SHARE", share)
    df = clashing(docs(spark, texts, ids)).repartition(5)
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = search.search(df, asked)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(ids, texts, items)
    parts = search.search(df, asked, per_pass=7)
    assert sorted(map(tuple, parts.collect()), key=str) == brute_search(ids, texts, items)


def test_search_block_is_exact_while_skipping():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        lists, scores = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 12))):
            at = np.sort(rng.choice(n, int(rng.integers(0, n + 1)), replace=False)).astype(np.int64)
            part = rng.integers(1, 50, len(at))
            np.add.at(scores, at, part)
            lists.append((at, part))
        best = search.Best(10)
        search.search_block(lists, list(range(n)), best, n)
        wanted = sorted(((-s, d) for d, s in enumerate(scores.tolist()) if s > 0))[:10]
        assert sorted((-s, -d) for s, _, d in best.heap) == wanted


def test_search_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(none, items).collect() == []
    assert search.search(docs(spark, ["a b"]), items.limit(0)).collect() == []


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(10)
    text = " ".join("x" * rng.randrange(1, 40) for _ in range(200)) + "y" * 500 + " end"
    monkeypatch.setattr(search, "PIECE", 16)
    assert [t.decode() for part in search.terms_of(text.encode()) for t in part] == terms(text)


# ---- alignment

def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.BYTE_BPE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment.byte_alphabet()

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    rows, held = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                raw = re.fullmatch("<0x(..)>", piece)
                b.append((i, bytes([int(raw[1], 16)]) if raw else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(r for _, r in a) != whole or b"".join(r for _, r in b) != whole:
                a = b = []
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= high) for side in (a, b)))
            low = high
        held.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(n_a, n_b, n_g, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha) for n_a, n_b, n_g, links, sha in rows]


def test_alignment(spark, monkeypatch):
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(1, 30), 60) for _ in range(60)]
    texts += ["Naïve Größe, l'été où ça va", "emoji 😀 and 中文 字", "a ▁ b", "<|endoftext|> and </s> <unk>", "  two  spaces ", "tab\there", "x" * 300,
              "Ünïcödé́ combining", "нуль", "end\n\n\n", "ﬁ ligature", "  wide", *[t for t in AWKWARD if len(t or "") < 1000]]
    texts += texts[:5]
    ids = [None if k % 17 == 0 else k for k in range(len(texts))]
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 9)
    df = clashing(docs(spark, texts, ids)).repartition(3)
    got = alignment.align(df)
    wanted = brute_alignment(texts)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter((i, *row) for i, row in zip(ids, wanted, strict=True))


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in alignment.align(docs(spark, [None, ""])).collect()] == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_both_ways_to_byte_tokens_agree(spark, data):
    tokens = alignment.ByteTokens(alignment.BYTE_BPE)
    rng = random.Random(12)
    alphabet = [chr(c) for c in range(0x250)] + list("  ''\n\t’–€") * 20 + list("etaoinshr") * 20
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        assert tokens.fast.encode_ordinary(text) == tokens.slow.encode(text, add_special_tokens=False).ids
    for (text,) in spark.read.parquet(f"{data}/documents.parquet").select("text").filter(F.col("text").isNotNull()).collect():
        assert tokens.encode(text) == tokens.slow.encode(text, add_special_tokens=False).ids
