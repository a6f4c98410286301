"""Line, exact and SimHash deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quayside.llm import components, exact_dedup, line_dedup, simhash
from tests.llm.samples import AWKWARD, SCHEMA, clashing, docs, words


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- exact copies

def brute_groups(ids, texts):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[t or ""].append(i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        known = [x for x in groups[t or ""] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_groups(spark):
    rng = random.Random(1)
    texts = [words(rng, 3, 6) for _ in range(400)] + AWKWARD
    ids = list(range(len(texts) - 4)) + [None, None, 7, 7]
    df = clashing(docs(spark, texts, ids)).repartition(5)
    assert Counter(map(tuple, exact_dedup.exact_groups(df).collect())) == brute_groups(ids, texts)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for t in texts})


def test_narrow_route_changes_nothing(spark):
    texts = [f"t{i % 50}" for i in range(300)]
    df = docs(spark, texts)
    assert Counter(map(tuple, exact_dedup.exact_groups(df, route_bits=15).collect())) == brute_groups(range(300), texts)


def test_quotient_filter_round_trip():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 52, 3000, dtype=np.uint64)) | np.uint64(5 << 52)
    counts = rng.integers(1, 9, len(prints)).astype(np.uint64)
    got = exact_dedup.decode(5, *exact_dedup.encode(prints, counts))
    assert (got[0] == prints).all() and (got[1] == counts).all()
    half = exact_dedup.merge([(prints[::2], counts[::2]), (prints, counts), (prints[:9], counts[:9])])
    total = Counter()
    for p, c in [(prints[::2], counts[::2]), (prints, counts), (prints[:9], counts[:9])]:
        total.update(dict(zip(p.tolist(), c.tolist(), strict=True)))
    assert dict(zip(half[0].tolist(), half[1].tolist(), strict=True)) == total
    assert (np.diff(half[0].astype(object)) > 0).all()


# ---- near duplicates of rows that share an id or have none

def test_unrelated_documents_stay_apart_whatever_their_ids(spark):
    rng = random.Random(21)
    texts = [words(rng, 600, 5000) for _ in range(6)]
    near = " ".join(texts[5].split()[:-1])  # a copy of the last but for a word
    rows = texts + [texts[0], texts[4], near, texts[2], None, ""]
    ids = [None, None, 7, 7, 5, 9, None, 6, 8, 7, None, 3]
    df = clashing(docs(spark, rows, ids)).repartition(5)
    classes = simhash.near_duplicate_classes(df)
    prints = {r.fingerprint for r in classes.collect()}
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    # one row of each text, the one with the smallest known id; of near copies the smallest id
    assert got == Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (5, texts[4]), (8, near), (3, "")])
    assert 7 <= len(prints) <= 8


# ---- lines

def brute_lines(ids, texts, least=10):
    key = lambda line: lower(line.strip(line_dedup.BLANK))
    order = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: order(x[0])):
        for line in (t or "").split("\n"):
            owner.setdefault(key(line), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(spark):
    rng = random.Random(2)
    common = [words(rng, 4, 30) for _ in range(12)] + ["  Shared LINE of words\t", "shared line of words", "short"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.7 else words(rng, 5) for _ in range(rng.randrange(1, 12)))
             for _ in range(300)] + AWKWARD + ["shared line of words\nx\nshared line of words"]
    ids = list(range(len(texts) - 5)) + [None, None, 3, 3, 10_000]
    df = clashing(docs(spark, texts, ids)).repartition(7)
    got = Counter(map(tuple, line_dedup.drop_repeated_lines(df).collect()))
    assert got == brute_lines(ids, texts)


def test_a_line_that_spans_many_ranges(spark):
    texts = ["one very common line\nown line number %d" % i for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = Counter(map(tuple, line_dedup.drop_repeated_lines(docs(spark, texts)).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute_lines(range(2000), texts)


def test_bitmap_of_each_document(spark):
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs(spark, ["a common line\nx", "x\na common line\ny"])).collect()}
    assert line_dedup.unpack_bitmap(maps[1].keep, 3).tolist() == [True, False, True]
    assert line_dedup.unpack_bitmap(maps[0].keep, 2).all()


# ---- SimHash

def brute_print(text, shingle=3):
    found = [w for w in lower(text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\r", " ").split(" ") if w]
    if not found:
        return 0
    grams = [" ".join(found[i:i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, x in enumerate(ids):
        if x is not None:
            best[find(i)] = min(best.get(find(i), x), x)
    return Counter((x, prints[i], best.get(find(i))) for i, x in enumerate(ids))


def near_texts(rng):
    texts = list(AWKWARD)
    for _ in range(40):
        base = words(rng, rng.randrange(1, 400)).split()
        for _ in range(rng.randrange(1, 5)):
            changed = list(base)
            changed[rng.randrange(len(base))] = "other"
            texts.append(" ".join(changed))
    return texts


def test_classes(spark):
    texts = near_texts(random.Random(4))
    ids = [None, *range(len(texts) - 3), 5, None]
    df = clashing(docs(spark, texts, ids)).repartition(6)
    got = Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id)
                  for r in simhash.near_duplicate_classes(df).collect())
    assert got == brute_classes(ids, [brute_print(t) for t in texts])


def test_one_row_of_each_class_stays(spark):
    texts = near_texts(random.Random(5))
    ids = [*range(len(texts) - 2), 0, 0]
    df = clashing(docs(spark, texts, ids)).repartition(4)
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    expected = {c for _, _, c in brute_classes(ids, [brute_print(t) for t in texts])}
    assert sorted(r.doc_id for r in left.collect()) == sorted(expected)


def test_masks_cover_every_pair():
    rng = random.Random(6)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            differs = sum(1 << b for b in rng.sample(range(64), radius))
            covered = [m for m in masks if not m & differs]
            assert covered
            fine = simhash.refining_masks(covered[0], radius, 4096)
            assert any(not m & differs for m in fine)
            assert all((~m & (1 << 64) - 1).bit_count() <= 12 for m in fine)


def test_links_of_a_crowded_bucket(spark):
    rng = random.Random(7)
    free = [i for i in range(64) if not simhash.covering_masks(3)[4] >> i & 1]
    varied = rng.sample(free, 10)
    prints = [sum(1 << b for k, b in enumerate(varied) if n >> k & 1) for n in range(1024) if n.bit_count() != 4]
    prints += [rng.getrandbits(64) for _ in range(50)]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    whole = brute_classes(list(range(len(prints))), prints, 1)
    for largest in (4096, 512):
        roots = {r.node % (1 << 64): r.root for r in components.components(simhash.links(df, 1, largest)).collect()}
        by_class = defaultdict(set)
        for _, p, c in whole:
            by_class[c].add(roots.get(p, p))
        assert all(len(x) == 1 for x in by_class.values())
        assert len({next(iter(x)) for x in by_class.values()}) == len(by_class)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    edges += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(400)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent if x != 6000}


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, line_dedup.drop_repeated_lines, line_dedup.keep_bitmaps,
                                 simhash.near_duplicate_classes, exact_dedup.drop_copies, simhash.drop_near_duplicates])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
