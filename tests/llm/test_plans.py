"""License scans, shards and mixtures against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quayside.llm import licenses, mixing, shards
from tests.llm.samples import AWKWARD, SCHEMA, clashing, docs, words

# ---- licenses


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    found, places = brute_words(text), []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i:i + len(parts)] == parts]
    at = [i for i, _ in places]
    return (len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


LICENSED = ["Released under the MIT License.", "THE MIT\nLicense, mit-license and Apache   License", "General Public License general public license",
            "GNU General Public\x0bLicense", "mit licenses", "mit", "license mit", "ümit license", "mit license " * 700,
            "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software",
            "Redistribution and use in source and binary forms, with or without modification, permitted", "of the of the of the " * 50]


def test_license_places(spark):
    rng = random.Random(1)
    texts = AWKWARD + LICENSED + [" ".join(rng.choice([rng.choice(LICENSED[:9]), words(rng, 3)]) for _ in range(6)) for _ in range(60)]
    ids = [None, None, *range(len(texts) - 3), 4]
    got = licenses.license_labels(clashing(docs(spark, texts, ids)).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == \
        Counter((i, *brute_base(t)) for i, t in zip(ids, texts, strict=True))
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert all(0 <= r.score <= 1 and (r.score == 1 if r.n_base else True) for r in got)


def test_license_templates(spark):
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, LICENSED)).collect()}
    assert got[9].labels == "cc-by-nc" and got[9].n_base == 0
    assert got[12].labels == "" and got[12].score < 0.3


def brute_spans(text, templates):
    """The best share of a template's grams in order, for every span that opens at a diagonal."""
    found, labels, top = brute_words(text), set(), 0.0
    for phrase, label, base in templates:
        target = brute_words(phrase)
        gram = 4 if len(target) >= 12 and not base else 2
        shift = 0 if base else min(len(target) // 8, 8)
        needed = 1 if base else 0.66 if gram == 4 else 0.84
        n = len(target) - gram + 1
        votes = [(p, q) for p in range(len(found) - gram + 1) for q in range(n) if found[p:p + gram] == target[q:q + gram]]
        for d in {p - q for p, q in votes}:
            best = {}
            for p, q in sorted((v for v in votes if d <= v[0] - v[1] <= d + shift), key=lambda v: (v[0], -v[1])):
                best[q] = max(best.get(q, 0), 1 + max((x for k, x in best.items() if k < q), default=0))
            score = max(best.values()) / n
            top = max(top, score)
            if score >= needed:
                labels.add(label)
    return ",".join(sorted(labels)), top


def test_license_spans_stand_in_order(spark):
    rng = random.Random(8)
    known = [(p, x, True) for p, x in licenses.BASE.items()] + [(p, x, False) for p, x in {**licenses.SENTENCES, **licenses.TEXTS}.items()]
    texts = list(LICENSED)
    for phrase, _, _ in known:
        parts = phrase.split()
        pairs = [parts[i:i + 2] for i in range(len(parts) - 1)]
        stretched = [w for p in pairs for w in (*p, "filler", "words")]
        edited = [w for w in parts if rng.random() > 0.03]
        edited.insert(len(edited) // 2, "inserted")
        texts += [phrase, f"x y {phrase.upper()} z", " ".join(reversed(parts)), " ".join(w for p in reversed(pairs) for w in p), " ".join(stretched),
                  " ".join(edited), " ".join(rng.sample(parts, len(parts))), f"{phrase} {words(rng, 5)} {phrase}"]
    texts += ["reserved rights and rights reserved, all rights", "the creative commons and commons attribution", "Kelvin MIT license"]
    got = {r.doc_id: (r.labels, pytest.approx(r.score)) for r in licenses.license_labels(docs(spark, texts)).collect()}
    assert got == {i: brute_spans(t, known) for i, t in enumerate(texts)}
    for at, (phrase, label, base) in enumerate(known):
        first = len(LICENSED) + 8 * at
        assert all(label in got[first + k][0].split(",") for k in (0, 1, 7))
        if len(phrase.split()) > 4 and not brute_base(phrase)[1]:  # a base phrase inside counts wherever it stands
            assert all(label not in got[first + k][0].split(",") for k in (2, 3, 4, 6))
        if len(phrase.split()) >= 25:
            assert label in got[first + 5][0].split(",")
    assert got[len(texts) - 3][0] == "" and got[len(texts) - 2][0] == ""


def test_own_templates(spark):
    mine = licenses.template_table(spark, {"one two three four": "own"}, {"five six": "fixed"})
    got = licenses.license_labels(docs(spark, ["one two three four", "Five-six", "mit license", None]), templates=mine)
    assert [r.labels for r in got.orderBy("doc_id").collect()] == ["own", "fixed", "", ""]
    assert licenses.license_labels(docs(spark, ["a b"]), templates=mine.limit(0)).first().labels == ""


def test_license_plan_is_native(spark):
    plan = licenses.license_labels(docs(spark, LICENSED))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- shards

def brute_capacity(sizes, shards_):
    best = [[0] + [float("inf")] * len(sizes)]
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    for _ in range(shards_):
        best.append([min(max(best[-1][j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)])
    return best[-1][-1]


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 150, 0), (2, 150, 90_000), (3, 5, 0), (4, 1, 10), (5, 80, 3_000)])
def test_smallest_capacity(spark, monkeypatch, seed, n, hot):
    monkeypatch.setattr(shards, "FIRST_DIGITS", 1)
    monkeypatch.setattr(shards, "MORE_DIGITS", 1)
    rng = random.Random(seed)
    keys = sorted(f"{rng.getrandbits(128):032x}" for _ in range(n))
    sizes = [rng.randrange(1, 5000) for _ in keys]
    sizes[n // 3] += hot
    capacity, cuts = shards.minimax_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key string, size long"), 8)
    assert capacity == brute_capacity(sizes, 8)
    loads = Counter()
    for k, s in zip(keys, sizes, strict=True):
        loads[sum(k >= c for c in cuts)] += s
    assert max(loads.values()) == capacity if n >= 8 else max(loads.values()) <= capacity
    assert len(cuts) == 7 and cuts == sorted(cuts)
    if n >= 80:
        assert len(loads) == 8


def test_shards(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(500)] + ["copy of copies " * 30] * 200 + AWKWARD
    ids = list(range(len(texts) - 4)) + [None, None, 7, 7]
    df = clashing(docs(spark, texts, ids))
    rows = shards.digest(shards.assign_shards(df)).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    of_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        of_text[r.text_md5].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in of_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(8))
    again = shards.digest(shards.assign_shards(df.repartition(9))).collect()
    assert Counter(again) == Counter(rows)


# ---- mixtures

def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(4)
    names = ["a", "B", "b", "ä", None, "", "z", "😀", "￿"]
    texts = [words(rng, rng.choice([1, 5, 5, 5, 40, 300])) for _ in range(800)] + AWKWARD
    sources = [rng.choice(names[:3] if rng.random() < 0.7 else names) for _ in texts]
    ids = list(range(len(texts) - 4)) + [None, None, 7, 7]
    df = clashing(docs(spark, texts, ids, sources))
    rows = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter((i, s, size(t)) for i, s, t in zip(ids, sources, texts, strict=True))
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s])
        assert all(r.source_size == sizes[s] for r in rows if r.source == s)
        assert abs(taken[s] - targets[s]) <= max(1, 0.01 * targets[s])
    again = mixing.mix(df.repartition(11)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    out = mixing.mixed_documents(df.filter("doc_id is not null and doc_id <> 7"))
    assert out.columns == df.columns
    total = sum(targets.values())
    assert abs(sum(size(r.text) for r in out.collect()) - total) < 0.02 * total


def test_budgets_fit_exactly():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 400), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 6) for _ in lengths]
        budget = rng.randrange(0, sum(n * c for n, c in zip(lengths, counts, strict=True)) + 1)
        got = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(got, counts, strict=True))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert abs(sum(n * k for n, k in zip(lengths, got, strict=True)) - budget) == min(abs(s - budget) for s in sums)
    assert mixing.fit_budget([100_000, 90_000], [1, 1], 95_000) in ([1, 0], [0, 1])
    assert sum(n * k for n, k in zip(range(1, 1001), mixing.fit_budget(list(range(1, 1001)), [1000] * 1000, 123_456_789), strict=True)) == 123_456_789


@pytest.mark.parametrize("run", [licenses.license_labels, shards.assign_shards, mixing.mix, mixing.mixed_documents])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
