"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import body, held_out, rows_of, text_function
from quayside.llm.decontaminate import words
from quayside.llm.labelled import MOST_LABELLED, labelled_sample

# Hash buckets of terms; beginnings of words that are terms of their own.
BUCKETS, PREFIXES = 1 << 18, (4, 5, 6, 7)
# Words whose terms a worker remembers.
_REMEMBERED = 100_000


def word_terms(word: bytes) -> list[int]:
    """Hash buckets of a word: the word, and its beginnings, which inflected forms share."""
    out = [xxhash.xxh64_intdigest(word) % BUCKETS]
    return out + [xxhash.xxh64_intdigest(word[:n], 1) % BUCKETS for n in PREFIXES if len(word) > n]


def text_terms(texts: Iterable[bytes], memory: dict[bytes, tuple[int, ...]], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The terms of each whole text, each once, or those of them that are ``wanted``; ``memory``
    holds the terms of words met before."""
    out = []
    for text in texts:
        mine: set[int] = set()
        for word in set(words(text)):
            known = memory.get(word)
            if known is None:
                if len(memory) >= _REMEMBERED:
                    memory.clear()
                known = memory[word] = tuple(t for t in word_terms(word) if wanted is None or wanted[t])
            if known:
                mine.update(known)
        out.append(np.sort(np.fromiter(mine, np.int32, len(mine))))
    return out


class _Block:
    """Documents that make one step together: their terms, sorted, so that sums per term are sums of runs."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows), dtype=np.int16), [len(r) for r in rows])  # blocks are short
        order = np.argsort(flat, kind="stable")
        self.owner, self.y = owner[order], y
        self.terms, starts, counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.starts, self.counts = starts.astype(np.int32), counts.astype(np.int32)


class FactorizationMachine:
    """``sigmoid(base + sum w_i + sum_{i<j} <v_i, v_j>)`` over the hashed terms a text has.

    Every bucket is a term of the model, and weights and factors are learnt together, so a
    word that tells something only beside another is found like any other. In a first run
    steps that are not worth ``prune`` leave a weight or factor at zero; in a second one the
    terms that are left, those with a weight or with factors above the noise, are fitted
    without that, up to the pass that predicts a tenth of the rows, kept back, best.
    """

    def __init__(self, factors: int = 6, steps: int = 240, epochs: int = 40, rate: float = 0.2, prune: tuple[float, float] = (0.003, 0.002),
                 noise: float = 0.1, shrink: float = 2e-5, caution: tuple[float, float] = (1e-4, 1e-3), patience: int = 6, seed: int = 42):
        self.factors, self.steps, self.epochs, self.rate, self.prune, self.noise = factors, steps, epochs, rate, prune, noise
        self.shrink, self.caution, self.patience, self.seed = shrink, caution, patience, seed
        self.base = 0.0
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = np.zeros((BUCKETS, factors), np.float32)

    def __getstate__(self) -> dict:
        """Only the terms that matter travel to the tasks."""
        at = np.flatnonzero(self.used())
        return self.__dict__ | {"w": (at, self.w[at]), "v": self.v[at]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        (at, w), v = state["w"], state["v"]
        self.w, self.v = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, self.factors), np.float32)
        self.w[at], self.v[at] = w, v

    def used(self) -> np.ndarray:
        return (self.w != 0) | (self.v != 0).any(axis=1)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        out = self.base + np.bincount(owner, self.w[flat], len(rows))
        v = self.v[flat]
        for f in range(self.factors):  # pairwise part in linear time: half of square of sum less sum of squares
            out += 0.5 * (np.bincount(owner, v[:, f], len(rows)) ** 2 - np.bincount(owner, v[:, f] * v[:, f], len(rows)))
        return out

    def _step(self, block: _Block, past: list, prune: tuple[float, float]) -> None:
        """One AdaGrad step; what would move a weight or factor by less than ``prune`` from zero leaves it there."""
        n, at = len(block.y), block.terms
        v = np.repeat(self.v[at], block.counts, axis=0)
        sums = np.stack([np.bincount(block.owner, v[:, f], n) for f in range(self.factors)], axis=1).astype(np.float32)
        linear = np.bincount(block.owner, np.repeat(self.w[at], block.counts), n)
        score = self.base + linear + 0.5 * ((sums ** 2).sum(1) - np.bincount(block.owner, (v * v).sum(1), n))
        error = ((1 / (1 + np.exp(-np.clip(score, -50, 50))) - block.y) / n).astype(np.float32)
        mine = error[block.owner]
        gb, gw = float(error.sum()), np.add.reduceat(mine, block.starts)
        gv = np.add.reduceat(mine[:, None] * (sums[block.owner] - v), block.starts, axis=0) + self.shrink * self.v[at]
        past[0] += gb * gb
        past[1][at] += gw * gw
        past[2][at] += gv * gv
        self.base -= self.rate * gb / np.sqrt(past[0])
        for values, g, gone, rate, least in ((self.w, gw, past[1][at], self.rate, prune[0]), (self.v, gv, past[2][at], 0.3 * self.rate, prune[1])):
            step = rate / np.sqrt(gone)
            moved = values[at] - step * g
            values[at] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * least)

    def _past(self, caution: float) -> list:
        return [1e-6, np.full(BUCKETS, caution, np.float32), np.full(self.v.shape, caution, np.float32)]

    def fit(self, rows: list[np.ndarray], y: np.ndarray, wide: int = 512, block: int = 128) -> FactorizationMachine:
        """Logistic loss over blocks of rows in a seeded order: ``steps`` over ``wide`` blocks that prune, then the passes that fit."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y) or not any(map(len, rows)):
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(rows))
        back, used = order[:len(order) // 10], order[len(order) // 10:]

        def blocks(rows: list[np.ndarray], size: int) -> list[_Block]:
            parts = np.array_split(used, -(-len(used) // size))
            return [_Block([rows[i] for i in part], y[part]) for part in parts if any(len(rows[i]) for i in part)]

        def draw(at: np.ndarray) -> None:
            self.v[at] = rng.normal(0, 0.02, (len(at), self.factors))
        found = blocks(rows, wide)
        draw(np.unique(np.concatenate([b.terms for b in found])))
        past, left = self._past(self.caution[0]), self.steps
        while left > 0:
            for i in rng.permutation(len(found))[:left]:
                self._step(found[i], past, self.prune)
            left -= len(found)
        strong = np.sqrt((self.v ** 2).sum(1)) > self.noise
        kept = (self.w != 0) | strong
        self.v[~strong] = 0
        draw(np.flatnonzero(kept & ~strong))
        rows = [r[kept[r]] for r in rows]
        found = blocks(rows, block)
        past, best, state, since = self._past(self.caution[1]), np.inf, None, 0
        for _ in range(self.epochs if found else 0):
            for i in rng.permutation(len(found)):
                self._step(found[i], past, (0.0, 0.0))
            score = np.clip(self.raw([rows[i] for i in back]), -50, 50) if len(back) else np.zeros(0)
            loss = float(np.sum(np.logaddexp(0, score) - y[back] * score))
            since += 1
            if loss < best or not len(back):
                best, state, since = loss, (self.base, self.w.copy(), self.v.copy()), 0
            if since >= self.patience:
                break
        if state:
            self.base, self.w, self.v = state
        return self

    def score(self, texts: Iterable[bytes], memory: dict[bytes, tuple[int, ...]], used: np.ndarray | None = None) -> np.ndarray:
        rows = text_terms(texts, memory, self.used() if used is None else used)
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> FactorizationMachine:
    """The machine of at most ``most`` labelled documents outside the held-out fifth.

    The executors turn the sampled texts into terms; the driver gets, packed as the steps
    from term to term, which terms each sampled document has.
    """
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in rows_of(batches):
            rows = [zlib.compress(np.diff(r, prepend=0).astype(np.int32).tobytes(), 1) for r in text_terms(batch.column(0).to_pylist(), memory)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["terms", "label"])
    found = labelled_sample(docs, labels, label, most).mapInArrow(encode, "terms binary, label int").toArrow()
    packed = sorted(zip(found["terms"].to_pylist(), found["label"].to_pylist(), strict=True))
    rows = [np.cumsum(np.frombuffer(zlib.decompress(r), np.int32), dtype=np.int32) for r, _ in packed]
    y = np.array([label for _, label in packed], float)
    del found, packed
    return FactorizationMachine().fit(rows, y)


def scorer(model: FactorizationMachine):
    """A function of a text column: the probability of label 1. The terms the model uses, at most ``BUCKETS``, go to every task."""
    memory: dict = {}  # each task has its own
    used = model.used()
    return text_function(lambda texts: model.score(texts, memory, used), "double", pa.float64())


def score_documents(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row: the probability of label 1, and whether it reaches ``threshold``.

    The score depends on the whole text alone. Null and empty texts have the score of a
    text without terms; null ids are not held out; repeated rows get equal scores; without
    labelled rows of both kinds every score is the prior; an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       scorer(model)(body(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, all columns kept, nothing shuffled."""
    return docs.filter(scorer(model)(body(text_col)) < threshold)
