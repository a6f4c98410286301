"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quayside.llm.common import body, held_out, rows_of, text_function
from quayside.llm.labelled import MOST_LABELLED, labelled_sample

FEATURES = ("log_words", "word_bytes", "distinct_words", "repeated_next", "upper", "digits", "points", "bangs", "bars", "symbols",
            "beyond_ascii", "blanks", "log_lines", "words_a_line", "distinct_lines", "capitalised", "plain_ends", "longest_word")


def features(text: bytes) -> list[float]:
    """What the shape of a text tells; the whole text is read."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    found, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(found)), max(1, len(text))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    return [
        np.log1p(len(found)), len(text) / n, len(set(found)) / n, sum(map(eq, found, found[1:])) / n,
        counts[65:91].sum() / letters, counts[48:58].sum() / size, counts[46] / n, counts[33] / n, counts[124] / n,
        counts[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum() / n, counts[128:].sum() / size, counts[[9, 10, 11, 12, 13, 32]].sum() / size,
        np.log1p(len(lines)), len(found) / len(lines), len(set(lines)) / len(lines),
        sum(w[:1].isupper() for w in found) / n, sum(w[-1:].isalpha() for w in found) / n, max(map(len, found), default=0),
    ]


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 3.0) -> np.ndarray:
    """A shallow tree over ordered bins: the step of each bin, constant within a leaf."""
    def leaf(a, b):
        return np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1.0))

    def grow(a, b, d):
        if d == 0 or b - a < 2:
            return leaf(a, b)
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1), -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] <= g[a:b].sum() ** 2 / (h[a:b].sum() + 1):
            return leaf(a, b)
        return np.concatenate([grow(a, a + cut + 1, d - 1), grow(a + cut + 1, b, d - 1)])
    return grow(0, len(g), depth)


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over a grid of two features' bins: one cut of the first, then one of the second on either side; and its gain."""
    best, table = 0.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        step, gain = np.zeros_like(g), -(g.sum() ** 2) / (h.sum() + 1)
        for rows in (slice(0, cut), slice(cut, None)):
            line = _tree(g[rows].sum(0), h[rows].sum(0), 1)
            step[rows] = line
            for value in np.unique(line):
                at = line == value
                gain += g[rows][:, at].sum() ** 2 / (h[rows][:, at].sum() + 1)
        if gain > best:
            best, table = gain, step
    return table, best


class AdditiveModel:
    """Lookup tables by feature and by pair of features; a score is a sum of table entries through a sigmoid."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.pair_rounds, self.rate = bins, pair_bins, pairs, rounds, pair_rounds, rate

    def _binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Cyclic boosting: every round gives each feature in turn one shallow tree on what the others leave unexplained;
        then the pairs that explain most of the rest get their turns."""
        def cuts(column, n):
            return np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1])) if len(column) else np.zeros(0)
        wide = range(x.shape[1])
        self.edges, self.coarse = [cuts(x[:, j], self.bins) for j in wide], [cuts(x[:, j], self.pair_bins) for j in wide]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return self
        at, raw = self._binned(x, self.edges), np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-raw))
            return y - p, np.maximum(p * (1 - p), 1e-6)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                g, h = (np.bincount(at[:, j], s, len(table)) for s in slopes())
                step = self.rate * _tree(g, h, 2)
                table += step
                raw += step[at[:, j]]
        rough = self._binned(x, self.coarse)
        shape = [len(e) + 1 for e in self.coarse]

        def grid(a, b, weights):
            return np.bincount(rough[:, a] * shape[b] + rough[:, b], weights, shape[a] * shape[b]).reshape(shape[a], shape[b])
        g, h = slopes()
        gains = {(a, b): _tree2(grid(a, b, g), grid(a, b, h))[1] for a, b in combinations(wide, 2) if shape[a] > 1 and shape[b] > 1}
        self.pairs = sorted(gains, key=gains.get, reverse=True)[:self.n_pairs]
        self.grids = [np.zeros((shape[a], shape[b])) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for (a, b), table in zip(self.pairs, self.grids, strict=True):
                g, h = slopes()
                step = self.rate * _tree2(grid(a, b, g), grid(a, b, h))[0]
                table += step
                raw += step[rough[:, a], rough[:, b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        at, rough = self._binned(x, self.edges), self._binned(x, self.coarse)
        raw = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            raw += table[at[:, j]]
        for (a, b), table in zip(self.pairs, self.grids, strict=True):
            raw += table[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        rows = _matrix(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> AdditiveModel:
    """The model of at most ``most`` labelled documents outside the held-out fifth; only their features reach the driver."""
    sample = labelled_sample(docs, labels, label, most)
    rows = sample.mapInArrow(_measure, "x array<double>, label int").collect()
    rows.sort(key=lambda r: (r.x, r.label))  # the same sum order whatever the partitioning
    return AdditiveModel().fit(np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], float))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row: the probability of label 1, and whether it reaches ``threshold``.

    The score depends on the whole text alone. Null texts are empty, and empty texts have a
    score like any other; null ids are not held out; repeated rows get equal scores; a model
    without labelled rows or of one label gives the prior; an empty table gives an empty
    result; other columns are not read.
    """
    score = text_function(lambda texts: model.score(_matrix(texts)), "double", pa.float64())
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(body(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
