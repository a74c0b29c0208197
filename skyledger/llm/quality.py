"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features; the trees of a feature (or pair) add up to one lookup table, and a text's
score is the sum of its bins' entries.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, schema_and

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "capitals", "digits", "signs", "rare_signs", "bars", "other_bytes", "different_words",
    "most_frequent_word", "repeated_lines", "words_with_sign_tail", "words_per_stop", "words_per_line", "equal_neighbours", "compressed", "lower_starts",
)
TAIL = re.compile(rb"[^\w\s.,;:?\x80-\xff]{2,}(?=\s|$)")


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text; a null or empty text has zeros."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digit, other = int(c[97:123].sum()), int(c[65:91].sum()), int(c[48:58].sum()), int(c[128:].sum())
    blank = int(c[9:14].sum() + c[32])
    signs = n - lower - upper - digit - other - blank
    plain = int(c[33] + c[39] + c[40] + c[41] + c[44] + c[45] + c[46] + c[58] + c[59] + c[63])
    words = data.split()
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = data.split(b"\n")
    letters = max(1, lower + upper)
    equal = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(n), math.log1p(len(words)), (n - blank) / m, (lower + upper) / n, upper / letters, digit / n, signs / n, (signs - plain) / n, int(c[124]) / n, other / n, len(counts) / m,
        max(counts.values(), default=0) / m, 1 - len(set(lines)) / len(lines), len(TAIL.findall(data)) / m, min(200.0, m / max(1, int(c[46]))), min(500.0, m / len(lines)), equal / m, len(zlib.compress(data, 1)) / (n + 20), sum(w[:1].islower() for w in words) / m,
    ]


class PairGam:
    """Logistic additive model: intercept, a table for each feature and for the pairs that interact most."""

    def __init__(self, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 5.0):
        self.bins, self.rounds, self.pairs, self.pair_rounds, self.rate, self.ridge = bins, rounds, pairs, pair_rounds, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairGam:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)] if n else [np.zeros(0)] * k
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables: dict[tuple[int, int], np.ndarray] = {}
        share = min(max(float(y.sum() + 1) / (n + 1), 1e-4), 1 - 1e-4)
        self.intercept = math.log(share / (1 - share))
        if not n or y.min() == y.max():
            return self
        b = self.bin(x)
        z = np.full(n, self.intercept)
        for _ in range(self.rounds):
            for j in range(k):
                g, h = self._slopes(z, y)
                step = self._tree(np.bincount(b[:, j], g, len(self.tables[j])), np.bincount(b[:, j], h, len(self.tables[j])))
                self.tables[j] += step
                z += step[b[:, j]]
        for i, j in self._interactions(b, z, y):
            self.pair_tables[i, j] = np.zeros((len(self.tables[i]), len(self.tables[j])))
        for _ in range(self.pair_rounds):
            for (i, j), table in self.pair_tables.items():
                g, h = self._slopes(z, y)
                step = self._pair_tree(*(self._grid(b, v, i, j) for v in (g, h)))
                table += step
                z += step[b[:, i], b[:, j]]
        return self

    @staticmethod
    def _slopes(z, y):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    def _grid(self, b, v, i, j):
        shape = len(self.tables[i]), len(self.tables[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _split(self, g, h) -> tuple[float, int]:
        """(gain, place) of the best cut of bins in two; place 0 if none gains."""
        if len(g) < 2:
            return 0.0, 0
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = self._gain(gl, hl) + self._gain(g.sum() - gl, h.sum() - hl) - self._gain(g.sum(), h.sum())
        at = int(gain.argmax())
        return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)

    def _tree(self, g, h) -> np.ndarray:
        """A step for each bin: a tree of up to four leaves."""
        cuts = [0, len(g)]
        _, first = self._split(g, h)
        if first:
            cuts = [0, first, len(g)]
            for lo, hi in ((0, first), (first, len(g))):
                _, at = self._split(g[lo:hi], h[lo:hi])
                if at:
                    cuts.append(lo + at)
        cuts.sort()
        step = np.zeros(len(g))
        for lo, hi in zip(cuts, cuts[1:]):
            step[lo:hi] = self.rate * g[lo:hi].sum() / (h[lo:hi].sum() + self.ridge)
        return step

    def _pair_tree(self, g, h) -> np.ndarray:
        """A step for each cell: one axis cut, then the other on each side; the better order of axes."""
        best = (0.0, None)
        for flip in (False, True):
            gg, hh = (g.T, h.T) if flip else (g, h)
            gain, at = self._split(gg.sum(1), hh.sum(1))
            if not at:
                continue
            step = np.zeros(gg.shape)
            for rows in (slice(0, at), slice(at, None)):
                more, cut = self._split(gg[rows].sum(0), hh[rows].sum(0))
                gain += more
                for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    step[rows, cols] = self.rate * gg[rows, cols].sum() / (hh[rows, cols].sum() + self.ridge)
            if gain > best[0]:
                best = (gain, step.T if flip else step)
        return np.zeros(g.shape) if best[1] is None else best[1]

    def _interactions(self, b, z, y) -> list[tuple[int, int]]:
        """The pairs whose residual is explained best by four quadrants."""
        g, h = self._slopes(z, y)
        found = []
        for i in range(b.shape[1]):
            for j in range(i):
                gg, hh = self._grid(b, g, i, j).cumsum(0).cumsum(1), self._grid(b, h, i, j).cumsum(0).cumsum(1)
                if min(gg.shape) < 2:
                    continue
                parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
                gain = sum(self._gain(a, c) for a, c in zip(parts(gg), parts(hh)))
                found.append((-float(gain.max()), i, j))
        return [(i, j) for _, i, j in sorted(found)[: self.pairs]]

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: bin additions over all rows at once."""
        b = self.bin(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in self.pair_tables.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def feature_rows(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """docs, without the text, and out: its features as an array of floats."""
    names = [c for c in docs.columns if c not in (text, out)]
    at = docs.columns.index(text)
    keep = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_features(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(made, pa.list_(pa.float64()))], [*names, out])

    return docs.mapInArrow(run, schema_and(docs.select(*names), **{out: "array<double>"}))


def fit_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 20_000, key: str = "doc_id", text: str = "text", label: str = "quality") -> PairGam:
    """A model from labels (key, label) and the texts of docs: at most max_rows rows, those of the least hash of key.

    Null labels and keys teach nothing, of a key's labels the greatest counts; with one label only, every score is near its share (1 without labels).
    """
    rows = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null")
    rows = rows.groupBy("_k").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("_k", F.lit("quality"))).orderBy("_h", "_k").limit(max_rows)
    # at most max_rows rows of three numbers: a proven bound
    sample = docs.select(key, text).join(F.broadcast(rows), F.col(key) == F.col("_k")).select("_h", "_y", text)
    got = feature_rows(sample, text).orderBy("_h", "_y", "features").limit(max_rows).collect()
    x = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES))
    return PairGam().fit(x, np.array([1.0 if r["_y"] else 0.0 for r in got]))


def score_quality(docs: DataFrame, model: PairGam, text: str = "text", out: str = "score") -> DataFrame:
    """docs and out: the score in (0, 1) of every whole text, 1 likelier good. A null text is empty; no row is dropped; a column named out is replaced."""
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t.as_py()) for t in b.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, out])

    return docs.mapInArrow(run, schema_and(docs, **{out: "double"}))
