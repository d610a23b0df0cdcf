"""Quality by a generalised additive model with pairwise interactions.

Numbers that describe a text's surface are cut into bins.  The score is a sum
of table lookups: one table per feature and one per chosen pair of features.
Fitting cycles over the features, and each step adds a shallow tree on the
current one's bins to its table; then pairs are ranked by how much a four-way
cut of the residuals gains, and the best ones are boosted in the same way.
Scoring adds up the tables with vectorised indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from .common import batched, bounded_labels, extended

#: Labelled rows that the fit may read at most.
FIT_ROWS = 12_000
BINS, PAIR_BINS = 32, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 10
RATE = 0.1
FEATURES = (
    "log_words", "mean_word", "distinct_words", "upper", "digits", "punctuation", "symbols", "exclamations", "pipes", "spaces",
    "lines_per_word", "distinct_lines", "distinct_trigrams", "letters", "beyond_ascii", "top_word", "long_words", "short_words", "ends_of_sentence", "capital_words",
)

_CLASS = np.zeros(256, np.int64)
for _bytes, _n in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b".,;:'\"()-?", 4), (b"#$%&*@^~<>{}[]\\/_=+", 5), (b"!", 6), (b"|", 7), (b" \t\n\r\x0b\x0c", 8)):
    _CLASS[list(_bytes)] = _n
_CLASS[128:] = 9


def describe(text: str | None) -> np.ndarray:
    """The features of a whole text; null counts as empty, and an empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    seen = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 10)
    size, n = len(raw), len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    trigrams = max(1, n - 2)
    return np.array([
        np.log1p(n), lengths.mean(), len(counts) / n, seen[1] / size, seen[3] / size, seen[4] / size, seen[5] / size, seen[6] / n, seen[7] / n, seen[8] / size,
        len(lines) / n, len(set(lines)) / len(lines), len(set(zip(words, words[1:], words[2:]))) / trigrams, (seen[1] + seen[2]) / size, seen[9] / size,
        max(counts.values()) / n, (lengths > 14).mean(), (lengths < 4).mean(), raw.count(b".") / n, sum(map(bytes.isupper, words)) / n,
    ])


@dataclass
class AdditiveModel:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cut, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(self.pair_cuts)]
            for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
                z += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and first bin of the right side."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree of ``depth`` cuts."""
    gain, k = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    best, values = -1.0, np.zeros_like(g)
    a = (cg[:-1, :-1], ch[:-1, :-1])
    b = (cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1])
    c = (cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1])
    d = (tg - a[0] - b[0] - c[0], th - a[1] - b[1] - c[1])
    if not a[0].size:
        return best, values
    gain = sum(x**2 / (y + 1) for x, y in (a, b, c, d)) - tg**2 / (th + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for part, (x, y) in (((slice(None, i + 1), slice(None, j + 1)), a), ((slice(None, i + 1), slice(j + 1, None)), b), ((slice(i + 1, None), slice(None, j + 1)), c), ((slice(i + 1, None), slice(j + 1, None)), d)):
        values[part] = _leaf(x[i, j], y[i, j])
    return float(gain[i, j]), values


def fit(x: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Without both labels the model says the share of ones."""
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return AdditiveModel(bias, [], [], [], [], [])
    features = range(x.shape[1])
    cuts = [_cuts(x[:, f], BINS) for f in features]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), bias)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in features:
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            z += step[bins[f]]
    pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in features]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(pair_cuts)]
    shape = [len(c) + 1 for c in pair_cuts]

    def grid(a, b, v):
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    ranked = sorted(((-_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in features for b in features if a < b))
    pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    pair_tables = [np.zeros((shape[a], shape[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), values in zip(pairs, pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            values += step
            z += step[coarse[a], coarse[b]]
    return AdditiveModel(bias, cuts, tables, pairs, pair_cuts, pair_tables)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on about ``limit`` labelled rows at most; held-out rows never enter."""
    sample = bounded_labels(labels, label, limit)
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``limit`` rows

    def run(batches):
        for b in batches:
            found = [describe(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__label").cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    schema = extended(joined.select("doc_id"), label=LongType(), x=ArrayType(DoubleType()))
    got = batched(joined.select("doc_id", "text", "__label")).mapInArrow(run, schema).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x[order], got.column("label").to_numpy()[order])


def score_quality(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """Add the score of every whole text, from 0 to 1.

    Null and empty texts are scored by their zero features.  Repeated rows get
    equal scores.  A column named ``score_col`` is replaced.
    """
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = extended(base, **{score_col: DoubleType()})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.names.index(text_col))
            x = np.array([describe(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(x), pa.float64())], names=[*keep, score_col])

    return batched(base).mapInArrow(run, schema)
