"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and their stems of four and six letters,
hashed to 32 bits.  The machine adds a weight for each term and, for every pair
of terms, the product of their factors, so an insult that meets a group's name
can weigh more than both alone.  A term enters the machine if at least
``MIN_ROWS`` fitting rows hold it and its chi-square against the label is
``MIN_SURPRISE`` or more, or if it is one of a pair of terms whose joint
occurrence is as surprising (``paired_terms``), however little either says
alone.  The rest carry no weight: invented and rare words would else be learned
by heart (with all terms of five rows a quarter of the toxic held-out rows of
the smaller check table was missed).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType

from .common import batched, bounded_labels, extended

#: Labelled rows that the fit may read at most; the rest of the table never matters to it.
FIT_ROWS = 12_000
MIN_ROWS = 3
MIN_SURPRISE = 11.0
#: Frequent terms whose pairs are all counted, rows of each label they are counted on, the share of rows that makes a term frequent,
#: and the surprise from which a pair of frequent terms, or one with a rarer term, counts; there are many pairs, so chance needs higher bounds.
PAIR_TERMS, PAIR_ROWS, FREQUENT = 2048, 1500, 0.01
FREQUENT_SURPRISE, RARE_SURPRISE = 35.0, 40.0
#: Pairs that are counted at a time.
PAIR_CODES = 2_000_000
#: Surprise from which a rarer term that label 1 has more often than chance is looked at in pairs.
WEAK_SURPRISE = 2.0
FACTORS = 8
EPOCHS = 30
TERM = re.compile(r"[^\W_]+")
STEMS = (4, 6)


def terms_of(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text; null counts as empty."""
    import xxhash

    words = set(TERM.findall((text or "").lower()))
    words |= {"^" + w[:n] for n in STEMS for w in words if len(w) > n}
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)).view(np.int32)


@dataclass
class FactorizationMachine:
    """``terms`` sorted; the weights and factors lie in the same order."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each row of hashed terms."""
        out = np.full(len(rows), self.bias)
        if len(self.terms):
            for n, row in enumerate(rows):
                at = np.minimum(np.searchsorted(self.terms, row), len(self.terms) - 1)
                at = at[self.terms[at] == row]
                v = self.factors[at]
                s = v.sum(0)
                out[n] += self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def surprise_of(counts: np.ndarray, with_one: np.ndarray, n: int, share: float) -> np.ndarray:
    """Chi-square, corrected for continuity, of ``with_one`` rows of label 1 among ``counts`` of ``n`` rows."""
    expected = counts * share
    return np.maximum(np.abs(with_one - expected) - 0.5, 0) ** 2 / (expected * np.maximum(1 - counts / n, 1e-3) * (1 - share) + 1e-9)


def _placed(rows: list[np.ndarray], terms: np.ndarray) -> list[np.ndarray]:
    """Positions of each row's terms in the sorted ``terms``; others are left out."""
    out = []
    for row in rows:
        at = np.minimum(np.searchsorted(terms, row), len(terms) - 1)
        out.append(at[terms[at] == row].astype(np.int32))
    return out


def paired_terms(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, counts: np.ndarray, surprise: np.ndarray, excess: np.ndarray, rng) -> np.ndarray:
    """Terms (a mask) of pairs whose joint occurrence surprises, of terms that don't surprise alone.

    All pairs of the ``PAIR_TERMS`` most frequent terms are counted, in both
    directions, and the pairs of a rarer term that leans to label 1 with
    another such term or a frequent one, in rows of label 1.
    """
    out = np.zeros(len(terms), bool)
    free = surprise < MIN_SURPRISE
    often = free & (counts >= FREQUENT * len(rows))
    top = np.sort(np.flatnonzero(often)[np.argsort(-counts[often], kind="stable")[:PAIR_TERMS]])
    picked = [np.sort(rng.permutation(np.flatnonzero(y == label))[:PAIR_ROWS]) for label in (0, 1)]
    # the sample has more of label 1 than the rows: its share of label 0 stands for all of them
    weight = (y == 0).sum() / max(1, len(picked[0])) * len(picked[1]) / (y == 1).sum()
    n = len(picked[1]) + weight * len(picked[0])
    share = len(picked[1]) / n
    if len(top) > 1:
        both = []
        for chosen in picked:
            x = np.zeros((len(chosen), len(top)), np.float32)
            for k, at in enumerate(_placed([rows[i] for i in chosen], terms[top])):
                x[k, at] = 1
            both.append(x)
        for i in range(0, len(top), 512):
            zero, one = (x[:, i : i + 512].T @ x for x in both)
            hit = surprise_of(weight * zero + one, one, n, share) >= FREQUENT_SURPRISE
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
            out[top[np.flatnonzero(hit.any(0))]] = True
    rare = np.flatnonzero(free & (counts < FREQUENT * len(rows)) & (surprise >= WEAK_SURPRISE) & excess)
    if len(rare):
        wide = np.sort(np.concatenate([rare, top]))
        is_rare = np.isin(wide, rare)

        placed = [_placed([rows[i] for i in chosen], terms[wide]) for chosen in picked]

        def codes_of(at, low, high):
            own = at[is_rare[at] & (at >= low) & (at < high)].astype(np.int64)
            code = np.minimum(own[:, None], at) * len(wide) + np.maximum(own[:, None], at)
            return np.unique(code[own[:, None] != at])

        # as many rarer terms at a time as make about PAIR_CODES pairs
        weight_of = np.zeros(len(wide))
        for at in placed[1]:
            weight_of[at[is_rare[at]]] += len(at)
        part = np.cumsum(weight_of) // PAIR_CODES
        for p in np.unique(part).tolist():
            low, high = int(np.searchsorted(part, p, "left")), int(np.searchsorted(part, p, "right"))
            codes, one = np.unique(np.concatenate([codes_of(at, low, high) for at in placed[1]]), return_counts=True)
            codes, one = codes[one >= MIN_ROWS], one[one >= MIN_ROWS]
            if not len(codes):
                continue
            zero = np.zeros(len(codes))
            for at in placed[0]:
                found = codes_of(at, low, high)
                where = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                zero[where[codes[where] == found]] += 1
            hit = codes[surprise_of(one + weight * zero, one, n, share) >= RARE_SURPRISE]
            out[wide[np.unique(np.concatenate([hit // len(wide), hit % len(wide)]))]] = True
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, minibatch Adagrad, L2.  Without both labels the machine says the share of ones."""
    y = np.asarray(labels, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    empty = FactorizationMachine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return empty
    seen, counts = np.unique(np.concatenate(rows), return_counts=True)
    ones, hits = np.unique(np.concatenate([r for r, label in zip(rows, y, strict=True) if label]), return_counts=True)
    with_one = np.zeros(len(seen))
    with_one[np.searchsorted(seen, ones)] = hits
    usable = counts >= MIN_ROWS
    seen, counts, with_one = seen[usable], counts[usable], with_one[usable]
    surprise = surprise_of(counts, with_one, len(y), y.mean())
    rng = np.random.default_rng(seed)
    terms = seen[(surprise >= MIN_SURPRISE) | paired_terms(rows, y, seen, counts, surprise, with_one > counts * y.mean(), rng)]
    if not len(terms):
        return empty
    kept = _placed(rows, terms)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    gw, gv, gb = np.full(len(terms), 1e-8), np.full((len(terms), FACTORS), 1e-8), 1e-8
    rate, decay = 0.1, 1e-5
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for batch in np.array_split(order, max(1, len(y) // 256)):
            sizes = np.array([len(kept[i]) for i in batch])
            at = np.concatenate([kept[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            x = v[at]
            sums = np.stack([np.bincount(owner, x[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (x * x).sum(1), len(batch))
            z = bias + np.bincount(owner, w[at], len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            e = error[owner]
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e, len(used)) + decay * w[used]
            pull = e[:, None] * (sums[owner] - x)
            dv = np.stack([np.bincount(back, pull[:, f], len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return FactorizationMachine(terms, bias, w, v)


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str, text_col: str):
    """Hashed terms and labels of the fitting rows, of which there are about ``limit`` at most."""
    sample = bounded_labels(labels, label, limit)
    joined = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``limit`` rows

    def run(batches):
        for b in batches:
            found = [terms_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__label").cast(pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    schema = extended(joined.select("doc_id"), label=LongType(), terms=ArrayType(IntegerType()))
    got = batched(joined.select("doc_id", "text", "__label")).mapInArrow(run, schema).toArrow()
    terms = got.column("terms").combine_chunks()
    ends, flat = np.asarray(terms.offsets), terms.values.to_numpy()
    order = np.lexsort((np.diff(ends), got.column("doc_id").to_numpy()))
    return [np.sort(flat[ends[i] : ends[i + 1]]) for i in order], got.column("label").to_numpy()[order]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", limit: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """The machine of the labelled rows, of which it reads about ``limit`` at most and never a held-out one.

    Null ids and labels are left out, of several labels of an id the largest
    counts, and a document that repeats an id is a row of its own.  Null and
    empty texts are rows without terms.  Without rows of both labels the machine
    gives every text the share of ones, a half for an empty table.
    """
    rows, y = labelled_terms(docs, labels, label, limit, id_col, text_col)
    return fit(rows, y)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Add the score of every whole text, from 0 to 1.

    Null and empty texts get the score of a text without terms.  Repeated rows
    get equal scores.  A column named ``score_col`` is replaced.
    """
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = extended(base, **{score_col: DoubleType()})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS

    def run(batches):
        machine = sent.value
        for b in batches:
            texts = b.column(b.schema.names.index(text_col))
            scores = machine.score([terms_of(t.as_py()) for t in texts])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*keep, score_col])

    return batched(base).mapInArrow(run, schema)
