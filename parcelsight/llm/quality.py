"""Quality: a generalised additive model with pairwise interactions.

Boosting goes round the features; each step fits a shallow tree on one feature's bins to the
gradient and adds a part of it to that feature's lookup table. The strongest pairs of features
then get tables of their own in the same way. Several bags are fitted in parallel tasks and their
tables averaged. A score is the sum of table cells.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, held_out, written

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 12_000
BAGS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 3, 120, 6, 50, 0.15
BINS, PAIR_BINS, LEAST_IN_LEAF = 32, 8, 20
CUTOFF = 0.3

FEATURES = (
    "log_words", "word_length", "short_words", "long_words", "distinct_words", "top_word",
    "repeats", "upper", "digits", "symbols", "symbol_runs", "bars", "blanks", "line_words",
    "line_copies", "char_entropy", "sentence_ends", "capitalised")
_RUN = re.compile(r"([^\w\s])\1")


def measure(text: str | None) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    words, n = text.split(), len(text)
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, int)
    counts = Counter(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8),
                      minlength=256)
    share = raw[raw > 0] / raw.sum()
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(len(words))), float(sizes.mean()), float((sizes <= 3).mean()),
        float((sizes >= 14).mean()), len(counts) / w, max(counts.values(), default=0) / w,
        sum(a == b for a, b in pairwise(words)) / w, upper / max(1, upper + lower),
        raw[48:58].sum() / n, marks / n, sum(1 for _ in _RUN.finditer(text)) / w, raw[124] / w,
        (raw[32] + raw[9:14].sum()) / n, float(np.log1p(len(words) / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), float(-(share * np.log2(share)).sum()),
        (raw[46] + raw[33] + raw[63]) / w, sum(x[0].isupper() for x in words) / w]


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of ``depth`` over ordered bins, from gradient sums by bin."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
    gain[(nl < LEAST_IN_LEAF) | (nr < LEAST_IN_LEAF)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum()**2 / (h.sum() + 1) + 1e-9:
        return value
    k += 1
    return np.concatenate((_tree(g[:k], h[:k], n[:k], depth - 1),
                           _tree(g[k:], h[k:], n[k:], depth - 1)))


def _square(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of a cut along one side and a cut along the other on each half, and its gain."""
    best, gain = None, -1.0
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        a, b = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        for k in range(len(a) - 1):
            out, total = np.empty((len(a), a.shape[1])), 0.0
            for rows, ga, hb in ((slice(0, k + 1), a[k], b[k]),
                                 (slice(k + 1, None), a[-1] - a[k], b[-1] - b[k])):
                gl, hl, gr, hr = ga[:-1], hb[:-1], ga[-1] - ga[:-1], hb[-1] - hb[:-1]
                split = gl**2 / (hl + 1) + gr**2 / (hr + 1)
                c = int(split.argmax())
                total += split[c]
                out[rows, :c + 1], out[rows, c + 1:] = gl[c] / (hl[c] + 1), gr[c] / (hr[c] + 1)
            if total > gain:
                best, gain = (out.T if turn else out), total
    return best, gain


@dataclass
class QualityModel:
    edges: list[np.ndarray]
    intercept: float
    tables: np.ndarray  # [features, BINS]
    pairs: dict[tuple[int, int], np.ndarray]  # [PAIR_BINS, PAIR_BINS]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features, by additions over bins."""
        bins = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)
        z = self.intercept + self.tables[np.arange(x.shape[1]), bins].sum(axis=1)
        for (a, b), table in self.pairs.items():
            z += table[_coarse(bins[:, a]), _coarse(bins[:, b])]
        return 1 / (1 + np.exp(-z))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // BINS


def boost(bins: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, dict]:
    """(intercept, tables, pair tables) fitted on binned features and labels 0 or 1."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    z, tables = np.full(len(y), start), np.zeros((bins.shape[1], BINS))
    count = [np.bincount(bins[:, f], minlength=BINS) for f in range(bins.shape[1])]
    for _ in range(ROUNDS):
        for f in range(bins.shape[1]):
            p = 1 / (1 + np.exp(-z))
            add = RATE * _tree(np.bincount(bins[:, f], y - p, BINS),
                               np.bincount(bins[:, f], p * (1 - p), BINS), count[f])
            tables[f] += add
            z += add[bins[:, f]]

    coarse = _coarse(bins)

    def grid(a, b):
        p, at = 1 / (1 + np.exp(-z)), coarse[:, a] * PAIR_BINS + coarse[:, b]
        shape = (PAIR_BINS, PAIR_BINS)
        return (np.bincount(at, y - p, PAIR_BINS**2).reshape(shape),
                np.bincount(at, p * (1 - p), PAIR_BINS**2).reshape(shape))

    every = [(a, b) for a in range(bins.shape[1]) for b in range(a)]
    strongest = sorted(every, key=lambda ab: -_square(*grid(*ab))[1])[:PAIRS]
    pairs = {ab: np.zeros((PAIR_BINS, PAIR_BINS)) for ab in strongest}
    for _ in range(PAIR_ROUNDS):
        for a, b in strongest:
            add = RATE * _square(*grid(a, b))[0]
            pairs[a, b] += add
            z += add[coarse[:, a], coarse[:, b]]
    return start, tables, pairs


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"rank": batch["rank"], "y": batch["y"],
                            "x": [measure(t) for t in batch["text"]]})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
          ) -> QualityModel:
    """A model of ``labels`` (doc_id, quality), from at most ``SAMPLE`` labelled documents.

    Labels other than 0 and 1 and those of the held-out fifth are never read. Documents labelled
    several times count once with each label. Without labels every score is one half.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"),
                F.xxhash64("doc_id", F.lit(3)).alias("rank"))
        .distinct().orderBy("rank", "y").limit(SAMPLE))
    found = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
             .join(F.broadcast(known), F.col("id") == F.col("labelled"))  # SAMPLE rows at most
             .select("rank", "y", "text"))
    sample = written(found.mapInPandas(
        _measured, "rank long, y double, x array<double>").orderBy("rank", "y", "x")
        .limit(SAMPLE), "sample")

    steps = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = sample.agg(*[F.percentile(F.col("x")[f], steps).alias(f"c{f}")
                        for f in range(len(FEATURES))]).first()
    if cuts["c0"] is None:
        none = np.zeros((len(FEATURES), BINS))
        return QualityModel([np.zeros(BINS - 1)] * len(FEATURES), 0.0, none, {})
    edges = [np.asarray(c) for c in cuts]

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        bag = int(batch["bag"].iloc[0])
        batch = batch.sort_values(["rank", "y"])
        x = np.array(batch["x"].tolist())
        bins = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1)
        pick = np.random.default_rng(bag).integers(0, len(bins), len(bins))
        start, tables, pairs = boost(bins[pick], batch["y"].to_numpy()[pick])
        rows = [(-1, -1, [start]), *[(f, -1, t) for f, t in enumerate(tables)],
                *[(a, b, t.reshape(-1)) for (a, b), t in pairs.items()]]
        return pd.DataFrame(rows, columns=["a", "b", "cells"])

    bags = sample.withColumn("bag", F.explode(F.array(*map(F.lit, range(BAGS)))))
    intercept, tables, pairs = 0.0, np.zeros((len(FEATURES), BINS)), {}
    fitted = bags.groupBy("bag").applyInPandas(fit, "a int, b int, cells array<double>")
    for r in fitted.collect():  # BAGS models of tables
        cells = np.asarray(r["cells"]) / BAGS
        if r["a"] < 0:
            intercept += float(cells[0])
        elif r["b"] < 0:
            tables[r["a"]] += cells
        else:
            ab, table = (r["a"], r["b"]), cells.reshape(PAIR_BINS, PAIR_BINS)
            pairs[ab] = pairs.get(ab, 0) + table
    return QualityModel(edges, intercept, tables, pairs)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text"
          ) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts are empty ones and have a score like any other; repeated rows are scored each. A
    null id counts as held out. Further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([measure(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.scores(x))

    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                        of(text).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))
