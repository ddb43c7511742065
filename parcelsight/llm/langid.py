"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, all else is a blank; n-grams of one to three characters are hashed into
``BUCKETS`` columns. Document frequencies count all learnable documents. The weights are fitted by
follow-the-regularised-leader with L1 and L2 penalties, on a bounded sample dealt over a fixed
number of shards whose weights are averaged, and one temperature is fitted on a part of the
sample that the weights haven't seen.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, fresh, held_out, release, written

BUCKETS = 1 << 15
#: Documents of each language that the weights are fitted on, at most about that many.
SAMPLE_PER_LANGUAGE = 1200
SHARDS, EPOCHS, ALPHA, BETA, L1, L2 = 3, 2, 0.5, 1.0, 2e-4, 1e-4
#: Code points handled at once; longer texts go by pieces that overlap by two.
PIECE = 1 << 20
#: Documents whose best language is less likely than this are rejected by the pipeline.
MIN_SCORE = 0.3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """True for the code points of category L."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool,
                       0x110000)


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(buckets, counts, whether there is a letter) of a whole text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    total, any_letter = np.zeros(BUCKETS, np.int64), False
    for at in range(0, len(points), PIECE):
        c = points[max(0, at - 2):at + PIECE]
        alpha = _letters()[c]
        any_letter |= bool(alpha.any())
        c = np.where(alpha, c, 32).astype(np.uint32)
        skip = min(at, 2)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for k, grams in enumerate((one, two, three)):
            grams = grams[max(0, skip - k):]  # those that end in the piece before are counted
            total += np.bincount((grams ^ (grams >> 15)) >> 17, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found], any_letter


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights [BUCKETS, classes] of FTRL-proximal over ``rows`` of (columns, values, class)."""
    # only buckets that occur have weights other than zero
    seen = np.unique(np.concatenate([at for at, _, _ in rows])) if rows else np.empty(0, int)
    rows = [(np.searchsorted(seen, at), x, y) for at, x, y in rows]
    z, n = np.zeros((len(seen), classes)), np.zeros((len(seen), classes))

    def weights(at):
        zi, ni = z[at], n[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    out = np.zeros((BUCKETS, classes), np.float32)
    out[seen] = weights(slice(None))
    return out


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, 1 where there is nothing to fit it on."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 120)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
            for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; ``und`` and 0 for null, texts without letters, no model."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        found, counts, any_letter = count_ngrams(text)
        if not any_letter:
            return UNKNOWN, 0.0
        p = softmax(weigh(found, counts, self.idf) @ self.weights[found] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of texts."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for t in batch[text]:
                seen[count_ngrams(t or "")[0]] += 1
                seen[BUCKETS] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": at, "n": seen[at]})

    total = np.zeros(BUCKETS + 1, np.int64)
    parts = rows.select(text).mapInPandas(partial, "bucket long, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 at most
        total[r["bucket"]] = r["n"]
    return total[:BUCKETS], int(total[BUCKETS])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
          ) -> LanguageModel:
    """A model learned from the texts with a language outside the held-out fifth."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    sizes = {r[0]: r["count"] for r in known.groupBy(F.col(lang).alias("l")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), 1.0)
    seen, n = _frequencies(known, text)
    idf = np.log((1 + n) / (1 + seen)) + 1

    rank = F.xxhash64(F.col(doc_id), F.col(text), F.lit(7))
    share = F.create_map(*[F.lit(x) for k in languages
                           for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / sizes[k]))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    taken = (
        known.where((rank / F.lit(2.0**64) + 0.5) < share[F.col(lang)])
        .select(rank.alias("rank"), F.coalesce(text, F.lit("")).alias("text"),
                number[F.col(lang)].alias("y")))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            found = [count_ngrams(t) for t in batch["text"]]
            yield pd.DataFrame({
                "rank": batch["rank"], "y": batch["y"],
                "at": [f.astype(np.int32) for f, _, _ in found],
                "x": [weigh(f, c, idf).astype(np.float32) for f, c, _ in found]})

    # texts stay where they are; a row that is repeated counts once
    sample = written(
        taken.mapInPandas(features, "rank long, y int, at array<int>, x array<float>")
        .groupBy("rank", "y").agg(F.first("at").alias("at"), F.first("x").alias("x")), "sample")
    classes, tuning = len(languages), F.pmod(F.col("rank"), F.lit(10)) == 0

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("rank")
        w = ftrl([(np.asarray(a), np.asarray(x, float), int(y))
                  for a, x, y in zip(batch["at"], batch["x"], batch["y"], strict=True)], classes)
        return pd.DataFrame({"n": [len(batch)], "w": [w.tobytes()]})

    shards = (
        sample.where(~tuning)
        .groupBy(F.pmod(F.xxhash64("rank"), F.lit(SHARDS)).alias("shard"))
        .applyInPandas(fit, "n long, w binary").collect())  # SHARDS rows of the model's size
    weights = np.zeros((BUCKETS, classes), np.float32)
    for r in shards:
        weights += r["n"] * np.frombuffer(r["w"], np.float32).reshape(BUCKETS, classes)
    weights /= np.float32(max(1, sum(r["n"] for r in shards)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "z": [
                np.asarray(x, float) @ weights[np.asarray(a)]
                for a, x in zip(batch["at"], batch["x"], strict=True)]})

    tuned = sample.where(tuning).mapInPandas(score, "y int, z array<double>").collect()
    return LanguageModel(
        languages, idf, weights, temperature(
            np.array([r["z"] for r in tuned]), np.array([r["y"] for r in tuned], int)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text"):
    """A column of struct(lang_pred, score) for every whole text of ``docs``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a few languages

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts],
                               columns=["lang_pred", "score"])

    return best(F.col(text))


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text"
            ) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Null texts, empty ones and those without a letter are ``und`` with score 0, as is everything
    where no document has a language to learn from. Ties go to the first language by name;
    repeated rows are predicted each. A null id counts as held out. Further columns are left out.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
        identify(docs, model, text).alias("found")).select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text",
                    min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``min_score``."""
    found = fresh(docs, "found")
    return (docs.withColumn(found, identify(docs, model, text))
            .where((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= min_score))
            .drop(found))
