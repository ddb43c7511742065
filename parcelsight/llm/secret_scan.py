"""Secrets: fixed formats, and strings that a Markov model of random text explains better.

First-order character models are counted over all documents: one for each fixed format, from the
strings that it labels as secrets, and one from ordinary words, run together as identifiers are. A
long token outside the fixed formats is a secret when the mean log-likelihood ratio of its
characters reaches a threshold, which is chosen on texts that the models haven't learned from.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, release

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET) + 1  # 0 stands for every other character, a token's start and end
#: Shortest token that the models are asked about, and the share of ordinary identifiers held out
#: of training that may score as high as a secret.
MIN_TOKEN, FALSE_HITS = 20, 1e-4
BACK_OFF = 100.0
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_TOKEN)
MASK = "[SECRET]"

_CODES = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i + 1


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed formats, by start and kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text)
                  if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def transitions(text: str) -> np.ndarray:
    """Counts of character pairs, flattened; characters of several bytes count as one other."""
    code = _CODES[np.frombuffer(f" {text} ".encode("latin-1", "replace"), np.uint8)]
    return np.bincount(code[:-1] * SIZE + code[1:], minlength=SIZE * SIZE)


#: Characters that random strings of a fixed format are drawn from, whichever of them were seen.
DRAWN_FROM = (ALPHABET, ALPHABET[:26] + "0123456789", "0123456789abcdef")
#: Scores are counted in steps of this size when the threshold is chosen.
STEP, LOWEST, STEPS = 0.02, -10.0, 1000
_PLAIN = re.compile("[A-Za-z0-9]+")
JOINED_BY = ("_", "-", ".", "")


def identifiers(text: str) -> list[str]:
    """Ordinary tokens of ``MIN_TOKEN`` characters and more: the words of a text, run together as
    names of files, variables and paths are."""
    out, held, size = [], [], 0
    for w in _PLAIN.findall(text):
        held.append(w)
        size += len(w) + 1
        if size > MIN_TOKEN:
            joint = JOINED_BY[len(out) % 4]
            token = joint.join(held if joint else [x.capitalize() for x in held])
            if len(token) >= MIN_TOKEN:
                out.append(token)
                held, size = [], 0
    return out


def _backed_off(c: np.ndarray) -> np.ndarray:
    """Transition probabilities; those seldom seen fall back on how often a character occurs."""
    single = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * SIZE)
    return (c + BACK_OFF * single) / (c.sum(axis=1, keepdims=True) + BACK_OFF)


def log_ratios(counts: np.ndarray) -> np.ndarray | None:
    """[kind, transition]: log-likelihood ratio of random strings of each fixed format over
    ordinary identifiers, from counts [ordinary and each kind, transition]; None without secrets."""
    if not counts[1:].any():
        return None
    ordinary = _backed_off(counts[0].reshape(SIZE, SIZE))
    out = []
    for kind, drawn in zip(counts[1:], DRAWN_FROM):
        uniform = np.full(SIZE, 1e-4)
        uniform[[_CODES[ord(c)] for c in drawn]] = 1.0
        # half is learned from the labelled strings, half is uniform over their alphabet
        learned = _backed_off(kind.reshape(SIZE, SIZE)) if kind.any() else uniform / uniform.sum()
        out.append(np.log(0.5 * learned + 0.5 * uniform / uniform.sum()) - np.log(ordinary))
    return np.stack(out).reshape(len(DRAWN_FROM), -1)


def scores(ratios: np.ndarray | None, tokens: list[str]) -> np.ndarray:
    """Mean log-likelihood ratio of each token's characters, of the kind of random string that fits
    best. Tokens are ASCII without blanks."""
    if ratios is None or not tokens:
        return np.full(len(tokens), -np.inf)
    code = _CODES[np.frombuffer((" " + " ".join(tokens)).encode(), np.uint8)]
    each = ratios[:, code[:-1] * SIZE + code[1:]]
    sizes = np.array([len(t) for t in tokens])
    first = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    each[:, first[1:] - 1] = 0  # from one token's end to the blank
    return (np.add.reduceat(each, first, axis=1) / sizes).max(axis=0)


@dataclass
class SecretModel:
    """Log-ratios of transitions (None where no secret was there to learn from), the least score
    of a secret, and the shares of labelled secrets and of ordinary identifiers that reach it,
    both measured on texts that the ratios weren't learned from."""
    ratios: np.ndarray | None
    threshold: float = np.inf
    recall: float = 0.0
    false_hits: float = 0.0

    def score(self, token: str) -> float:
        return float(scores(self.ratios, [token])[0])

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all secrets of a whole text, by start and kind."""
        if not text:
            return []
        base = [(s, k, e) for s, k, e, _ in base_spans(text)]
        more, at, covered = [], 0, 0
        for m in _TOKEN.finditer(text):  # both go by start, so each is walked once
            while at < len(base) and base[at][0] < m.end():
                covered = max(covered, base[at][2])
                at += 1
            if covered <= m.start() and self.score(m.group()) >= self.threshold:
                more.append((m.start(), 3, m.end()))
        return sorted(base + more)


def _half(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def train(docs: DataFrame, text: str = "text") -> SecretModel:
    """The models, from the whole texts of all documents.

    Transitions are counted apart in two halves of the texts. Each half's labelled secrets and
    ordinary identifiers are scored by the other half's models; the threshold lies between the two
    or, where they overlap, where ``FALSE_HITS`` of the identifiers reach it.
    """
    kinds = 1 + len(DRAWN_FROM)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = np.zeros((2, kinds, SIZE * SIZE), np.int64)
        for batch in batches:
            for t in batch[text]:
                if not t:
                    continue
                half, at, rest = _half(t), 0, []
                for begin, kind, end, start in base_spans(t):
                    total[half, 1 + kind] += transitions(t[start:end])
                    rest.append(t[at:max(at, begin)])
                    at = max(at, end)
                total[half, 0] += transitions(" ".join(identifiers(" ".join([*rest, t[at:]]))))
        found = np.flatnonzero(total)
        yield pd.DataFrame({"at": found, "n": total.reshape(-1)[found]})

    bounded_batches(docs.sparkSession)
    counts = np.zeros(2 * kinds * SIZE * SIZE)
    parts = docs.select(text).mapInPandas(counted, "at long, n long")
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 8 * SIZE^2 rows at most
        counts[r["at"]] = r["n"]
    counts = counts.reshape(2, kinds, -1)
    ratios = log_ratios(counts.sum(axis=0))
    if ratios is None:
        return SecretModel(None)
    by_other = [log_ratios(counts[1]), log_ratios(counts[0])]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, STEPS), np.int64)
        for batch in batches:
            for t in batch[text]:
                if not t or by_other[_half(t)] is None:
                    continue
                base, at, rest = base_spans(t), 0, []
                for begin, _, end, _ in base:
                    rest.append(t[at:max(at, begin)])
                    at = max(at, end)
                secrets = [t[start:end] for _, _, end, start in base if end - start >= MIN_TOKEN]
                for kind, tokens in enumerate((identifiers(" ".join([*rest, t[at:]])), secrets)):
                    x = (scores(by_other[_half(t)], tokens) - LOWEST) / STEP
                    np.add.at(total[kind], np.clip(x, 0, STEPS - 1).astype(int), 1)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"at": found, "n": total.reshape(-1)[found]})

    found = np.zeros(2 * STEPS)
    parts = docs.select(text).mapInPandas(scored, "at long, n long")
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2 * STEPS rows at most
        found[r["at"]] = r["n"]
    # share of scores in or above each step
    ordinary, secret = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in found.reshape(2, -1))
    lowest = int(np.argmax(np.append(ordinary, 0) <= FALSE_HITS))
    most = int(np.flatnonzero(np.append(1, secret) >= 0.99)[-1]) - 1  # 99 of 100 secrets reach it
    at = min(STEPS - 1, (lowest + most) // 2 if most > lowest else lowest)
    return SecretModel(ratios, LOWEST + STEP * at, float(secret[at]), float(ordinary[at]))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(docs: DataFrame, model: SecretModel, text: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE^2 numbers

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = shared.value.spans(t)
                base = [x for x in spans if x[1] < 3]
                kinds = [x[1] for x in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            yield pd.DataFrame(rows, columns=[
                "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(F.col(text))


def scan(docs: DataFrame, model: SecretModel, doc_id: str = "doc_id", text: str = "text"
         ) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``.

    Spans are kind:start:end in code points, by start and kind, joined by commas; null and empty
    texts have none. Repeated rows are scanned each. Where no document holds a secret of a fixed
    format there is nothing to learn from, and the models add none. Further columns are left out.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), _found(docs, model, text).alias("found")
                       ).select("doc_id", "found.*")


def masked(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``MASK``; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mask(t: str | None) -> str | None:
        out, at = [], 0
        for s, _, e in shared.value.spans(t):
            if s >= at:
                out += [t[at:s], MASK]
            at = max(at, e)
        return t if not at else "".join(out) + t[at:]

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in batches:
            yield texts.map(mask)

    return docs.withColumn(text, clean(F.col(text)))
