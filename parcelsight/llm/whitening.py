"""Embedding whitening by spectrum slicing.

Entries become whole numbers, and each distinct vector counts once. Of their covariance, an LDL
factorisation of ``V - shift`` counts the eigenvalues above a shift (Sylvester's law of inertia):
bisection by counts encloses each leading eigenvalue alone, Rayleigh quotient iteration converges
cubically within the enclosure, and two more counts certify the number it bears.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelsight.llm.shared import bounded_batches, written

COMPONENTS = 4
STEPS = 256
#: An eigenvalue below this part of the trace is rounding; its component isn't returned.
FLAT = 1e-12
LARGEST = 2**63 - 1
#: Widths that whole numbers are stored in: the first that holds a vector, so equal vectors have
#: equal bytes.
WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def steps_of(vector) -> np.ndarray | None:
    """floor(256 c) of every entry; None for null, nulls, non-finite or beyond 64 bits."""
    if vector is None:
        return None
    c = np.array([np.nan if e is None else e for e in vector], np.float64) if isinstance(
        vector, list) else np.asarray(vector, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(STEPS * c)
        if not (np.isfinite(x) & (np.abs(x) < 2.0**63)).all():
            return None
    return x.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    lo, hi = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for k, width in enumerate(WIDTHS):
        bound = np.iinfo(width)
        if bound.min <= lo and hi <= bound.max:
            return bytes([k]) + x.astype(width).tobytes()
    raise AssertionError("64 bits hold every vector")


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[data[0]], offset=1).astype(np.int64)


# -- eigenvalues of one symmetric matrix -------------------------------------------------------

def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``.

    The signs of D in an LDL factorisation of v - shift, with Bunch and Kaufman's pivots of one
    or two rows.
    """
    a = v - shift * np.eye(len(v))
    alpha, above, k, n = (1 + np.sqrt(17)) / 8, 0, 0, len(a)
    while k < n:
        size, swap = 1, k
        column = np.abs(a[k + 1:, k])
        top = column.max() if len(column) else 0.0
        if top > 0 and abs(a[k, k]) < alpha * top:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            widest = row.max()
            if abs(a[k, k]) * widest >= alpha * top * top:
                pass
            elif abs(a[r, r]) >= alpha * widest:
                swap = r
            else:
                size, swap = 2, r
        at = k + size - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if size == 1:
            d = a[k, k]
            above += int(d > 0)
            if d != 0 and k + 1 < n:
                column = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(column, column / d)
        else:
            d = a[k:k + 2, k:k + 2].copy()
            above += 1 if np.linalg.det(d) < 0 else 2 * int(d[0, 0] + d[1, 1] > 0)
            if k + 2 < n:
                columns = a[k + 2:, k:k + 2].copy()
                a[k + 2:, k + 2:] -= columns @ np.linalg.solve(d, columns.T)
        k += size
    return above


def _solved(v: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    for _ in range(3):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), b)
        except np.linalg.LinAlgError:
            y = np.full(len(b), np.inf)
        if np.isfinite(y).all() and np.abs(y).max() > 0:
            return y / np.linalg.norm(y)
        shift += 4 * np.finfo(float).eps * scale
    return b


def leading(v: np.ndarray, k: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``k`` largest eigenvalues of a covariance ``v`` with unit eigenvectors, falling.

    Equal eigenvalues have any orthogonal vectors. Those that are rounding only are left out.
    """
    n, scale = len(v), float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    if not scale > 0:
        return []
    eps = np.finfo(float).eps * scale
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(v, shift)
        return counts[shift]

    found: list[tuple[float, np.ndarray]] = []
    floor = FLAT * float(np.trace(v))
    for number in range(1, min(k, n) + 1):
        if above(floor) < number:
            break
        lo, hi = floor, scale * (1 + 4 * np.finfo(float).eps) + eps
        for at, c in counts.items():  # earlier counts narrow the enclosure
            lo, hi = (max(lo, at), hi) if c >= number else (lo, min(hi, at))
        while hi - lo > 8 * n * eps and not (above(lo) == number and above(hi) == number - 1):
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if above(middle) >= number else (lo, middle)
        # bisect on while the iteration leaves the enclosure: it then found a neighbour
        while True:
            x = np.cos(np.arange(1, n + 1) * (number + 0.5))
            shift = (lo + hi) / 2
            for _ in range(3):
                for _, w in found:
                    x -= (w @ x) * w
                x = _solved(v, shift, x / np.linalg.norm(x), scale)
            for _ in range(8):
                for _, w in found:
                    x -= (w @ x) * w
                x /= np.linalg.norm(x)
                e = float(x @ v @ x)
                if np.linalg.norm(v @ x - e * x) <= 4 * eps:
                    break
                x = _solved(v, e, x, scale)
            for _, w in found:
                x -= (w @ x) * w
            x /= np.linalg.norm(x)
            e = float(x @ v @ x)
            slack = 16 * n * eps
            certain = above(e - slack) >= number > above(e + slack)
            if certain or hi - lo <= 8 * n * eps:
                break
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if above(middle) >= number else (lo, middle)
        found.append((e, x))
    return found


# -- distributed part ---------------------------------------------------------------------------

@dataclass
class Whitening:
    """Per number of dimensions: size and sums of the fit list, components, their eigenvalues."""
    n: dict[int, int] = field(default_factory=dict)
    sums: dict[int, list[int]] = field(default_factory=dict)
    values: dict[int, np.ndarray] = field(default_factory=dict)
    vectors: dict[int, np.ndarray] = field(default_factory=dict)
    trace: dict[int, float] = field(default_factory=dict)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for rows ``x``: whole numbers, as 64 bits where they fit."""
        d = x.shape[1]
        n, sums = self.n[d], self.sums[d]
        most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
        if d * most * most <= LARGEST:
            return n * x - np.array(sums, np.int64)
        return n * x.astype(object) - np.array(sums, object)

    def project(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        return (self.centred(x).astype(np.float64) / self.n[d]) @ self.vectors[d] / np.sqrt(
            self.values[d])


def _by_dimension(data: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) of the packed vectors, a matrix for each number of dimensions."""
    x = [unpacked(b) for b in data]
    sizes = np.array([len(v) for v in x], int)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        if d:
            yield at, np.stack([x[i] for i in at])


def _distinct(rows: DataFrame) -> DataFrame:
    return written(rows.select("x").distinct(), "fit")


def fit(distinct: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct packed vectors ``x``.

    The driver gets sums and components, a few numbers a dimension. The covariance is summed in
    blocks of rows and factorised in one task a dimension: its size is that of the dimensions
    squared, whatever the number of vectors.
    """
    spark, model = distinct.sparkSession, Whitening()

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for at, x in _by_dimension(batch["x"]):
                n, s = sums.get(x.shape[1], (0, 0))
                exact = x if np.abs(x.astype(float)).sum() < 2.0**62 else x.astype(object)
                sums[x.shape[1]] = n + len(at), s + exact.sum(axis=0).astype(object)
        for d, (n, s) in sums.items():
            yield pd.DataFrame({"d": d, "i": np.arange(-1, d), "s": [str(v) for v in (n, *s)]})

    parts = distinct.mapInPandas(totals, "d int, i int, s string")
    for r in (parts.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
              .orderBy("d", "i").collect()):  # a number a dimension
        if r["i"] < 0:
            model.n[r["d"]], model.sums[r["d"]] = int(r["s"]), []
        else:
            model.sums[r["d"]].append(int(r["s"]))
    sent = spark.sparkContext.broadcast(model)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_dimension(batch["x"]):
                d = x.shape[1]
                c = sent.value.centred(x).astype(np.float64) / sent.value.n[d]
                sums[d] = sums.get(d, 0) + c.T @ c
        for d, m in sums.items():
            for i in range(d):  # the lower half, a row at a time
                yield pd.DataFrame({"d": d, "i": i, "j": np.arange(i + 1), "v": m[i, :i + 1]})

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        d = int(batch["d"].iloc[0])
        v = np.zeros((d, d))
        v[batch["i"], batch["j"]] = batch["v"] / sent.value.n[d]
        v = np.tril(v) + np.tril(v, -1).T
        found = leading(v, k)
        return pd.DataFrame({
            "d": d, "number": np.arange(1, len(found) + 1), "e": [e for e, _ in found],
            "trace": float(np.trace(v)),
            "vector": pd.Series([x for _, x in found], dtype=object)})

    halves = distinct.mapInPandas(products, "d int, i int, j int, v double").groupBy(
        "d", "i", "j").agg(F.sum("v").alias("v"))
    solved = halves.groupBy("d").applyInPandas(
        solve, "d int, number int, e double, trace double, vector array<double>")
    for r in solved.orderBy("d", "number").collect():  # k rows a dimension
        d = r["d"]
        model.trace[d] = r["trace"]
        model.values[d] = np.append(model.values.get(d, []), r["e"])
        column = np.array(r["vector"])[:, None]
        model.vectors[d] = np.hstack((model.vectors[d], column)) if d in model.vectors else column
    return model


def _identity_errors(distinct: DataFrame, model: Whitening) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, x in _by_dimension(batch["x"]):
                if x.shape[1] in sent.value.values:
                    yield pd.DataFrame({"d": x.shape[1], "w": list(sent.value.project(x))})

    most = max((len(v) for v in model.values.values()), default=0)
    if not most:
        return {}
    w = written(distinct.mapInPandas(project, "d int, w array<double>"), "whitened")
    mean = w.groupBy("d").agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(most)])
    pairs = [(i, j) for i in range(most) for j in range(i + 1)]
    part = lambda i: F.get("w", F.lit(i)) - F.col(f"m{i}")
    # ``mean`` has a row for each number of dimensions
    errors = w.join(F.broadcast(mean), "d").groupBy("d").agg(F.greatest(
        F.lit(0.0), *[F.coalesce(F.abs(F.avg(part(i) * part(j)) - float(i == j)), F.lit(0.0))
                      for i, j in pairs]).alias("error"))
    return {r["d"]: r["error"] for r in errors.collect()}


def whiten(vectors: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, dims.

    A row for each vector and component up to ``k``. Rows whose vector is null, or holds null,
    non-finite or entries beyond 64 bits once multiplied by 256, are dropped; empty vectors have
    no components. Vectors of different numbers of dimensions have a fit list, components and
    identity error each. Copies count once in the fit list and are returned each, as are rows
    repeated with one id or with a null id. Components without variance (fewer distinct vectors
    than components) aren't returned. ``deviation`` is null beyond 64 bits. No rows: no rows.
    Further columns are left out.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            steps = map(steps_of, batch)
            yield pd.Series([None if x is None else packed(x) for x in steps], dtype=object)

    rows = written(vectors.select(F.col(vec_id).alias("vec_id"), pack(F.col(embedding)).alias("x"))
                   .where("x IS NOT NULL"), "steps")
    distinct = _distinct(rows)
    model = fit(distinct, k)
    errors = _identity_errors(distinct, model)
    sent = spark.sparkContext.broadcast((model, errors))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, errors = sent.value
        for batch in batches:
            for at, x in _by_dimension(batch["x"]):
                d = x.shape[1]
                if d not in model.values:
                    continue
                c = model.centred(x)
                total = (c * c).sum(axis=1)
                w = model.project(x)
                for j in range(w.shape[1]):
                    yield pd.DataFrame({
                        "vec_id": batch["vec_id"].iloc[at].astype("Int64"), "component": j + 1,
                        "n": model.n[d],
                        "deviation": pd.array([int(t) if t <= LARGEST else None for t in total],
                                              "Int64"),
                        "whitened": w[:, j], "explained": model.values[d][j] / model.trace[d],
                        "identity_error": errors[d], "dims": d})

    return rows.mapInPandas(
        score, "vec_id long, component int, n long, deviation long, whitened double, "
               "explained double, identity_error double, dims int")
