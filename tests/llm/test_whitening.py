"""Eigenpairs against numpy; the query's columns against a plain computation; edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelsight.llm import whitening
from parcelsight.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>"


def matrices(d, rng):
    a, b = rng.normal(size=(d + 3, d)), rng.normal(size=(min(2, d), d))
    yield a.T @ a
    yield np.eye(d) * 3.0  # one eigenvalue, d times
    yield b.T @ b  # of rank two
    yield np.diag(np.arange(d, 0, -1.0) ** 6)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = (q * np.r_[5.0, 5.0, 5.0, np.ones(max(0, d - 3))][:d]) @ q.T
    yield (v + v.T) / 2


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64])
def test_spectrum_slicing(d):
    for v in matrices(d, np.random.default_rng(d)):
        e = np.linalg.eigvalsh(v)[::-1]
        for shift in (e.mean(), e[0] * 0.99, (e[0] + e[-1]) / 2):
            if np.abs(e - shift).min() > 1e-9 * e[0]:
                assert whitening.count_above(v, shift) == (e > shift).sum()
        found = whitening.leading(v, 4)
        want = e[:4][e[:4] > 1e-12 * e.sum()]
        assert np.allclose([x for x, _ in found], want, rtol=1e-12, atol=0)
        x = np.stack([w for _, w in found], axis=1)
        assert np.abs(x.T @ x - np.eye(len(found))).max() < 1e-12
        assert np.abs(v @ x - x * want).max() < 1e-12 * e[0]


def test_close_eigenvalues_keep_their_numbers():
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(12, 12)))
    e = np.r_[1 + 1e-9, 1.0, 1 - 1e-9, 0.5, np.linspace(0.1, 0.2, 8)]
    v = (q * e) @ q.T
    found = whitening.leading((v + v.T) / 2, 4)
    assert np.allclose([x for x, _ in found], e[:4], rtol=1e-13, atol=0)


def plain(x):
    """(n, deviations, whitened, explained) of rows of whole numbers."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / np.trace(v)


def test_query_against_numpy(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(rows["embedding"]).astype(float)).astype(int)
    n, deviation, whitened, explained = plain(x)
    got = op11_whitening(spark, folder).toPandas()
    assert len(got) == 4 * len(rows)
    for k in range(4):
        part = got[got["component"] == k + 1].set_index("vec_id").loc[rows["vec_id"]]
        sign = np.sign((part["whitened"] * whitened[:, k]).sum())
        assert np.allclose(sign * part["whitened"], whitened[:, k], rtol=0, atol=1e-8)
        assert (part["deviation"] == deviation).all() and (part["n"] == n).all()
        assert np.allclose(part["explained"], explained[k], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_dropped_rows_copies_and_clashes(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, -0.1]), (2, [0.1, 0.9, 0.3]), (2, [0.1, 0.9, 0.3]), (None, [0.0, -1.0, 2.0]),
            (4, [0.7, 0.2, 0.2]), (5, [1.5, 0.25, 0.4])]
    bad = [(10, None), (11, [0.1, None, 0.2]), (12, [nan, 0.1, 0.2]), (13, [0.1, inf, 0.2]), (14, []),
           (15, [3e38, 0.0, 0.0])]
    frame = spark.createDataFrame(good + bad, SCHEMA).withColumn("x", F.lit("x")).withColumn(
        "component", F.lit(7)).repartition(3)
    got = whitening.whiten(frame).toPandas()
    n, deviation, whitened, _ = plain(np.array([np.floor(256 * np.float32(v).astype(float))
                                                for _, v in good]).astype(int))
    assert n == 5 and len(got) == 3 * len(good)
    assert sorted(got["deviation"]) == sorted(list(deviation) * 3)
    assert np.allclose(sorted(got["whitened"].abs()), sorted(np.abs(whitened).reshape(-1)))
    assert got["vec_id"].isna().sum() == 3 and got["identity_error"].max() < 1e-10


def test_no_rows_one_vector_and_two_sizes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert whitening.whiten(same).count() == 0  # no variance, no component
    both = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, [2.0]), (5, [4.0])], SCHEMA)
    got = whitening.whiten(both).toPandas()
    assert sorted(zip(got["dims"], got["vec_id"], got["n"])) == [
        (1, 3, 3), (1, 4, 3), (1, 5, 3), (2, 1, 2), (2, 2, 2)]


def test_deviation_beyond_64_bits_is_null(spark):
    frame = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0])], SCHEMA)
    got = whitening.whiten(frame).toPandas()
    assert len(got) == 2 and got["deviation"].isna().all()
    assert np.allclose(got["whitened"].abs(), 1.0)


def test_equal_vectors_have_equal_bytes():
    for v in ([1.0, 2.0], [-3.0, 400.0], [1e10, 0.0], [0.001, -0.001]):
        x = whitening.steps_of(v)
        assert (whitening.unpacked(whitening.packed(x)) == x).all()
    assert len(whitening.packed(whitening.steps_of([0.1] * 64))) == 65
